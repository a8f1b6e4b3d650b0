"""N-gram Jaccard join with signature trees.

Equal shingle sets become one class.  Classes that can link at all are brought together without pairs, by keys of
which linked sets share one.  Where sets may differ in little, a set is cut by hash into a few more parts than can
differ: each part holds many shingles, and seldom are all of them some other set's.  Where they may differ in much, parts
would hold a few shingles only, and a passage that many documents have would fill some.  There, shingles are ranked by how
common they are, rarest first, and a set is found by its first few: linked sets share one of these for any ranking, and
this one keeps passages out of the keys.  Keys travel packed, many to a row, and each batch of documents sends a key once; the key's other documents
in that batch are joined there.  Connected candidates form a block.  In blocks that are too large for a task, it is asked
for every shingle whether several of their sets have it; shingles of one set come first then and are no keys.  Inside a block, documents are the leaves of a tree
whose nodes hold the OR of token bitmaps and the range of sizes; two trees are walked together, and a pair of nodes is
dropped when the largest overlap it allows is too small.  What is left is compared by its full sets.  Documents that
are linked already, over others, need no further comparison.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.arrays import LOWER, flat, mix, slices, words
from tidemark.llm.graph import components
from tidemark.llm.store import written

LAST = np.iinfo(np.int64).max
_LEAF = 16
_SET = "doc_id long, n_shingles long, h1 long, h2 long"
_PACKED = "bucket int, keys binary, at binary, ids binary, pairs binary"
_LOW = np.uint64((1 << 40) - 1)
#: Cells in which shingles are counted, and the rows that a task sends them in.
_CELLS = 1 << 22
_STRIPES = 64
#: Cuts of a set before its empty parts count.
_LEVELS = 4
#: Shingles in a part from which parts are the keys.
_PART = 8
_MANY = (1 << 16) - 1
_CELL = np.uint64(_CELLS - 1)
#: Keys that a bucket holds (about), keys and sets that a worker holds before it sends them.
_BUCKET_KEYS = 1 << 20
_SENT_KEYS = 1 << 21
_SENT_SETS = 60_000
#: Bytes of text that are cut into words at a time; the arrays for that take some 40 times as much.
_SLICE = 1 << 20


def shingle_sets(column: pa.Array, k: int) -> Iterator[np.ndarray]:
    """Sorted distinct hashes of k-word shingles, lower-cased A-Z; fewer words count as one shingle."""
    data, bounds = flat(column)
    w = words(LOWER[data], bounds)
    full = w.runs(k)
    for a, b in zip(w.first.tolist(), w.first[1:].tolist()):
        if b - a >= k:
            yield np.unique(full[a : b - k + 1])
        elif b > a:
            at = np.array([a])
            short = mix(np.full(1, b - a, np.uint64))
            for i in range(b - a):
                short = mix(short ^ w.hash[at + i])
            yield short
        else:
            yield np.zeros(0, np.uint64)


def size_class(n: int, percent: int) -> list[tuple[int, int]]:
    """(upper size, parts) of the classes in which a set of n shingles meets its partners."""
    hi, out = 9, []
    largest = n * 100 // percent
    while True:
        if n <= hi:
            d = (100 - percent) * 2 * hi // (100 + percent)
            out.append((hi, d + 3 + d // 25 if d else 1))  # a few more than d + 1, for parts that stay empty
            if largest <= hi:
                return out
        hi = hi * 5 // 4


def part_keys(s: np.ndarray, percent: int) -> np.ndarray:
    """Keys of the parts of a set.  Two sets that link have a key in common."""
    out = []
    for hi, parts in size_class(len(s), percent):
        differ = (100 - percent) * (len(s) + min(hi, len(s) * 100 // percent)) // (100 + percent)
        for level in range(_LEVELS):
            h = s if level == 0 else np.sort(mix(s + np.uint64(level * 0x9E3779B97F4A7C15 % 2**64)))
            edges = np.array([(j << 64) // parts for j in range(1, parts)], np.uint64)
            at = np.concatenate([[0], np.searchsorted(h, edges), [len(h)]])
            sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(h), dtype=np.uint64)])
            where = np.arange(parts, dtype=np.uint64) + np.uint64((hi << 24) + (level << 20 << 24))
            key = mix(mix(where) + sums[at[1:]] - sums[at[:-1]])
            held = np.diff(at) > 0
            # Empty parts are equal in many sets.  If more parts hold something than can differ, one of those is shared;
            # if not, the set is cut anew, and in the last cut its empty parts count too.
            enough = int(held.sum()) > differ
            out.append(key[held] if enough or level < _LEVELS - 1 else key)
            if enough:
                break
    return np.concatenate(out)


def commonness(docs: DataFrame, k: int) -> np.ndarray:
    """How many documents have a shingle, on a log scale, by the lowest bits of its hash; one byte for each of _CELLS.

    All documents are counted.  The numbers only rank shingles, so those that share a cell, and a task's counts over 255,
    cost time and no link.
    """
    width = _CELLS // _STRIPES

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(_CELLS, np.uint32)
        for whole in batches:
            for batch in slices(whole, "text", _SLICE):
                for s in shingle_sets(batch.column("text"), k):
                    np.add.at(seen, (s & _CELL).astype(np.int64), 1)
        least = np.minimum(seen, 255).astype(np.uint8).reshape(_STRIPES, width)
        held = np.flatnonzero(least.any(1))
        yield pa.RecordBatch.from_arrays(
            [pa.array(held, pa.int32()), pa.array([least[i].tobytes() for i in held], pa.binary())], ["stripe", "seen"]
        )

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, stripe = np.zeros(width, np.int64), None
        for batch in batches:
            for stripe, seen in zip(batch.column("stripe").to_pylist(), batch.column("seen").to_pylist()):
                total += np.frombuffer(seen, np.uint8)
        level = np.floor(4 * np.log2(1 + total)).astype(np.uint8)
        yield pa.RecordBatch.from_arrays([pa.array([stripe], pa.int32()), pa.array([level.tobytes()], pa.binary())], ["stripe", "level"])

    counts = docs.select("text").mapInArrow(count, "stripe int, seen binary")
    out = np.zeros((_STRIPES, width), np.uint8)
    for row in counts.groupBy("stripe").applyInArrow(add, "stripe int, level binary").collect():  # _CELLS bytes at most
        out[row["stripe"]] = np.frombuffer(row["level"], np.uint8)
    return out.ravel()


def rare_keys(s: np.ndarray, percent: int, level: np.ndarray) -> np.ndarray:
    """Keys of the rarest shingles of a set.  Two sets that link have a key in common.

    A set of n links with sets that have at least ceil(percent * n / 100) of its shingles, so of its first
    n + 1 - that many, in any order that is the same for all sets, one is among the first ones of the other.
    """
    return _rarest(s, len(s) + 1 + -len(s) * percent // 100, level)


def _rarest(s: np.ndarray, first: int, level: np.ndarray) -> np.ndarray:
    if first <= 0:
        return s[:0]
    rank = level[(s & _CELL).astype(np.int64)].astype(np.uint64) << np.uint64(56) | mix(s) >> np.uint64(8)
    return mix(rank[rank <= np.partition(rank, first - 1)[first - 1]])


def set_table(docs: DataFrame, k: int) -> DataFrame:
    """doc_id (null as the largest number), size and 128-bit hash of the set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text", _SLICE):
                n, h1, h2 = [], [], []
                for s in shingle_sets(batch.column("text"), k):
                    n.append(len(s))
                    h1.append(_name(s))
                    h2.append(mix(s ^ np.uint64(0xD1B54A32D192ED03)).sum(dtype=np.uint64))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").fill_null(LAST), pa.array(n, pa.int64()),
                        *(pa.array(np.array(h, np.uint64).view(np.int64)) for h in (h1, h2)),
                    ],
                    ["doc_id", "n_shingles", "h1", "h2"],
                )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, _SET)


def _name(s: np.ndarray) -> np.uint64:
    return mix(s).sum(dtype=np.uint64)


def _stars(keys: np.ndarray, names: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each key once with the least of its names, and the distinct pairs (other name, least name)."""
    order = np.argsort(keys, kind="stable")
    keys, names = keys[order], names[order]
    head = np.flatnonzero(np.concatenate([np.ones(min(1, len(keys)), bool), keys[1:] != keys[:-1]]))
    if len(head) == 0:
        return keys, names, np.zeros((0, 2), np.int64)
    least = np.minimum.reduceat(names, head)
    of = np.repeat(least, np.diff(np.append(head, len(keys))))
    pairs = np.unique(np.stack([names, of], 1)[names != of], axis=0)
    return keys[head], least, pairs


def _pack(keys: np.ndarray, names: np.ndarray, buckets: int) -> pa.RecordBatch:
    """One row per bucket: 5 bytes of each key, which of `ids` has it, and pairs found already."""
    keys, least, pairs = _stars(keys, names)
    bucket = ((keys >> np.uint64(40)) % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    keys, least, bucket = keys[order], least[order], bucket[order]
    goes = pairs[:, 0] % buckets
    pairs, goes = pairs[np.argsort(goes, kind="stable")], np.sort(goes)
    rows = []
    for b in np.union1d(bucket, goes).tolist():
        x, y = np.searchsorted(bucket, [b, b + 1])
        u, v = np.searchsorted(goes, [b, b + 1])
        ids, at = np.unique(least[x:y], return_inverse=True)
        low = (keys[x:y] & _LOW).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5]
        rows.append((b, low.tobytes(), at.astype("<u2").tobytes(), ids.tobytes(), pairs[u:v].tobytes()))
    names = ["bucket", "keys", "at", "ids", "pairs"]
    types = [pa.int32()] + [pa.binary()] * 4
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names)


def _unpacked(keys: bytes, at: bytes, ids: bytes) -> tuple[np.ndarray, np.ndarray]:
    low = np.zeros((len(keys) // 5, 8), np.uint8)
    low[:, :5] = np.frombuffer(keys, np.uint8).reshape(-1, 5)
    return low.view("<u8").ravel(), np.frombuffer(ids, np.int64)[np.frombuffer(at, "<u2")]


def _sent(named: Iterator[tuple[int, np.ndarray]], pack: Callable, buckets: int) -> Iterator[pa.RecordBatch]:
    """Keys of named sets, packed many sets at a time."""
    keys: list[np.ndarray] = []
    names: list[int] = []
    held = 0
    for name, found in named:
        if len(found):
            keys.append(found)
            names.append(name)
            held += len(found)
        if held >= _SENT_KEYS or len(keys) >= _SENT_SETS:
            yield pack(np.concatenate(keys), np.repeat(np.array(names, np.int64), [len(x) for x in keys]), buckets)
            keys, names, held = [], [], 0
    if keys:
        yield pack(np.concatenate(keys), np.repeat(np.array(names, np.int64), [len(x) for x in keys]), buckets)


def by_parts(percent: int) -> bool:
    """Do parts hold at least _PART shingles?  This follows from the similarity alone, and not from the data."""
    return _PART * 2 * (100 - percent) <= 100 + percent


def candidates(docs: DataFrame, k: int, buckets: int, keys_of: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """Pairs (a, b) of set hashes h1 that connect all sets which have a key in common."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets = (s for whole in batches for b in slices(whole, "text", _SLICE) for s in shingle_sets(b.column("text"), k) if len(s))
        return _sent(((int(_name(s).view(np.int64)), keys_of(s)) for s in sets), _pack, buckets)

    return _met(docs.select("text").mapInArrow(send, _PACKED))


def _met(packed: DataFrame) -> DataFrame:
    """Pairs (a, b) of names that connect all which have a key in common.

    A row carries many keys, so that shuffling a key takes some ten bytes.  A key that very many documents have is
    sent once by each batch, and a bucket holds many keys.
    """

    def meet(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        parts = [_unpacked(r["keys"], r["at"], r["ids"]) for r in rows]
        _, _, pairs = _stars(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]))
        known = [np.frombuffer(r["pairs"], np.int64).reshape(-1, 2) for r in rows]
        pairs = np.unique(np.concatenate([pairs, *known]), axis=0)
        return pa.table({"a": pa.array(pairs[:, 0]), "b": pa.array(pairs[:, 1])})

    return packed.groupBy("bucket").applyInArrow(meet, "a long, b long")


def _ask(keys: np.ndarray, names: np.ndarray, buckets: int) -> pa.RecordBatch:
    """One row per bucket: keys, which of `ids` alone has each, or _MANY; `pairs`: (name, key) for those of many."""
    order = np.argsort(keys, kind="stable")
    keys, names = keys[order], names[order]
    head = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    size = np.diff(np.append(head, len(keys)))
    many = np.repeat(size > 1, size)
    known = np.stack([names[many], keys[many].view(np.int64)], 1)
    distinct, holder, lone = keys[head], names[head], size == 1
    bucket = ((distinct >> np.uint64(40)) % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    distinct, holder, lone, bucket = distinct[order], holder[order], lone[order], bucket[order]
    goes = known[:, 0] % buckets
    known, goes = known[np.argsort(goes, kind="stable")], np.sort(goes)
    rows = []
    for b in np.union1d(bucket, goes).tolist():
        x, y = np.searchsorted(bucket, [b, b + 1])
        u, v = np.searchsorted(goes, [b, b + 1])
        ids, at = np.unique(holder[x:y], return_inverse=True)
        at = np.where(lone[x:y], at, _MANY).astype("<u2")
        rows.append((b, distinct[x:y].astype("<u8").tobytes(), at.tobytes(), ids.tobytes(), known[u:v].tobytes()))
    names = ["bucket", "keys", "at", "ids", "pairs"]
    types = [pa.int32()] + [pa.binary()] * 4
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names)


def shared_shingles(members: DataFrame, k: int, buckets: int) -> DataFrame:
    """doc_id, key: the shingles of each member's set that another member has too.

    A batch sends a shingle once.  Sets that share it within their batch know so; a lone holder is told by the bucket.
    """

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def named() -> Iterator[tuple[int, np.ndarray]]:
            for batch in batches:
                table, sets = _sets(pa.Table.from_batches([batch]), k)
                yield from zip(table.column("doc_id").to_pylist(), sets)

        return _sent(named(), _ask, buckets)

    def tell(table: pa.Table) -> pa.Table:
        names, keys, alone = [], [], []
        for raw, at, ids in zip(*(table.column(c).to_pylist() for c in ("keys", "at", "ids"))):
            at = np.frombuffer(at, "<u2")
            one = at != _MANY
            keys.append(np.frombuffer(raw, "<u8"))
            alone.append(one)
            names.append(np.zeros(len(at), np.int64))
            names[-1][one] = np.frombuffer(ids, np.int64)[at[one]]
        name, key, one = np.concatenate(names), np.concatenate(keys), np.concatenate(alone)
        order = np.argsort(key, kind="stable")
        name, key, one = name[order], key[order], one[order]
        again = np.concatenate([key[1:] == key[:-1], [False]]) if len(key) else np.zeros(0, bool)
        told = one & (again | np.roll(again, 1))
        known = np.concatenate([np.frombuffer(x, np.int64) for x in table.column("pairs").to_pylist()]).reshape(-1, 2)
        return pa.table({
            "doc_id": pa.array(np.concatenate([name[told], known[:, 0]])),
            "key": pa.array(np.concatenate([key[told].view(np.int64), known[:, 1]])),
        })

    asked = members.select("doc_id", "h1", "text").mapInArrow(send, _PACKED)
    return asked.groupBy("bucket").applyInArrow(tell, "doc_id long, key long")


def shared_candidates(members: DataFrame, k: int, percent: int, buckets: int, level: Broadcast) -> DataFrame:
    """Pairs (a, b) of doc_ids that connect all sets which have a key in common, as `candidates`.

    Here shingles that no other member has come first.  They are no keys, so a set with enough of them is left out.
    """
    shared = shared_shingles(members, k, buckets).groupBy("doc_id").agg(F.collect_set("key").alias("keys"))
    sizes = members.groupBy("doc_id").agg(F.max("n_shingles").alias("n"))  # one row each, but for repeated doc_ids

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def named() -> Iterator[tuple[int, np.ndarray]]:
            for batch in batches:
                for i, n in enumerate(batch.column("n").to_pylist()):
                    s = np.sort(batch.column("keys")[i].values.to_numpy().view(np.uint64))
                    first = n + 1 + -n * percent // 100 - (n - len(s))
                    yield batch.column("doc_id")[i].as_py(), _rarest(s, first, level.value)

        return _sent(named(), _pack, buckets)

    return _met(shared.join(sizes, "doc_id").mapInArrow(send, _PACKED))


class Tree:
    """Leaves of up to 16 documents in order of size, and nodes above them, two by two."""

    def __init__(self, sets: list[np.ndarray], bits: int):
        sizes = np.array([len(s) for s in sets], np.int64)
        least = np.array([s[0] if len(s) else 0 for s in sets], np.uint64)
        self.order = np.lexsort((least, sizes))
        self.sizes = sizes[self.order]
        self.maps = np.zeros((len(sets), bits // 64), np.uint64)
        for row, i in enumerate(self.order):
            b = np.unique(sets[i] % np.uint64(bits))
            np.bitwise_or.at(self.maps[row], (b >> np.uint64(6)).astype(np.int64), np.uint64(1) << (b & np.uint64(63)))
        self.extra = self.sizes - np.bitwise_count(self.maps).sum(1, dtype=np.int64)  # shingles that share a bit
        self.nodes: dict[tuple[int, int], tuple[np.ndarray, int, int, int]] = {}
        self._node(0, len(sets))

    @staticmethod
    def children(a: int, b: int) -> list[tuple[int, int]]:
        if b - a <= _LEAF:
            return []
        mid = a + (-(-(b - a) // _LEAF) // 2) * _LEAF
        return [(a, mid), (mid, b)]

    def _node(self, a: int, b: int) -> tuple[np.ndarray, int, int, int]:
        below = [self._node(*c) for c in self.children(a, b)]
        if below:
            node = (below[0][0] | below[1][0], below[0][1], below[1][2], max(below[0][3], below[1][3]))
        else:
            node = (np.bitwise_or.reduce(self.maps[a:b]), int(self.sizes[a]), int(self.sizes[b - 1]), int(self.extra[a:b].max()))
        self.nodes[a, b] = node
        return node


def links(left: list[np.ndarray], right: list[np.ndarray] | None, label: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Links that join documents of different label, until no two labels can be joined any more.

    Documents are numbered through left, then right; label has the component each is known to be in.  With `right`
    None the left ones are compared among themselves.
    """
    sets = left + (right or [])
    largest = max((len(s) for s in sets), default=0)
    bits = 512
    while bits < 2 * largest and bits < 1 << 14:
        bits *= 2
    if len(left) == 0 or right is not None and len(right) == 0:
        return []
    one = Tree(left, bits)
    two = one if right is None else Tree(right, bits)
    shift = 0 if right is None else len(left)
    label = label.copy()
    found: list[tuple[int, int]] = []

    def enough(overlap, total):
        return overlap * (100 + percent) >= percent * total

    stack = [((0, len(left)), (0, len(two.order)))]
    while stack:
        u, v = stack.pop()
        mu, lo_u, hi_u, extra_u = one.nodes[u]
        mv, lo_v, hi_v, extra_v = two.nodes[v]
        # Size ranges and bitmaps: the most any two documents below can have in common.
        most = min(hi_u, hi_v, int(np.bitwise_count(mu & mv).sum()) + min(extra_u, extra_v))
        if not enough(most, lo_u + lo_v) or 100 * hi_v < percent * lo_u or 100 * hi_u < percent * lo_v:
            continue
        i, j = one.order[u[0] : u[1]], two.order[v[0] : v[1]] + shift
        if (label[i] == label[i[0]]).all() and (label[j] == label[i[0]]).all():
            continue  # linked over others
        cu, cv = one.children(*u), two.children(*v)
        if cu or cv:
            if cu and (not cv or u[1] - u[0] >= v[1] - v[0]):
                pairs = [(c, v) for c in cu]
            else:
                pairs = [(u, c) for c in cv]
            if right is None and u == v:
                pairs = [(cu[0], cu[1]), (cu[1], cu[1]), (cu[0], cu[0])]
            stack += pairs
            continue
        a, b = one.maps[u[0] : u[1], None], two.maps[None, v[0] : v[1]]
        na, nb = one.sizes[u[0] : u[1], None], two.sizes[None, v[0] : v[1]]
        most = np.minimum(na - np.bitwise_count(a & ~b).sum(2, dtype=np.int64), nb - np.bitwise_count(b & ~a).sum(2, dtype=np.int64))
        for x, y in zip(*np.nonzero(enough(most, na + nb))):
            p, q = int(i[x]), int(j[y])
            if label[p] == label[q]:
                continue
            s, t = (sets[p], sets[q]) if len(sets[p]) <= len(sets[q]) else (sets[q], sets[p])
            at = np.searchsorted(t, s)
            at[at == len(t)] = 0
            if enough(int((t[at] == s).sum()), len(s) + len(t)):
                found.append((p, q))
                label[label == label[q]] = label[p]
    return found


def _sets(table: pa.Table, k: int) -> tuple[pa.Table, list[np.ndarray]]:
    """Rows whose text has the set h1 of their class, with the sets; others only share a doc_id with it."""
    parts = (part for batch in table.to_batches() for part in slices(batch, "text", _SLICE))
    sets = [s for part in parts for s in shingle_sets(part.column("text"), k)]
    own = [i for i, (s, h1) in enumerate(zip(sets, table.column("h1").to_pylist())) if int(_name(s).view(np.int64)) == h1]
    return table.drop_columns("text").take(own), [sets[i] for i in own]


def _edges(ids: np.ndarray, found: list[tuple[int, int]]) -> pa.Table:
    pairs = np.array(found, np.int64).reshape(-1, 2)
    return pa.table({"a": pa.array(ids[pairs[:, 0]]), "b": pa.array(ids[pairs[:, 1]])})


def _block_links(members: DataFrame, k: int, percent: int, *key: str) -> DataFrame:
    def run(table: pa.Table) -> pa.Table:
        table, sets = _sets(table, k)
        ids = table.column("doc_id").to_numpy()
        order = np.argsort(ids, kind="stable")
        return _edges(ids[order], links([sets[i] for i in order], None, np.arange(len(ids)), percent))

    return members.select(*key, "doc_id", "h1", "text").groupBy(*key).applyInArrow(run, "a long, b long")


def _tile_links(members: DataFrame, tiles: DataFrame, k: int, percent: int) -> DataFrame:
    """Links of sub-blocks `left` and `right` of each tile; members: block, sub, doc_id, label, text."""
    sides = tiles.select("block", "left", "right", F.explode(F.array_distinct(F.array("left", "right"))).alias("sub"))

    def run(table: pa.Table) -> pa.Table:
        left, right = table.column("left")[0].as_py(), table.column("right")[0].as_py()
        table, every = _sets(table, k)
        ids, sub, label = (table.column(c).to_numpy() for c in ("doc_id", "sub", "label"))
        order = np.lexsort((ids, sub != left))
        n = int((sub == left).sum())
        sets = [every[i] for i in order]
        found = links(sets[:n], None if left == right else sets[n:], label[order], percent)
        return _edges(ids[order], found)

    rows = members.join(sides, ["block", "sub"]).select("block", "left", "right", "sub", "doc_id", "label", "h1", "text")
    return rows.groupBy("block", "left", "right").applyInArrow(run, "a long, b long")


def _load(size: int) -> F.Column:
    """How many tasks a group of sets needs: one for `size` sets, or for 512 shingles times that."""
    return F.ceil(F.greatest(F.count(F.lit(1)) / size, F.sum("n_shingles") / (512 * size)))


def _span(percent: int) -> F.Column:
    """Class of sizes.  Sets link within a class or with the next one only."""
    return F.floor(F.log(F.col("n_shingles")) / F.log(F.lit(100 / percent))).cast("int")


def _large_blocks(members: DataFrame, edges: DataFrame, k: int, percent: int, size: int) -> DataFrame:
    """Links across the sub-blocks of blocks that were too large for one task.

    First one document of each label of each sub-block is compared.  Then sub-blocks are formed anew: those of one
    label need no comparison with each other, so a group of near copies, which has one label by now, costs nothing.
    Sub-blocks hold sets of one class of sizes, and only those of neighbouring classes are compared.
    """
    def labelled(edges: DataFrame) -> DataFrame:
        known = components(edges).withColumnRenamed("node", "doc_id")
        return members.join(known, "doc_id", "left").withColumn("label", F.coalesce("label", "doc_id"))

    def cut(rows: DataFrame, key: F.Column, *by: str) -> DataFrame:
        """`rows` of each `by` with `sub`, which deals them out by `key`."""
        loads = rows.groupBy(*by).agg(_load(size).alias("_n"))
        return rows.join(loads, [*by]).withColumn("sub", F.xxhash64(*by[1:], F.pmod(key, "_n"))).drop("_n")

    heads = labelled(edges).groupBy("block", "sub", "label").agg(
        F.min_by(F.struct("doc_id", "n_shingles", "h1", "text"), "doc_id").alias("x")
    )
    heads = heads.select("block", "label", "x.*").withColumn("span", _span(percent))
    spread = cut(heads, F.xxhash64("label", "doc_id"), "block", "span")
    edges = written(edges.union(_block_links(spread, k, percent, "block", "sub")), "links")

    now = labelled(edges)
    counts = now.groupBy("block", "label").agg((F.count(F.lit(1)) >= size // 2).alias("pure"))
    now = now.join(counts, ["block", "label"]).withColumn("span", _span(percent))
    now = now.withColumn("only", F.when(F.col("pure"), F.col("label")))
    # A pure sub-block is a piece of one label, a mixed one holds whole small labels.
    now = now.withColumn("_of", F.coalesce("only", F.lit(LAST)))
    now = cut(now, F.when(F.col("pure"), F.xxhash64("doc_id")).otherwise(F.xxhash64("label")), "block", "span", "_of")
    now = written(now.select("block", "sub", "doc_id", "label", "n_shingles", "h1", "text", "only"), "subs")
    span = F.col("n_shingles")
    subs = now.groupBy("block", "sub").agg(F.first("only").alias("only"), F.min(span).alias("lo"), F.max(span).alias("hi"))
    x, y = subs.alias("x"), subs.alias("y")
    fits = (F.col("x.hi") * 100 >= F.col("y.lo") * percent) & (F.col("y.hi") * 100 >= F.col("x.lo") * percent)
    tiles = x.join(y, (F.col("x.block") == F.col("y.block")) & (F.col("x.sub") <= F.col("y.sub"))).where(
        fits & ~F.coalesce(F.col("x.only") == F.col("y.only"), F.lit(False))
    )
    tiles = tiles.select("x.block", F.col("x.sub").alias("left"), F.col("y.sub").alias("right"))
    return edges.union(_tile_links(now, tiles, k, percent))


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, block_docs: int = 4_096) -> DataFrame:
    """doc_id, n_shingles, component_id, class_id; one row per row of `docs`.

    docs: doc_id, text; other columns are ignored.  Two documents link when the Jaccard similarity of their sets of
    k-word shingles is `percent` or more; component_id is the smallest doc_id reachable, class_id that of the
    documents with an equal set.  A task compares at most about `block_docs` documents, or 512 shingles times that (or
    one longer text); larger blocks are cut by size and compared in tiles.  No words (or null text): n_shingles 0, linked with nothing.  Fewer than k words:
    the whole sequence is the only shingle.  A null doc_id is larger than all others, and its ids are null where no
    other document is linked.  Rows that repeat a doc_id are judged each by its own text.
    """
    sets = written(set_table(docs, k), "sets")
    classes = sets.where("n_shingles > 0").groupBy("h1", "h2", "n_shingles").agg(F.min("doc_id").alias("class_id"))
    classes = written(classes, "classes")

    def level(rows: DataFrame) -> Broadcast:
        return docs.sparkSession.sparkContext.broadcast(commonness(rows, k))  # _CELLS bytes

    if by_parts(percent):
        # Two size classes, each with the most by which its sets can differ.
        each, keys_of = F.col("n_shingles") * 5 * (100 - percent) / (100 + percent) + 4, lambda s: part_keys(s, percent)
    else:
        ranks = level(docs)
        each, keys_of = F.col("n_shingles") * (100 - percent) / 100 + 1, lambda s: rare_keys(s, percent, ranks.value)
    keys = classes.agg(F.sum(each)).first()[0] or 0
    # A class goes by its hash h1 here: classes that share it by chance only come into one block.
    meet = candidates(docs, k, max(48, int(keys) // _BUCKET_KEYS), keys_of)
    blocks = components(meet).select(F.col("node").alias("h1"), F.col("label").alias("block"))
    blocks = written(blocks.join(classes, "h1").select(F.col("class_id").alias("doc_id"), "n_shingles", "h1", "block"), "blocks")

    def with_tasks(rows: DataFrame) -> DataFrame:
        return rows.join(rows.groupBy("block").agg(_load(block_docs).alias("tasks")), "block")

    texts = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("doc_id"), "text")
    # Not a broadcast: the number of members grows with the corpus.
    members = texts.join(with_tasks(blocks).hint("merge"), "doc_id").select("block", "tasks", "doc_id", "n_shingles", "h1", "text")
    members = written(members, "members")
    edges = _block_links(members.where("tasks = 1"), k, percent, "block")
    large = members.where("tasks > 1").drop("tasks")
    if not large.isEmpty():
        many = large.agg(F.sum("n_shingles")).first()[0]
        meet = shared_candidates(large, k, percent, max(48, int(many) // _BUCKET_KEYS), level(large))
        again = components(meet).select(F.col("node").alias("doc_id"), F.col("label").alias("block"))
        large = written(with_tasks(large.drop("block").join(again, "doc_id")), "members")
        edges = edges.union(_block_links(large.where("tasks = 1"), k, percent, "block"))
        large = large.where("tasks > 1").drop("tasks")
        if not large.isEmpty():
            large = large.withColumn("span", _span(percent))
            loads = large.groupBy("block", "span").agg(_load(block_docs).alias("subs"))
            sub = F.xxhash64("span", F.pmod(F.xxhash64("doc_id"), "subs")).alias("sub")
            large = written(large.join(loads, ["block", "span"]).select("block", sub, "doc_id", "n_shingles", "h1", "text"), "members")
            first = written(_block_links(large, k, percent, "block", "sub"), "links")
            edges = edges.union(_large_blocks(large, first, k, percent, block_docs))
    edges = written(edges, "links")
    labels = components(edges)
    named = classes.select("h1", "h2", "n_shingles", "class_id").join(
        labels.select(F.col("node").alias("class_id"), "label"), "class_id", "left"
    )
    joined = sets.select("doc_id", "n_shingles", "h1", "h2").join(
        named.select("h1", "h2", F.col("n_shingles").alias("n"), "class_id", F.coalesce("label", "class_id").alias("label")),
        ["h1", "h2"], "left",
    )

    def real(c: str) -> F.Column:
        value = F.coalesce(F.when(F.col("n_shingles") > 0, F.col(c)), F.col("doc_id"))
        return F.when(value != LAST, value)

    return joined.where("n_shingles = 0 OR n = n_shingles").select(
        F.when(F.col("doc_id") != LAST, F.col("doc_id")).alias("doc_id"), "n_shingles",
        real("label").alias("component_id"), real("class_id").alias("class_id"),
    )


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return near_duplicates(docs, k=3, percent=90).select("doc_id", "n_shingles", "component_id")
