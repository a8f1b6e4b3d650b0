"""Best-fit packing by bin completion on the histogram of lengths.

Only the number of pieces of each length matters for how full sequences get, and there are at most `capacity`
lengths.  So the driver plans with that histogram, whose size doesn't depend on the corpus: patterns (how many
pieces of which lengths share a sequence) and how often each is used.  Executors then place every piece by its rank
among the pieces of its length.
"""

from __future__ import annotations

import os
import struct
import unicodedata
import zlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.store import written
from tidemark.llm.wordcache import WordCache

Pattern = tuple[tuple[int, int], ...]  # ((length, pieces), ...), longest first


def best_fit(hist: dict[int, int], capacity: int) -> list[tuple[Pattern, int]]:
    """Best-fit decreasing on a histogram: patterns with the number of sequences that use them."""
    open_bins: dict[int, list[tuple[Pattern, int]]] = {}  # by room left
    rooms: list[int] = []

    def put(room: int, pattern: Pattern, times: int) -> None:
        if room not in open_bins:
            open_bins[room] = []
            rooms.insert(bisect_right(rooms, room), room)
        open_bins[room].append((pattern, times))

    for length in sorted(hist, reverse=True):
        left = hist[length]
        while left:
            at = bisect_right(rooms, length - 1)
            if at < len(rooms):
                room = rooms[at]
                pattern, times = open_bins[room].pop()
                if not open_bins[room]:
                    del open_bins[room], rooms[at]
                each = room // length  # the bin stays the best fit until it has no room for another
                full = min(times, left // each)
                if full:
                    put(room - each * length, (*pattern, (length, each)), full)
                    left -= full * each
                if times > full:
                    if left and left < each:
                        put(room - left * length, (*pattern, (length, left)), 1)
                        left, full = 0, full + 1
                    if times > full:
                        put(room, pattern, times - full)
            else:
                each = capacity // length
                if left // each:
                    put(capacity - each * length, ((length, each),), left // each)
                if left % each:
                    put(capacity - left % each * length, ((length, left % each),), 1)
                left = 0
    return [(p, n) for group in open_bins.values() for p, n in group]


def lower_bound(hist: dict[int, int], capacity: int) -> int:
    total = sum(k * n for k, n in hist.items())
    return max(-(-total // capacity), sum(n for k, n in hist.items() if 2 * k > capacity))


def fillings(hist: dict[int, int], room: int, waste: int) -> Iterator[Pattern]:
    """Undominated fillings of `room` that leave at most `waste`, fullest choices first.

    A filling is dominated if a piece still fits, or if one of its pieces could be exchanged for a longer one.
    """
    lengths = [k for k in sorted(hist, reverse=True) if k <= room and hist[k]]
    rest = np.concatenate([np.cumsum([k * hist[k] for k in lengths][::-1])[::-1], [0]]).tolist() if lengths else [0]

    def undominated(chosen: list[tuple[int, int]], left: int) -> bool:
        used = dict(chosen)
        free = [k for k in lengths if hist[k] > used.get(k, 0)]  # longest first
        if free and free[-1] <= left:
            return False
        up = free[::-1]
        for k, _ in chosen:
            i = bisect_right(up, k)
            if i < len(up) and up[i] <= k + left:
                return False
        return True

    def go(i: int, left: int, chosen: list[tuple[int, int]]) -> Iterator[Pattern]:
        if left - rest[i] > waste:
            return
        if i == len(lengths) or left < lengths[-1]:
            if left <= waste and undominated(chosen, left):
                yield tuple(chosen)
            return
        k = lengths[i]
        if k > left:
            lo, hi = i + 1, len(lengths)
            while lo < hi:  # next length that fits
                mid = (lo + hi) // 2
                lo, hi = (mid + 1, hi) if lengths[mid] > left else (lo, mid)
            yield from go(lo, left, chosen)
            return
        for n in range(min(hist[k], left // k), -1, -1):
            yield from go(i + 1, left - n * k, [*chosen, (k, n)] if n else chosen)

    yield from go(0, room, [])


def bin_completion(hist: dict[int, int], capacity: int, max_nodes: int = 2_000) -> list[tuple[Pattern, int]]:
    """Patterns for as few sequences as the search finds.

    Best-fit is the first incumbent.  While it is above the lower bound, branch and bound: the longest piece left gets
    a filling, used as often as the counts allow; fillings that waste more than would beat the incumbent are pruned.
    `max_nodes` bounds the search on the driver; the incumbent always places every piece.
    """
    hist = {k: n for k, n in hist.items() if n}
    best = best_fit(hist, capacity)
    count = sum(n for _, n in best)
    bound, total = lower_bound(hist, capacity), sum(k * n for k, n in hist.items())
    stack, applied, now, nodes = [], [], dict(hist), 0

    def room_to_waste() -> int:  # what further sequences may waste if the incumbent is to be beaten
        used = sum(n for _, n in applied)
        left = sum(k * n for k, n in now.items())
        return (count - 1 - used) * capacity - left

    def branch() -> Iterator[Pattern]:
        longest = max(now)
        rest = dict(now)
        rest[longest] -= 1
        for filling in fillings(rest, capacity - longest, max(0, room_to_waste())):
            merged = dict(filling)
            merged[longest] = merged.get(longest, 0) + 1
            yield tuple(sorted(merged.items(), reverse=True))

    if count > bound and total:
        stack.append(branch())
    while stack and nodes < max_nodes and count > bound:
        nodes += 1
        pattern = next(stack[-1], None)
        if pattern is None or room_to_waste() < 0:
            stack.pop()
            if applied:
                old, times = applied.pop()
                for k, n in old:
                    now[k] = now.get(k, 0) + n * times
            continue
        times = min(now[k] // n for k, n in pattern)
        for k, n in pattern:
            now[k] -= n * times
            if not now[k]:
                del now[k]
        applied.append((pattern, times))
        if not now:
            used = sum(n for _, n in applied)
            if used < count:
                best, count = list(applied), used
            old, times = applied.pop()
            for k, n in old:
                now[k] = now.get(k, 0) + n * times
        elif room_to_waste() < 0:
            old, times = applied.pop()
            for k, n in old:
                now[k] = now.get(k, 0) + n * times
        else:
            stack.append(branch())
    return best


def slots(plan: list[tuple[Pattern, int]]) -> dict[int, tuple[np.ndarray, ...]]:
    """For each length, runs of ranks: first rank, first sequence, pieces per sequence, first offset."""
    out: dict[int, list[tuple[int, int, int, int]]] = {}
    taken: dict[int, int] = {}
    sequence = 0
    for pattern, times in plan:
        offset = 0
        for length, each in pattern:
            rank = taken.get(length, 0)
            out.setdefault(length, []).append((rank, sequence, each, offset))
            taken[length] = rank + each * times
            offset += length * each
        sequence += times
    return {k: tuple(np.array(c, np.int64) for c in zip(*v)) for k, v in out.items()}


_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
_TOKENIZERS: dict[str, WordCache] = {}


def _ids(path: str) -> WordCache:
    """Ids of words as bytes.  White space ends tokens in this vocabulary, so a text's ids are those of its words."""
    if path not in _TOKENIZERS:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)

        model, spelled = tokenizer.model, byte_letters()

        def encode(words: list[bytes]) -> Iterator[bytes]:
            for w in words:
                text = w.decode()
                if text.isalpha() and text == text.lower() and (text.isascii() or unicodedata.is_normalized("NFC", text)):
                    # Lower-case letters in normal form are one unit for the vocabulary's rules: only merges are left.
                    ids = [t.id for t in model.tokenize(text if text.isascii() else "".join([spelled[b] for b in w]))]
                else:
                    ids = tokenizer.encode(text, add_special_tokens=False).ids
                yield struct.pack(f"<{len(ids)}I", *ids)

        marks = dict(zip((b".", b","), encode([b".", b","])))

        def fill(missing: list[bytes]) -> Iterator[bytes]:
            # A full stop or comma after an ASCII letter is a token of its own: encode the word without it.
            bare = [w[:-1] if w[-1:] in marks and w[-2:-1].isalpha() else w for w in missing]
            new = list({w for w in bare if w not in cache.known})
            ids = dict(zip(new, encode(new)))
            for w, b in zip(missing, bare):
                core = ids[b] if b in ids else cache.known[b]
                yield core if b is w else core + marks[w[-1:]]

        cache = _TOKENIZERS[path] = WordCache(fill, 1_000_000)
    return _TOKENIZERS[path]


def byte_letters() -> list[str]:
    """The letter that stands for each byte in byte-level vocabularies: itself if it prints, else one from 256 on."""
    prints = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b if b in prints else next(rest)) for b in range(256)]


def lowered(text: str | None) -> bytes:
    """A-Z in lower case, as the vocabulary's normaliser does anyway; not where a special token may be spelled out."""
    raw = (text or "").encode()
    return raw if b"<|" in raw else raw.lower()


def pieces(docs: DataFrame, capacity: int, tokenizer: str, with_ids: bool = False) -> DataFrame:
    """Token ids of each document plus id 0, cut into pieces of `capacity`; ids themselves only if asked for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = _ids(tokenizer)
        for batch in batches:
            rows: list[tuple] = []
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                raw = b"".join(cache.get(lowered(text.as_py()).split())) + b"\0\0\0\0"
                for k, at in enumerate(range(0, len(raw), 4 * capacity)):
                    part = raw[at : at + 4 * capacity]
                    rows.append((doc, k, at // 4, len(part) // 4, zlib.crc32(part), *([part] if with_ids else [])))
            cols = list(zip(*rows)) if rows else [[]] * (5 + with_ids)
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names[: len(cols)])

    narrow = docs.select(F.col("doc_id").cast("long"), "text")
    return narrow.mapInArrow(run, _PIECES + (", ids binary" if with_ids else ""))


def pack(
    docs: DataFrame, tokenizer: str, capacity: int = 2048, with_ids: bool = False, group_rows: int = 50_000
) -> DataFrame:
    """Pieces with sequence_id and offset; every document is there whole.

    docs: doc_id, text; other columns are ignored.  Null or empty text is the single id 0.  Only documents longer than
    `capacity` are cut.  Rows that share a doc_id are packed like different documents.  Sequence ids are 0 to n - 1.
    `tokenizer` is the path of a vocabulary whose tokens end at white space; `ids` (little-endian uint32) if `with_ids`.
    """
    cut = written(pieces(docs, capacity, tokenizer, with_ids), "pieces")
    hist = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # <= capacity rows
    plan = slots(bin_completion(hist, capacity))

    # Rank among pieces of one length: a place in a hash group of about `group_rows`, plus the groups before it.
    groups = max(1, -(-max(hist.values(), default=1) // group_rows))
    cut = cut.withColumn("part", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(groups)).cast("int"))
    sizes = cut.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    inside = Window.partitionBy("length", "part").orderBy("doc_id", "piece", "ids_crc32")
    ranked = cut.withColumn("rank", F.row_number().over(inside) - 1).join(sizes, ["length", "part"])
    ranked = ranked.withColumn("rank", F.col("rank") + F.col("before")).drop("part", "before")
    plan_everywhere = docs.sparkSession.sparkContext.broadcast(plan)  # at most capacity * sqrt(2 * capacity) runs

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs = plan_everywhere.value
        for batch in batches:
            length, rank = (batch.column(c).to_numpy() for c in ("length", "rank"))
            sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            order = np.argsort(length, kind="stable")
            at = np.flatnonzero(np.diff(length[order], prepend=-1))
            for a, b in zip(at, [*at[1:], len(order)]):
                mine, k = order[a:b], int(length[order[a]])
                first, start, each, off = runs[k]
                i = np.searchsorted(first, rank[mine], "right") - 1
                n, slot = np.divmod(rank[mine] - first[i], each[i])
                sequence[mine], offset[mine] = start[i] + n, off[i] + slot * k
            cols = [c for c in batch.schema.names if c != "rank"]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in cols), pa.array(sequence), pa.array(offset)], [*cols, "sequence_id", "offset"]
            )

    ranked = ranked.select(*(c for c in cut.columns if c != "part"), "rank")
    names = [f"{f.name} {f.dataType.simpleString()}" for f in ranked.schema if f.name != "rank"]
    return ranked.mapInArrow(place, ", ".join([*names, "sequence_id long", "offset long"]))


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    packed = pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json"))
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
