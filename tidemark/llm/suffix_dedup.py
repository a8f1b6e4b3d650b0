"""Suffix-array dedup: the sorted order of all repeated strings, built column by column over many documents.

Every 50-byte string holds 31 grams of 20 bytes; the one with the smallest hash is its anchor, so equal strings have
equal anchors at equal places.  Anchors held once rule out their strings.  What is left, stretches of text around
repeated anchors, is dealt to buckets by anchor.  A bucket lays its stretches side by side at the anchor and inserts
one symbol of each per round: the round's column is the Burrows-Wheeler column of the collection (each symbol in the
order of the text beside it), sorting it stably gives the next order, and the common lengths of neighbours are
updated from the last round's.  Where they reach 50, neighbours hold the same string.  Comparison is of bytes, not
hashes.  The rounds run over columns that Spark's shuffle files bring to the bucket; nothing is kept elsewhere.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import twoway
from tidemark.llm.arrays import flat, mix

_rng = np.random.Generator(np.random.PCG64(50))
_BYTE = _rng.integers(0, 2**64, size=256, dtype=np.uint64)
_MUL = _rng.integers(0, 2**64, size=64, dtype=np.uint64) | np.uint64(1)
_PLACE_BITS = np.uint64(31)
_PLACE = np.uint64((1 << 31) - 1)

_ASK = "bucket int, bid int, body binary, lead binary, count binary, doc binary"
_OUT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary"


def gram_hashes(data: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k bytes from each place on, by joining hashes of lengths that are powers of two."""
    n = len(data) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    power, length, out, done = _BYTE[data], 1, None, 0
    while True:
        if k & length:
            part = power[done : done + n]
            out = part.copy() if out is None else out * _MUL[length.bit_length()] + part
            done += length
        if done == k:
            return mix(out)
        power = power[:-length] * _MUL[32 + length.bit_length()] + power[length:]
        length *= 2


def anchors(data: np.ndarray, bounds: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts of whole windows, the place of each one's anchor (the leftmost of equals), and hashes of all grams."""
    hashes = gram_hashes(data, gram)
    n = len(data) - window + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), hashes
    least = (hashes >> _PLACE_BITS << _PLACE_BITS) | np.arange(len(hashes), dtype=np.uint64)
    width, have = window - gram + 1, 1
    while have * 2 <= width:
        least = np.minimum(least[:-have], least[have:])
        have *= 2
    if have < width:
        least = np.minimum(least[: len(least) - (width - have)], least[width - have :])
    whole = np.ones(n, bool)
    for b in bounds[1:-1].tolist():
        whole[max(0, b - window + 1) : b] = False
    start = np.flatnonzero(whole)
    return start, (least[start] & _PLACE).astype(np.int64), hashes


def column_order(body: np.ndarray, begin: np.ndarray, size: np.ndarray, doc: np.ndarray, window: int, width: int) -> np.ndarray:
    """Which windows of which stretches also start in a document with a smaller id?

    Stretch i is body[...] of size[i] bytes, its first byte in column begin[i]; doc[i] is its document.  Returns one
    boolean per window, stretch after stretch.
    """
    n = len(begin)
    head = np.concatenate([[0], np.cumsum(size)])[:-1]
    out_at = np.concatenate([[0], np.cumsum(size - window + 1)])
    out = np.zeros(out_at[-1], bool)
    order, common = np.arange(n), np.zeros(n, np.uint8)
    for c in range(width):
        at = c - begin[order]
        here = (at >= 0) & (at < size[order])
        symbols = np.zeros(n, np.uint16)  # this round's Burrows-Wheeler column; 0: the stretch has no symbol here
        symbols[here] = body[(head[order] + at)[here]].astype(np.uint16) + 1
        turn = np.argsort(symbols, kind="stable")
        symbols = symbols[turn]
        same = np.zeros(n, bool)
        same[1:] = symbols[1:] == symbols[:-1]
        k = np.flatnonzero(same)
        fresh = np.zeros(n, np.uint8)
        if len(k):
            fresh[k] = np.minimum(range_min(common, turn[k - 1] + 1, turn[k]) + 1, 250)
        order, common = order[turn], fresh
        if c >= window - 1:
            lo = c - window + 1 - begin[order]
            valid = np.flatnonzero((lo >= 0) & (lo + window <= size[order]))
            if len(valid):
                i = order[valid]
                new = common[valid] < window
                new[1:] |= valid[1:] != valid[:-1] + 1
                new[0] = True
                least = np.minimum.reduceat(doc[i], np.flatnonzero(new))[np.cumsum(new) - 1]
                later = doc[i] > least
                out[(out_at[i] + lo[valid])[later]] = True
    return out


def range_min(values: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """min(values[lo..hi]) for each pair, hi included, from minima over lengths that are powers of two."""
    span = hi - lo + 1
    level = np.frexp(span)[1] - 1
    out, tops, top = np.empty(len(lo), values.dtype), values, 0
    for l in range(int(level.max()) + 1):
        if l:
            half = 1 << (l - 1)
            tops = np.minimum(tops[: len(tops) - half], tops[half:])
        pick = np.flatnonzero(level == l) if l else np.flatnonzero(level <= 0)
        if len(pick):
            out[pick] = np.minimum(tops[lo[pick]], tops[hi[pick] - (1 << l) + 1])
    return out


def dedup_bytes(docs: DataFrame, window: int = 50, gram: int = 20, batch_bytes: int = 1 << 20) -> DataFrame:
    """Remove each byte covered by a `window`-byte string that also starts in a document with a smaller doc_id.

    docs: doc_id, text; other columns are ignored.  Returns one row per row: doc_id, n_bytes, n_removed, n_spans
    (maximal removed runs), kept (binary: the bytes that stay).  Strings are judged on the input and never cross
    documents.  Null or empty text gives 0, 0, 0 and no bytes; texts shorter than the window lose nothing.  A null
    doc_id counts as larger than all others; rows that share a doc_id don't remove anything from each other.
    """
    dealt, buckets = twoway.batches(docs, batch_bytes)
    reach = window - gram  # the anchor starts at most this far into a window

    def load(table: pa.Table):
        table, ids = twoway.sorted_batch(table)
        data, bounds = flat(table.column("text"))
        start, anchor, hashes = anchors(data, bounds, window, gram)
        text = np.searchsorted(bounds, start, "right") - 1
        fresh = np.ones(len(start), bool)
        fresh[1:] = (anchor[1:] != anchor[:-1]) | (start[1:] != start[:-1] + 1) | (text[1:] != text[:-1])
        head = np.flatnonzero(fresh)
        count = np.diff(np.append(head, len(start)))
        # a stretch: `count` windows in a row with the same anchor
        return table, ids, data, bounds, start[head], count, anchor[head], hashes[anchor[head]], text[head]

    def stretches(data, ids, start, count, anchor, key, text, repeated):
        """Distinct stretches with repeated anchors in the order asked, and for each stretch which distinct one it is."""
        live = np.flatnonzero(repeated)
        size = count[live] + window - 1
        wide = window + reach
        rows = np.zeros((len(live), wide + 2), np.uint8)
        inside = np.arange(wide) < size[:, None]
        at = np.minimum(start[live][:, None] + np.arange(wide), max(len(data) - 1, 0))
        if len(live):
            rows[:, 2:] = np.where(inside, data[at], 0)
        rows[:, 0], rows[:, 1] = count[live], anchor[live] - start[live] + 1
        _, first, which = np.unique(rows.view(f"S{wide + 2}").reshape(-1), return_index=True, return_inverse=True)
        which = which.reshape(-1)
        doc = ids[text[live[first]]]
        bucket = twoway.bucket_of(key[live[first]], buckets)
        ask = np.lexsort((np.arange(len(first)), doc, bucket))
        return live, rows, size, first, which, doc, bucket, ask

    def ask_keys(key: tuple, table: pa.Table) -> pa.Table:
        return twoway.key_rows(key[0].as_py(), load(table)[7], buckets)

    def ask_stretches(key: tuple, table: pa.Table, answers: pa.Table) -> pa.Table:
        table, ids, data, _, start, count, anchor, hashes, text = load(table)
        repeated = twoway.repeated_among(hashes, answers, buckets)
        live, rows, size, first, _, doc, bucket, ask = stretches(data, ids, start, count, anchor, hashes, text, repeated)
        names, cut = twoway.cuts(bucket[ask])
        out = {"bucket": [], "bid": [], "body": [], "lead": [], "count": [], "doc": []}
        for b, x, y in zip(names.tolist(), cut, cut[1:]):
            mine = rows[first[ask[x:y]]]
            body = mine[:, 2:][np.arange(mine.shape[1] - 2) < size[first[ask[x:y]]][:, None]]
            for name, v in (("bucket", b), ("bid", key[0].as_py()), ("body", body.tobytes()), ("lead", (mine[:, 1] - 1).tobytes()),
                            ("count", mine[:, 0].tobytes()), ("doc", doc[ask[x:y]].tobytes())):
                out[name].append(v)
        kinds = (pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.binary())
        return pa.table({n: pa.array(v, t) for (n, v), t in zip(out.items(), kinds)})

    def answer_stretches(table: pa.Table) -> pa.Table:
        bids, bucket = table.column("bid").to_pylist(), table.column("bucket")[0].as_py()
        body, lead, count, doc = (
            [np.frombuffer(x, t) for x in table.column(c).to_pylist()]
            for c, t in (("body", np.uint8), ("lead", np.uint8), ("count", np.uint8), ("doc", np.int64))
        )
        windows = np.cumsum([0, *(int(c.sum()) for c in count)])
        body, lead, count, doc = map(np.concatenate, (body, lead, count, doc))
        size = count.astype(np.int64) + window - 1
        later = column_order(body, reach - lead.astype(np.int64), size, doc, window, window + reach)
        return twoway.answer_table([(i, bucket, 1, np.packbits(later[x:y]).tobytes()) for i, x, y in zip(bids, windows, windows[1:])])

    def remove(key: tuple, table: pa.Table, answers: pa.Table) -> pa.Table:
        table, ids, data, bounds, start, count, anchor, hashes, text = load(table)
        repeated = twoway.repeated_among(hashes, answers, buckets)
        live, _, _, first, which, doc, bucket, ask = stretches(data, ids, start, count, anchor, hashes, text, repeated)
        n = count[live[first]]
        names, cut = twoway.cuts(bucket[ask])
        total = np.concatenate([[0], np.cumsum(n[ask])])
        got = twoway.bits_of(answers, 1, {b: int(total[y] - total[x]) for b, x, y in zip(names.tolist(), cut, cut[1:])})
        flags = np.concatenate([got[b] for b in names.tolist()]) if len(names) else np.zeros(0, bool)
        flag_at = np.empty(len(first), np.int64)
        flag_at[ask] = total[:-1]
        mine = count[live]
        owner = np.repeat(np.arange(len(live)), mine)
        within = np.arange(len(owner)) - np.repeat(np.cumsum(mine) - mine, mine)
        gone = flags[flag_at[which[owner]] + within] | (ids[text[live]] > doc[which])[owner]
        at = (start[live][owner] + within)[gone]
        step = np.zeros(len(data) + 1, np.int64)
        step[at] += 1
        step[at + window] -= 1
        removed = np.cumsum(step)[:-1] > 0
        begins = removed.copy()
        begins[1:] &= ~removed[:-1]
        begins[bounds[:-1][np.diff(bounds) > 0]] = removed[bounds[:-1][np.diff(bounds) > 0]]
        total, spans = (np.concatenate([[0], np.cumsum(x)]) for x in (removed, begins))
        return pa.table(
            {
                "doc_id": table.column("doc_id").cast(pa.int64()),
                "n_bytes": pa.array(np.diff(bounds), pa.int64()),
                "n_removed": pa.array(total[bounds[1:]] - total[bounds[:-1]], pa.int64()),
                "n_spans": pa.array(spans[bounds[1:]] - spans[bounds[:-1]], pa.int64()),
                "kept": pa.array([data[a:b][~removed[a:b]].tobytes() for a, b in zip(bounds, bounds[1:])], pa.binary()),
            }
        )

    keys = twoway.repeated_keys(twoway.per_batch(dealt, ask_keys, twoway.KEYS))
    asked = twoway.with_answers(dealt, keys, ask_stretches, _ASK)
    answers = keys.union(asked.groupBy("bucket").applyInArrow(answer_stretches, twoway.ANSWERS))
    return twoway.with_answers(dealt, answers, remove, _OUT)


def op1(spark, sf_dir: str) -> DataFrame:
    done = dedup_bytes(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return done.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
