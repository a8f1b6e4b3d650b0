"""Substring dedup with difference-cover anchors.

D is a difference cover of the numbers modulo 13: for two places i and j there is a shift below 13 that brings both
onto places of D.  So any two equal windows of 20 words share an aligned anchor, 8 words from a place of D on, and
only 4 places in 13 are hashed.  Anchors that are held once rule out their windows; around the others the match is
extended to the window of 20 words, and of equal windows the first in (doc_id, start) order stays.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import twoway
from tidemark.llm.arrays import SPACE, flat, words

#: Perfect difference covers: period -> places.  Fixed values.
COVERS = {1: (0,), 3: (0, 1), 7: (0, 1, 3), 13: (0, 1, 3, 9), 21: (0, 1, 4, 14, 16), 31: (0, 1, 3, 8, 12, 18)}

_ASK = "bucket int, bid int, w1 binary, w2 binary, doc binary"
_OUT = "doc_id long, n_words long, n_removed long, kept string"


def period_for(window: int) -> int:
    """The longest period whose anchors have at least 40 % of the window's words."""
    return max(p for p in COVERS if p == 1 or window - p + 1 >= 0.4 * window)


def dedup_substrings(docs: DataFrame, window: int = 20, batch_bytes: int = 2 << 20) -> DataFrame:
    """Remove each word that a repeated window covers; one row per row of `docs`.

    docs: doc_id, text; other columns are ignored.  Returns doc_id, n_words, n_removed, kept (kept words joined by one
    space).  Windows are judged on the input.  Null or empty text has no words and keeps "".  Texts shorter than a
    window lose nothing.  A null doc_id counts as larger than all others.  Rows that share a doc_id are documents of
    their own, none before the other: they don't remove anything from each other.  Windows are compared by 96 bits of hash.
    """
    period = period_for(window)
    anchor, cover = window - period + 1, np.isin(np.arange(period), COVERS[period])
    dealt, buckets = twoway.batches(docs, batch_bytes)

    def load(table: pa.Table):
        table, ids = twoway.sorted_batch(table)
        data, bounds = flat(table.column("text"))
        w = words(data, bounds)
        keys = w.runs(anchor)
        at = np.flatnonzero(w.whole(anchor) & cover[w.place[: len(keys)] % period]) if len(keys) else np.zeros(0, np.int64)
        return table, ids, data, bounds, w, at, keys[at]

    def windows(w, ids, at, repeated):
        """Windows that hold a repeated anchor: place, hashes, index of the first equal one in the batch, whether one of the
        batch comes before it (smaller doc_id, or same row), and the indexes of the first ones as they are asked for."""
        n = max(0, len(w.hash) - window + 1)
        hits = np.zeros(len(w.hash) + 1, np.int64)
        hits[at[repeated] + 1] = 1
        hits = np.cumsum(hits)
        near = np.minimum(np.arange(n) + period, len(w.hash))
        place = np.flatnonzero((hits[near] > hits[:n]) & w.whole(window)) if n else np.zeros(0, np.int64)
        w1 = w.runs(window, 0, place)
        w2 = (w.runs(window, 50, place) >> np.uint64(32)).astype(np.uint32)
        order = np.lexsort((w2, w1))
        fresh = np.ones(len(order), bool)
        fresh[1:] = (w1[order][1:] != w1[order][:-1]) | (w2[order][1:] != w2[order][:-1])
        first = order[fresh]  # lexsort is stable: the first of equal windows in (doc_id, start) order
        kin = np.empty(len(order), np.int64)
        kin[order] = first[np.cumsum(fresh) - 1]
        text = w.text[place]
        later = ids[text] > ids[text[kin]]
        later[order[1:]] |= ~fresh[1:] & (text[order[1:]] == text[order[:-1]])
        ask = first[np.lexsort((w1[first], ids[text[first]], twoway.bucket_of(w1[first], buckets)))]
        return place, w1, w2, kin, later, ask

    def ask_keys(key: tuple, table: pa.Table) -> pa.Table:
        *_, keys = load(table)
        return twoway.key_rows(key[0].as_py(), keys, buckets)

    def ask_windows(key: tuple, table: pa.Table, answers: pa.Table) -> pa.Table:
        table, ids, _, _, w, at, keys = load(table)
        place, w1, w2, _, _, ask = windows(w, ids, at, twoway.repeated_among(keys, answers, buckets))
        names, cut = twoway.cuts(twoway.bucket_of(w1[ask], buckets))
        doc = ids[w.text[place[ask]]]
        return pa.table(
            {
                "bucket": pa.array(names, pa.int32()),
                "bid": pa.array([key[0].as_py()] * len(names), pa.int32()),
                "w1": pa.array([w1[ask[a:b]].tobytes() for a, b in zip(cut, cut[1:])], pa.binary()),
                "w2": pa.array([w2[ask[a:b]].tobytes() for a, b in zip(cut, cut[1:])], pa.binary()),
                "doc": pa.array([doc[a:b].tobytes() for a, b in zip(cut, cut[1:])], pa.binary()),
            }
        )

    def answer_windows(table: pa.Table) -> pa.Table:
        bids, bucket = table.column("bid").to_pylist(), table.column("bucket")[0].as_py()
        w1, w2, doc = (
            [np.frombuffer(x, t) for x in table.column(c).to_pylist()]
            for c, t in (("w1", np.uint64), ("w2", np.uint32), ("doc", np.int64))
        )
        at = np.cumsum([0, *map(len, w1)])
        w1, w2, doc = map(np.concatenate, (w1, w2, doc))
        order = np.lexsort((doc, w2, w1))
        a, b, d = w1[order], w2[order], doc[order]
        fresh = np.ones(len(a), bool)
        fresh[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        least = d[np.flatnonzero(fresh)][np.cumsum(fresh) - 1]
        later = np.zeros(len(a), bool)
        later[order] = d > least
        return twoway.answer_table([(i, bucket, 1, np.packbits(later[x:y]).tobytes()) for i, x, y in zip(bids, at, at[1:])])

    def remove(key: tuple, table: pa.Table, answers: pa.Table) -> pa.Table:
        table, ids, data, bounds, w, at, keys = load(table)
        place, w1, _, kin, later, ask = windows(w, ids, at, twoway.repeated_among(keys, answers, buckets))
        elsewhere = np.zeros(len(place), bool)  # of the first ones: does a batch with a smaller doc_id hold it?
        names, cut = twoway.cuts(twoway.bucket_of(w1[ask], buckets))
        got = twoway.bits_of(answers, 1, dict(zip(names.tolist(), np.diff(cut).tolist())))
        elsewhere[ask] = np.concatenate([got[b] for b in names.tolist()]) if len(names) else False
        gone = later | elsewhere[kin]
        step = np.zeros(len(w.hash) + 1, np.int64)
        step[place[gone]] += 1
        step[place[gone] + window] -= 1
        removed = np.cumsum(step)[:-1] > 0
        before = np.concatenate([[0], np.cumsum(removed)])
        kept = np.zeros(len(data) + 1, np.int64)  # a kept word and one byte after it, which becomes the space
        kept[w.start[~removed]] += 1
        kept[np.minimum(w.end[~removed] + 1, bounds[w.text[~removed] + 1])] -= 1
        take = np.cumsum(kept)[:-1] > 0
        clean = np.where(SPACE[data], np.uint8(32), data)
        texts = [clean[a:b][take[a:b]].tobytes().rstrip(b" ").decode("utf-8", "replace") for a, b in zip(bounds, bounds[1:])]
        return pa.table(
            {
                "doc_id": table.column("doc_id").cast(pa.int64()),
                "n_words": pa.array(np.diff(w.first), pa.int64()),
                "n_removed": pa.array(before[w.first[1:]] - before[w.first[:-1]], pa.int64()),
                "kept": pa.array(texts, pa.string()),
            }
        )

    keys = twoway.repeated_keys(twoway.per_batch(dealt, ask_keys, twoway.KEYS))
    asked = twoway.with_answers(dealt, keys, ask_windows, _ASK)
    answers = keys.union(asked.groupBy("bucket").applyInArrow(answer_windows, twoway.ANSWERS))
    return twoway.with_answers(dealt, answers, remove, _OUT)


def op4(spark, sf_dir: str) -> DataFrame:
    done = dedup_substrings(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return done.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
