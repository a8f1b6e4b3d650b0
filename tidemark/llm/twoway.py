"""Ask, for what each batch of documents holds, whether other batches hold it too.

Documents go to batches of a few MB by a hash of doc_id.  Per batch, what is asked is made distinct (so a string in a
third of all documents is sent once per batch, not once per document) and dealt to buckets by its hash.  A bucket
answers each batch with one bit, or a few, per question in the order asked.  Batch and bucket are functions of the
rows alone, so a lost task is simply run again.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ANSWERS = "bid int, bucket int, leg int, bits binary"
_ANSWER_TYPES = pa.schema([("bid", pa.int32()), ("bucket", pa.int32()), ("leg", pa.int32()), ("bits", pa.binary())])
LAST = np.iinfo(np.int64).max


def batches(docs: DataFrame, batch_bytes: int) -> tuple[DataFrame, int]:
    """(doc_id, text, bid) with about `batch_bytes` of text per bid, and a number of buckets for 4 MB of text each.

    Both follow the size of the input, so what a batch sends to a bucket doesn't shrink to a few bytes when the cluster
    has many partitions.  A null doc_id sorts after all others.
    """
    spark = docs.sparkSession
    total = docs.select(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    n = max(parts, -(-total // batch_bytes))
    dealt = docs.select("doc_id", "text", F.pmod(F.xxhash64("doc_id"), F.lit(n)).cast("int").alias("bid"))
    return dealt, max(parts, total >> 22)


def sorted_batch(table: pa.Table) -> tuple[pa.Table, np.ndarray]:
    """Rows by doc_id (null last), then text; and doc_id with null as the largest number."""
    table = table.sort_by([("doc_id", "ascending"), ("text", "ascending")])
    ids = table.column("doc_id").combine_chunks()
    return table, ids.fill_null(LAST).to_numpy(zero_copy_only=False).astype(np.int64)


def bucket_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket by the high bits, so it rises with the key."""
    return ((keys >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def cuts(bucket: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets of a sorted array, and n + 1 bounds."""
    at = np.flatnonzero(np.diff(bucket, prepend=-1)) if len(bucket) else np.zeros(0, np.int64)
    return bucket[at], np.append(at, len(bucket))


def bits_of(answers: pa.Table, leg: int, sizes: dict[int, int]) -> dict[int, np.ndarray]:
    """Answers of one leg by bucket, as booleans."""
    out = {}
    for b, l, raw in zip(*(answers.column(c).to_pylist() for c in ("bucket", "leg", "bits"))):
        if l == leg:
            out[b] = np.unpackbits(np.frombuffer(raw, np.uint8), count=sizes[b]).astype(bool)
    return out


def answer_table(rows: list[tuple[int, int, int, bytes]]) -> pa.Table:
    cols = list(zip(*rows)) if rows else [[], [], [], []]
    return pa.table([pa.array(c, t.type) for c, t in zip(cols, _ANSWER_TYPES)], schema=_ANSWER_TYPES)


KEYS = "bucket int, bid int, keys binary, many binary"


def key_rows(bid: int, keys: np.ndarray, buckets: int) -> pa.Table:
    """Distinct keys of a batch, dealt to buckets, with a bit for keys that the batch holds more than once."""
    distinct, count = np.unique(keys, return_counts=True)
    names, at = cuts(bucket_of(distinct, buckets))
    return pa.table(
        {
            "bucket": pa.array(names, pa.int32()),
            "bid": pa.array(np.full(len(names), bid), pa.int32()),
            "keys": pa.array([distinct[a:b].tobytes() for a, b in zip(at, at[1:])], pa.binary()),
            "many": pa.array([np.packbits(count[a:b] > 1).tobytes() for a, b in zip(at, at[1:])], pa.binary()),
        }
    )


def repeated_keys(asked: DataFrame) -> DataFrame:
    """Leg 0: is the key held more than once, in this batch or in several?"""

    def answer(table: pa.Table) -> pa.Table:
        bids, bucket = table.column("bid").to_pylist(), table.column("bucket")[0].as_py()
        raw = [np.frombuffer(x, np.uint64) for x in table.column("keys").to_pylist()]
        many = [np.unpackbits(np.frombuffer(x, np.uint8), count=len(k)) for x, k in zip(table.column("many").to_pylist(), raw)]
        keys, seen = np.concatenate(raw), np.concatenate(many).astype(bool)
        order = np.argsort(keys, kind="stable")
        k = keys[order]
        same = k[1:] == k[:-1]
        twice = np.zeros(len(k), bool)
        twice[1:] |= same
        twice[:-1] |= same
        seen[order] |= twice
        at = np.cumsum([0, *map(len, raw)])
        return answer_table([(b, bucket, 0, np.packbits(seen[x:y]).tobytes()) for b, x, y in zip(bids, at, at[1:])])

    return asked.groupBy("bucket").applyInArrow(answer, ANSWERS)


def repeated_among(keys: np.ndarray, answers: pa.Table, buckets: int) -> np.ndarray:
    """For each key of a batch: did leg 0 say that it is repeated?"""
    distinct, inverse = np.unique(keys, return_inverse=True)
    names, at = cuts(bucket_of(distinct, buckets))
    sizes = dict(zip(names.tolist(), np.diff(at).tolist()))
    got = bits_of(answers, 0, sizes)
    yes = np.concatenate([got[b] for b in names.tolist()]) if len(names) else np.zeros(0, bool)
    return yes[inverse.reshape(-1)] if len(yes) else np.zeros(len(keys), bool)


def per_batch(dealt: DataFrame, function: Callable, schema: str) -> DataFrame:
    return dealt.groupBy("bid").applyInArrow(function, schema)


def with_answers(dealt: DataFrame, answers: DataFrame, function: Callable, schema: str) -> DataFrame:
    """`function(batch, answers)` per batch."""
    return dealt.groupBy("bid").cogroup(answers.groupBy("bid")).applyInArrow(function, schema)
