"""Probabilities per position: softmax, code length, integer CDFs.

A position is one row with an array over the vocabulary, so every step here is a projection.  Rows meet only where a
symbol is predicted by the row before it, and there the symbols go to the arrays: the side that is moved has three
narrow columns.
"""

from __future__ import annotations

import uuid

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions import fixed
from tidemark.session import shared_folder

CHUNK = ["dataset", "month", "chunk_id"]
SCALE = 2**fixed.CDF_BITS


def _by_length(arrays: pa.Array) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """Which rows are not null, and per length the numbers of its rows with their values as one matrix."""
    valid = arrays.is_valid().to_numpy(zero_copy_only=False)
    sizes = arrays.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = arrays.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
    start = np.cumsum(sizes) - sizes
    groups = [(rows, flat[start[rows][:, None] + np.arange(n)]) for n in np.unique(sizes[valid]) for rows in [np.flatnonzero(valid & (sizes == n))]]
    return valid, groups


def _listed(valid: np.ndarray, groups: list[tuple[np.ndarray, np.ndarray]]) -> pa.Array:
    """Matrices of `_by_length` back in the order of the rows."""
    sizes = np.zeros(len(valid), np.int64)
    for rows, values in groups:
        sizes[rows] = values.shape[1]
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    out = np.zeros(offsets[-1])
    for rows, values in groups:
        out[offsets[rows][:, None] + np.arange(values.shape[1])] = values
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32), mask=np.append(~valid, False)), pa.array(out))


@F.arrow_udf(T.ArrayType(T.DoubleType()))
def _softmax(logits: pa.Array) -> pa.Array:
    """A batch at once: lambdas over a large vocabulary would cost some 100 ns a number, and inlined sums its square."""
    valid, groups = _by_length(logits)
    shares = []
    for rows, x in groups:
        e = np.exp(x - x.max(axis=1, keepdims=True, initial=-np.inf))
        shares.append((rows, e / np.cumsum(e, axis=1)[:, -1:] if x.shape[1] else e))
    return _listed(valid, shares)


def softmax(df: DataFrame, logits: str = "logits", out: str = "pmf") -> DataFrame:
    return df.withColumn(out, _softmax(F.col(logits)))


def restrict(df: DataFrame, allowed: list[int], logits: str = "logits") -> DataFrame:
    """Keep the logits of the allowed ids, in that order.  Must come before softmax."""
    ids = F.array(*[F.lit(i) for i in allowed])
    picked = F.transform(ids, lambda i: F.element_at(F.col(logits), i + 1))
    return df.withColumn(logits, picked)


def symbol_index(sym: Column, allowed: list[int]) -> Column:
    """Index of an id among the allowed ids; they must be distinct."""
    if len(set(allowed)) != len(allowed):
        raise ValueError("two symbols share an id, the inverse map is not defined")
    return (F.array_position(F.array(*[F.lit(i) for i in allowed]), sym) - 1).cast("int")


def code_length(p: Column) -> Column:
    """Bits of a probability, clamped from below; NULL stays NULL."""
    floor = F.lit(fixed.PROBABILITY_FLOOR)
    return -F.log2(F.when(p < floor, floor).otherwise(p))


def store_by_chunk(df: DataFrame, buckets: int, purpose: str = "positions") -> DataFrame:
    """`df` as a table in buckets of whole chunks, so that later steps along a chunk move no array.

    The arrays are dealt out once, here; a model that writes its output like this saves that too.
    """
    name = f"tidemark_{purpose}_{uuid.uuid4().hex}"
    dealt = df.repartition(buckets, *CHUNK).write.bucketBy(buckets, *CHUNK)
    dealt.option("path", shared_folder(df.sparkSession, purpose)).saveAsTable(name)
    return df.sparkSession.table(name)


def predicted(df: DataFrame) -> DataFrame:
    """Each row with the symbol after it as `sym` and that one's `off`: what its distribution predicts.

    The last position of a chunk predicts nothing and is left out.  Only a chunk's symbols, a map of at most the context
    size, are brought to its rows, as the build side of a hash join; the arrays stay where they are if `df` is stored
    by chunk, and if the symbols are few enough for a broadcast.  Softmax and lookup come after this, in the row's own
    task.  Positions of a chunk are distinct.
    """
    pairs = F.collect_list(F.struct(F.col("off") - 1, F.col("sym")))
    after = df.groupBy(*CHUNK).agg(F.map_from_entries(pairs).alias("_after"))
    joined = df.join(after.hint("shuffle_hash"), CHUNK).withColumn("sym", F.try_element_at("_after", F.col("off")))
    return joined.where(F.col("sym").isNotNull()).withColumn("off", F.col("off") + 1).drop("_after")


def self_information(df: DataFrame) -> Column:
    return code_length(F.element_at(F.col("pmf"), (F.col("sym") + 1).cast("int")))


# --- integer CDFs -----------------------------------------------------------
@F.arrow_udf(T.ArrayType(T.DoubleType()))
def pmf_to_cdf(pmf: pa.Array) -> pa.Array:
    """Running sums with a leading 0, clamped at 1; NULL stays NULL.

    All rows of a batch that have one length, which is the vocabulary's, are summed at once.
    """
    valid, groups = _by_length(pmf)
    sums = [(rows, np.minimum(np.cumsum(np.pad(p, ((0, 0), (1, 0))), axis=1), 1.0)) for rows, p in groups]
    return _listed(valid, sums)


def quantize_cdf(cdf: Column) -> Column:
    """Strictly increasing integers: rounded half to even, plus the index."""
    top = F.lit(SCALE) - (F.size(cdf) - 1)
    scaled = F.zip_with(cdf, F.array_repeat(top, F.size(cdf)), lambda c, t: F.rint(c * t).cast("bigint"))
    return F.transform(scaled, lambda c, i: c + i)  # no lambda holds `cdf`, which may be a pandas UDF


def interval(cdf: Column, sym: Column) -> tuple[Column, Column]:
    """Bounds of a symbol; the last symbol always ends at the full range."""
    low = F.element_at(cdf, (sym + 1).cast("int"))
    high = F.when(sym == F.size(cdf) - 2, F.lit(SCALE)).otherwise(F.element_at(cdf, (sym + 2).cast("int")))
    return low, high.cast("bigint")


def quantized_bits(cdf: Column, sym: Column) -> Column:
    low, high = interval(cdf, sym)
    return -F.log2((high - low) / F.lit(float(SCALE)))


def coded_bytes(bits: Column) -> Column:
    """Whole bytes an interval coder needs: its bits plus two to close."""
    return F.ceil((bits + 2) / 8)


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def symbols_at(cdf: pd.Series, points: pd.Series) -> pd.Series:
    """For each point the largest symbol whose lower bound is at or below it; bounds are sorted, so by bisection."""
    found = (np.minimum(np.searchsorted(c, p, "right") - 1, len(c) - 2).astype(np.int32) for c, p in zip(cdf, points))
    return pd.Series(list(found), dtype=object)


#: Points of a context that share a row.
POINTS = 1 << 16


def decode_points(cdfs: DataFrame, points: DataFrame, on: list[str]) -> DataFrame:
    """Range lookup of code points in the integer CDF of their context; `points` has `point` and any other columns.

    The points of a context are packed into rows of about POINTS, so a CDF is moved once for each of these rows and
    not for each point, and no context has to fit a task.
    """
    rest = [c for c in points.columns if c not in on]
    parts = points.groupBy(*on).agg(F.ceil(F.count(F.lit(1)) / POINTS).alias("_parts"))
    spread = points.join(parts, on).withColumn("_part", F.pmod(F.xxhash64(*rest), "_parts"))
    packed = spread.groupBy(*on, "_part").agg(F.collect_list(F.struct(*rest)).alias("_points"))
    found = symbols_at(F.col("cdf"), F.transform("_points", lambda p: p["point"])).alias("_found")
    rows = packed.join(cdfs, on).select(*on, "_points", found)
    each = rows.select(*on, F.explode_outer(F.arrays_zip("_points", "_found")).alias("_row"))
    return each.select(*on, *(F.col(f"_row._points.{c}").alias(c) for c in rest), F.col("_row._found").alias("decoded"))
