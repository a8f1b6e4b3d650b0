"""Product codes of vectors, learned over metric trees of their parts.

Vectors are cut into equal parts.  Each task builds, for every few thousand vectors and each part, a ball tree by the
anchors hierarchy (`metric_trees`) and writes it.  A round of learning walks the trees with the entries as candidates;
balls that one entry owns add their cached sums and counts, so most points aren't looked at.  Only sums per entry come
back, in whole numbers, so the codebooks don't depend on how the vectors are dealt out.
"""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.metric_trees import MetricTree, build, integers, walk
from tidemark.llm.store import written
from tidemark.operators.skew import lookup_weighted

#: Vectors that share a tree.
TREE_ROWS = 4_096
#: Scaled components beyond this are set to it.
BOUND = 1 << 60
_LONG = np.iinfo(np.int64).max


def kept_vectors(vectors: DataFrame) -> DataFrame:
    """vec_id, embedding, label_key (text, never null) of the rows whose vector is whole and finite."""
    fine = "NOT exists(embedding, x -> x IS NULL OR isnan(x) OR abs(x) = double('infinity'))"
    label = F.when(F.col("label").isNull(), "n").otherwise(F.concat(F.lit("v"), F.col("label").cast("string")))
    return vectors.select(
        F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>"), label.alias("label_key")
    ).where("embedding IS NOT NULL").where(fine)


def _scaled(vectors: np.ndarray, scale: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.clip(np.floor(vectors * scale), -BOUND, BOUND).astype(np.int64)


def _small(values: np.ndarray) -> np.ndarray:
    """The same integers in as few bytes as hold them, as they are stored."""
    if values.dtype == object or not values.size:
        return values
    most = max(-int(values.min()), int(values.max()))
    return values.astype(next(t for t in (np.int16, np.int32, np.int64) if most <= np.iinfo(t).max))


def _stored(tree: MetricTree) -> dict[str, np.ndarray]:
    return {k: v.astype(np.float64) if k == "radius" else _small(v) for k, v in vars(tree).items()}


def _loaded(fields: dict[str, np.ndarray]) -> MetricTree:
    return MetricTree(**{k: v if v.dtype in (object, np.float64) else v.astype(np.int64) for k, v in fields.items()})


def forest(kept: DataFrame, width: int, parts: int, scale: int) -> DataFrame:
    """vec_id, label_key (arrays) and trees of each few thousand rows; a written table."""

    def grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, TREE_ROWS):
                batch = whole.slice(at, TREE_ROWS)
                n = batch.num_rows
                flat = batch.column("embedding").flatten().to_numpy(zero_copy_only=False)
                cut = _scaled(flat.reshape(n, width), scale).reshape(n, parts, width // parts)
                trees = [_stored(build(integers(cut[:, p]))) for p in range(parts)]
                held = [pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), batch.column(c)) for c in ("vec_id", "label_key")]
                yield pa.RecordBatch.from_arrays([*held, pa.array([pickle.dumps(trees, 5)], pa.binary())], ["vec_id", "label_key", "trees"])

    return written(kept.mapInArrow(grow, "vec_id array<long>, label_key array<string>, trees binary"), "forest")


def _next_books(trees: DataFrame, books: list[np.ndarray]) -> list[np.ndarray]:
    """Entries moved to the floor of the mean of their parts; an entry without parts stays."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = [np.zeros(b.shape, object) for b in books]
        counts = [np.zeros(len(b), np.int64) for b in books]
        for batch in batches:
            for raw in batch.column("trees"):
                for p, fields in enumerate(pickle.loads(raw.as_buffer())):
                    _, sums, seen = walk(_loaded(fields), books[p])
                    totals[p] += sums
                    counts[p] += seen
        rows = [
            (p, e, i, str(v), int(counts[p][e])) for p, t in enumerate(totals) for e, line in enumerate(t) if counts[p][e]
            for i, v in enumerate(line)
        ]
        types = [pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.int64()]
        columns = [pa.array([r[i] for r in rows], t) for i, t in enumerate(types)]
        yield pa.RecordBatch.from_arrays(columns, ["part", "entry", "place", "total", "n"])

    sums = trees.select("trees").mapInArrow(add, "part int, entry int, place int, total string, n long")
    found = sums.groupBy("part", "entry", "place").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"), F.sum("n").alias("n"))
    out = [b.astype(object) for b in books]
    for r in found.collect():  # one row per component of the codebooks
        out[r["part"]][r["entry"], r["place"]] = int(r["total"]) // int(r["n"])
    return [integers(b) for b in out]


def _coded(trees: DataFrame, books: list[np.ndarray]) -> DataFrame:
    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                ids, keys = batch.column("vec_id")[row].values, batch.column("label_key")[row].values
                codes = np.zeros((len(ids), len(books)), np.uint8)
                error = np.zeros(len(ids), object)
                for p, fields in enumerate(pickle.loads(batch.column("trees")[row].as_buffer())):
                    tree = _loaded(fields)
                    near, _, _ = walk(tree, books[p])
                    exact = object if tree.points.dtype == object or books[p].dtype == object else np.int64
                    codes[tree.order, p] = near
                    error[tree.order] += ((tree.points.astype(exact) - books[p].astype(exact)[near]) ** 2).sum(1).astype(object)
                yield pa.RecordBatch.from_arrays(
                    [
                        ids, keys, pa.array([c.tobytes().hex() for c in codes], pa.string()),
                        pa.array([int(e) if e <= _LONG else None for e in error], pa.int64()),
                    ],
                    ["vec_id", "label_key", "code", "error"],
                )

    return trees.mapInArrow(code, "vec_id long, label_key string, code string, error long")


def compress(vectors: DataFrame, parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4_096) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256; one row per row with a whole, finite vector.

    vectors: vec_id, embedding (array of numbers), label; other columns are ignored.  Components become
    floor(scale * x), at most 2^60 either way.  Codebooks start from the `entries` rows that are first by vec_id (null
    last), then by vector; fewer rows give fewer entries.  The first of these rows sets the length: rows of another length
    are dropped, and ValueError is raised where it isn't a multiple of `parts`.  Rows that repeat a vec_id count each
    for themselves.  Labels may be null (all nulls are one label) and one may have most rows: totals of labels
    with over 1/1024 of the rows are broadcast, at most 1,023 of them.  An error that no long holds is null, and so is a
    sum of such.  No row left: no rows.
    """
    if not 0 < entries <= 256:
        raise ValueError("an entry is a byte of the code: 1 to 256 entries")
    kept = kept_vectors(vectors)
    start = kept.orderBy(F.asc_nulls_last("vec_id"), "embedding").select("embedding")
    first = [r["embedding"] for r in start.limit(1).collect()]
    if not first:
        none = kept.select("vec_id", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"))
        return none.select("*", F.col("error").alias("label_error"), F.lit("").alias("codebooks_sha256")).where("false")
    width = len(first[0])
    if width % parts:
        raise ValueError(f"vectors of {width} components can't be cut into {parts} equal parts")
    same = F.size("embedding") == width
    found = [r["embedding"] for r in start.where(same).limit(entries).collect()]
    top = np.array(found, np.float64).reshape(len(found), width)
    books = [integers(b) for b in np.split(_scaled(top, scale), parts, axis=1)]
    trees = forest(kept.where(same), width, parts, scale)
    for _ in range(rounds):
        books = _next_books(trees, books)
    name = hashlib.sha256(",".join(str(int(v)) for b in books for v in b.ravel()).encode()).hexdigest()
    coded = written(_coded(trees, books), "codes")
    whole = F.when(F.count("error") == F.count(F.lit(1)), F.try_sum("error"))
    totals = coded.groupBy(F.col("label_key").alias("_label")).agg(whole.alias("label_error"), F.count(F.lit(1)).alias("_n"))
    joined = lookup_weighted(coded, totals, "label_key", "_label", "_n", ["label_error"], ["vec_id", "code"])
    return joined.select("vec_id", "code", "error", "label_error", F.lit(name).alias("codebooks_sha256"))


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compress(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
