"""Document quality from a random field over lines, learned from labelled documents.

A label of a document is the label of its lines.  The field is fitted by a few dozen passes over a bounded sample, in
which only sums of gradients leave the tasks.  A document's score is the mean of its lines' probabilities of being
good, weighted by their length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.arrays import slices
from tidemark.llm.language_id import held_out
from tidemark.llm.line_crf import N_FEATURES, Weights, describe, loss_and_slope, marginals, minimise
from tidemark.llm.store import written

#: Tasks that go over the sample.
_TASKS = 8


def sample(docs: DataFrame, labels: DataFrame, docs_per_class: int) -> DataFrame:
    """codes, first, good: described lines of at most `docs_per_class` documents of each label; a written table.

    Documents are taken by a hash of doc_id.  Labels other than 0 and 1 and doc_ids with both are left out.
    """
    marked = labels.select(F.col("doc_id").cast("long"), F.col("quality").cast("int")).where("doc_id IS NOT NULL AND quality IN (0, 1)")
    marked = marked.groupBy("doc_id").agg(F.min("quality").alias("good"), F.max("quality").alias("_most")).where("good = _most").drop("_most")
    order = [F.xxhash64("doc_id"), "doc_id"]
    picked = [marked.where(F.col("good") == g).orderBy(*order).limit(docs_per_class) for g in (0, 1)]
    texts = docs.select(F.col("doc_id").cast("long"), "text")
    # The broadcast side has two times docs_per_class rows at most.
    found = texts.join(F.broadcast(picked[0].union(picked[1])), "doc_id").groupBy("doc_id", "good").agg(F.min("text").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                lines = describe(batch.column("text"))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([lines.codes.tobytes()], pa.binary()), pa.array([lines.first.astype(np.int64).tobytes()], pa.binary()),
                        pa.array([batch.column("good").to_numpy(zero_copy_only=False).astype(np.int8).tobytes()], pa.binary()),
                    ],
                    ["codes", "first", "good"],
                )

    return written(found.repartition(_TASKS, "doc_id").select("text", "good").mapInArrow(run, "codes binary, first binary, good binary"), "sample")


def fit(docs: DataFrame, labels: DataFrame, docs_per_class: int = 2_000, passes: int = 40, penalty: float = 1e-3) -> np.ndarray | None:
    """Weights learned from docs (doc_id, text) and labels (doc_id, quality); None where no labelled text is found.

    `docs_per_class` bounds the sample, `passes` the number of passes over it, `penalty` weighs the squared weights.
    """
    table = sample(docs, labels, docs_per_class)
    n = table.agg(F.sum(F.octet_length("good"))).first()[0] or 0
    if n == 0:
        return None

    def value(weights: np.ndarray) -> tuple[float, np.ndarray]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            loss, slope = 0.0, np.zeros(Weights.SIZE)
            for batch in batches:
                for codes, first, good in zip(*(batch.column(c).to_pylist() for c in ("codes", "first", "good"))):
                    more, down = loss_and_slope(
                        weights, np.frombuffer(codes, np.uint8).reshape(-1, N_FEATURES), np.frombuffer(first, np.int64),
                        np.frombuffer(good, np.int8).astype(bool),
                    )
                    loss, slope = loss + more, slope + down
            yield pa.RecordBatch.from_arrays([pa.array([loss]), pa.array([slope.tobytes()], pa.binary())], ["loss", "slope"])

        # A row per task; added up in their order, so that the same sample gives the same weights.
        parts = sorted((r["loss"], bytes(r["slope"])) for r in table.mapInArrow(run, "loss double, slope binary").collect())
        loss = sum(p[0] for p in parts) / n + penalty * float(weights @ weights)
        return loss, sum(np.frombuffer(p[1]) for p in parts) / n + 2 * penalty * weights

    return minimise(value, np.zeros(Weights.SIZE), passes)


def score(docs: DataFrame, weights: np.ndarray | None) -> DataFrame:
    """doc_id, score (0 to 1, higher: better); one row per row of `docs`; only the text is looked at.

    docs: doc_id, text; other columns are ignored.  A line weighs its characters and one more, so an empty or null
    text, one empty line, has that line's probability.  Without weights, as nothing was learned, every score is 0.5.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                if weights is None:
                    found = np.full(batch.num_rows, 0.5)
                else:
                    lines, model = describe(batch.column("text")), Weights(weights)
                    good = marginals(model.scores(lines.codes, lines.first), lines.first, model.pairs)
                    size = lines.chars + 1.0
                    found = np.add.reduceat(good * size, lines.first[:-1]) / np.add.reduceat(size, lines.first[:-1])
                    found = np.clip(found, 0.0, 1.0)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found)], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, score double")


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    weights = fit(docs, labels.where(~held_out("doc_id")))
    return score(docs, weights).select(
        "doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )
