"""From documents to packed training sequences: each stage is a table that the next one reads.

Rejected and duplicate documents go, secrets are blanked out, and what is left is packed.  Each row
stays or goes by itself: where doc_ids repeat or are null, stages find their rows by numbers in the order of doc_id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import exact_dedup, jaccard_join, packing, quality_rules, secret_scan
from tidemark.llm.store import written


def _rows(docs: DataFrame) -> DataFrame:
    """`docs` with a column `_row` of distinct numbers in the order of doc_id, null last; doc_id itself where it serves."""
    repeats = docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1 OR doc_id IS NULL")
    if repeats.isEmpty():
        return docs.withColumn("_row", F.col("doc_id").cast("long"))
    # Ranges of doc_id come in the order of their partitions, and so do these numbers.
    ordered = docs.orderBy(F.asc_nulls_last("doc_id"), F.xxhash64(*docs.columns))
    return written(ordered.withColumn("_row", F.monotonically_increasing_id()), "rows")


def _only(docs: DataFrame, found) -> DataFrame:
    """Rows of `docs` that `found`, given them with `_row` as their doc_id, gives back."""
    rows = _rows(docs)
    wanted = found(rows.withColumn("doc_id", F.col("_row"))).select(F.col("doc_id").alias("_row"))
    return rows.join(wanted, "_row", "left_semi").select(*docs.columns)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _only(docs, lambda d: quality_rules.quality(d).where("kept"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _only(docs, lambda d: exact_dedup.dedup_exact(d).where("kept"))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _only(docs, lambda d: jaccard_join.near_duplicates(d).where("doc_id = component_id"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secret_scan.redact(docs, secret_scan.learn(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("quality", quality), ("exact", exact), ("near", near), ("secrets", secrets), ("pack", pack)]
#: Merged automata, components and packings have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
