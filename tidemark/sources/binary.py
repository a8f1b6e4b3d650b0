"""Binary corpora: audio and image bytes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.prefix import ordinal_bucket, running_total

KEYS = ["dataset", "month"]


def read_binary(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """Files in '<dataset>/<month>/' folders as rows of bytes."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option(
        "recursiveFileLookup", "true"
    ).load(path)
    return files.select(
        F.regexp_extract("path", r"([^/]+)/[^/]+/[^/]+$", 1).alias("dataset"),
        F.regexp_extract("path", r"([^/]+)/[^/]+$", 1).alias("month"),
        F.regexp_extract("path", r"([^/]+)$", 1).alias("name"),
        F.col("length").alias("n_bytes"),
        "content",
    )


def byte_stream(records: DataFrame, column: str, budget: int) -> DataFrame:
    """The first `budget` bytes of each month's records, in order, as one binary value."""
    sized = records.withColumn("n_bytes", F.octet_length(column)).where(F.col("n_bytes") > 0)
    placed = running_total(
        sized, KEYS, ["doc_ord"], "n_bytes", ordinal_bucket(), out="start", limit=budget
    ).where(F.col("start") < budget)
    room = (F.lit(budget) - F.col("start")).cast("int")
    piece = F.substring(F.col(column), F.lit(1), room)
    parts = F.transform(
        F.array_sort(F.collect_list(F.struct("doc_ord", piece.alias("piece")))), lambda p: F.hex(p["piece"])
    )
    return placed.groupBy(*KEYS).agg(F.unhex(F.array_join(parts, "")).alias("stream"))
