"""Stage tables: one parquet table per stage and month, and what is still to do."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.session import shared_folder, table_or_none

STAGES = ["questions", "filtered", "answers", "scored"]


def write_stage(df: DataFrame, root: str, stage: str, key: str = "month") -> None:
    """Replace only the months that `df` holds; other months of the stage stay."""
    if stage not in STAGES and not stage.startswith("tokens"):
        raise ValueError(f"unknown stage {stage}")
    (
        df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        .partitionBy(key).parquet(f"{root}/{stage}")
    )


def read_stage(spark: SparkSession, root: str, stage: str) -> DataFrame:
    return spark.read.parquet(f"{root}/{stage}")


def content_key(df: DataFrame, *more: str) -> str:
    """Fingerprint of all rows of `df`, whatever their order, and of how they will be worked on (`more`).

    A count and two sums of row hashes: one pass that moves no row.
    """
    rows = [F.xxhash64(F.lit(salt), *df.columns).cast("decimal(20,0)") for salt in (1, 2)]
    found = df.agg(F.count(F.lit(1)), *(F.coalesce(F.sum(r), F.lit(0)) for r in rows)).first()
    text = "|".join([*map(str, found), ",".join(f"{n}:{t}" for n, t in df.dtypes), *more])
    return hashlib.sha256(text.encode()).hexdigest()


def materialise(df: DataFrame, purpose: str, path: str | None = None, key: str | None = None) -> DataFrame:
    """Write a table to the shared folder now and go on from the written one.

    For a table that several branches of a plan read, such as a trained model: it is
    computed once, survives the loss of executors, and its size is known when the
    branches are planned, so a small one is broadcast and a large one is not.  With `path`, a table that was written
    there for the same `key` is read as it is: a manifest beside the tables names the finished ones and their keys, so
    what was made from something else, or was cut off, is never found.
    """
    spark = df.sparkSession
    if path is None:
        target = shared_folder(spark, purpose)
        df.write.mode("overwrite").parquet(target)
        return spark.read.schema(df.schema).parquet(target)
    key = key or content_key(df)
    manifest = table_or_none(spark, f"{path}/manifest")
    target = f"{path}/{key}"
    if manifest is None or manifest.where(F.col("key") == key).isEmpty():
        df.write.mode("overwrite").parquet(target)
        spark.range(1).select(F.lit(key).alias("key"), F.lit(purpose).alias("purpose")).write.mode("append").parquet(f"{path}/manifest")
    return spark.read.schema(df.schema).parquet(target)


def todo(wanted: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of `wanted` whose key has no row in `done`.

    `done` is reduced to its distinct keys first, so a key with many done rows is
    one row in the join.
    """
    return wanted.join(done.select(*keys).distinct(), keys, "left_anti")


def request_file(requests: DataFrame, path: str) -> None:
    """JSON lines, one request per line."""
    body = F.to_json(F.struct("custom_id", "method", "url", "body"))
    requests.select(body.alias("value")).write.mode("overwrite").text(path)
