"""Exact dedup with streaming state.

Documents arrive as a stream of (digest, doc_id, locator).  The state, kept on disk by the RocksDB state store, holds
for each digest the smallest doc_id, the locator of that document's content, and a count.  It never expires: a
document is compared with all that ever came.  Where a digest is hit, the full bytes of the document are compared
with those found through the locator, so equal digests alone never drop a document.
"""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.store import folder, written

_STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "256",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",  # else each small state reserves megabytes
}


def normalised(text: Column) -> Column:
    """Each run of ASCII white space becomes one space; null is empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


@contextmanager
def _settings(spark: SparkSession, values: dict[str, str]):
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def stream_first(arrivals: DataFrame, state: str, out: str) -> None:
    """Run the stream `arrivals` (digest, doc_id, locator) against the state at `state`; append changed keys to `out`.

    Both folders go on from earlier runs: a later call with the same folders sees all earlier documents.
    """
    spark = arrivals.sparkSession
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "locator"))
    keyed = arrivals.groupBy("digest").agg(first.alias("first"), F.count(F.lit(1)).alias("n"))

    def append(changed: DataFrame, batch: int) -> None:
        changed.write.mode("overwrite").parquet(f"{out}/batch={batch}")  # a batch that runs again replaces its rows

    with _settings(spark, _STATE):
        query = (
            keyed.writeStream.outputMode("update")
            .foreachBatch(append)
            .option("checkpointLocation", state)
            .trigger(availableNow=True)
            .start()
        )
        query.awaitTermination()


def latest(spark: SparkSession, out: str) -> DataFrame:
    """The state's last word on each digest: smallest doc_id, its locator, number of documents."""
    changes = spark.read.schema(
        "digest binary, first struct<no_id:boolean,doc_id:bigint,locator:bigint>, n bigint"
    ).parquet(f"{out}/batch=*")
    kept = changes.groupBy("digest").agg(F.min("first").alias("first"), F.max("n").alias("n"))
    return kept.select("digest", F.col("first.doc_id").alias("keep_id"), F.col("first.locator").alias("keep_at"), "n")


def dedup_exact(docs: DataFrame, digest=sha256, files_per_batch: int | None = None, copies: bool = False) -> DataFrame:
    """Equal texts, white space aside: doc_id, keep_id, group_size, kept, text_sha256; one row per row of `docs`.

    docs: doc_id, text; other columns are ignored.  Null text equals empty text.  The row with the smallest doc_id
    stays; a null doc_id is larger than all others, and a group of such rows only has a null keep_id.  Of rows that
    repeat the smallest doc_id with an equal text the first is kept; `copies` adds a column `copy`, 1 for the others.
    `digest` maps a text column to the key of the state; `files_per_batch` splits the stream and changes no result.
    """
    spark = docs.sparkSession
    text = docs.select("doc_id", normalised(F.col("text")).alias("body"))
    digests = text.select("doc_id", digest(F.col("body")).alias("digest"), sha256(F.col("body")).alias("sha"))
    arrivals = written(digests.withColumns({"locator": F.xxhash64("doc_id", "sha"), "row": F.monotonically_increasing_id()}), "digests")
    path = arrivals.inputFiles()[0].rsplit("/", 1)[0] if arrivals.inputFiles() else None
    if path is None:
        none = digests.select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("n"), "sha", F.lit(0).alias("copy"))
        return _marked(none, copies)
    out = folder(spark, "first")
    reader = spark.readStream.schema(arrivals.schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    stream_first(reader.parquet(path).select("digest", "doc_id", "locator"), folder(spark, "state"), out)
    groups = written(latest(spark, out), "groups")
    hits = groups.where("n > 1").select("digest", "keep_id", "keep_at", "n")

    # Full bytes: each document of a digest that was hit against the content at the locator.
    member = text.select("doc_id", "body", digest(F.col("body")).alias("digest"))
    member = written(member.join(hits.drop("keep_id"), "digest"), "hits")
    content = member.where(F.xxhash64("doc_id", sha256(F.col("body"))) == F.col("keep_at"))
    content = content.groupBy("digest").agg(F.min("body").alias("content"))
    unequal = written(
        member.join(content, "digest").where(F.col("body") != F.col("content")).select("digest").distinct(), "unequal"
    )
    rows = arrivals.join(groups.select("digest", "keep_id", "n"), "digest")
    # Rows that repeat the doc_id that stays, null equal to null: one of them is kept.
    again = arrivals.join(hits.select("digest", "keep_id"), "digest").where(F.col("doc_id").eqNullSafe(F.col("keep_id")))
    again = again.groupBy("digest").agg(F.min("row").alias("keep_row"), F.count(F.lit(1)).alias("same"))
    again = written(again.where("same > 1").select("digest", "keep_row"), "again")
    rows = rows.withColumn("keep_row", F.col("row")) if again.isEmpty() else rows.join(again, "digest", "left")
    if unequal.isEmpty():
        sure, apart = rows, None
    else:
        # A digest with several texts: its documents are grouped by their full text.
        sure = rows.join(unequal, "digest", "left_anti")
        mixed = text.withColumn("digest", digest(F.col("body"))).join(unequal, "digest", "left_semi")
        mixed = written(mixed.withColumn("row", F.monotonically_increasing_id()), "mixed")
        first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row")).alias("first")
        texts = mixed.groupBy("body").agg(first, F.count(F.lit(1)).alias("n"))
        texts = texts.select("body", "n", F.col("first.doc_id").alias("keep_id"), F.col("first.row").alias("keep_row"))
        apart = mixed.join(texts, "body").select("doc_id", "keep_id", "n", sha256(F.col("body")).alias("sha"), "row", "keep_row")
    sure = sure.select("doc_id", "keep_id", "n", "sha", "row", "keep_row")
    all_rows = sure if apart is None else sure.unionByName(apart)
    copy = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("row") != F.coalesce("keep_row", "row"))
    return _marked(all_rows.withColumn("copy", copy.cast("int")), copies)


def _marked(rows: DataFrame, copies: bool) -> DataFrame:
    return rows.select(
        "doc_id",
        "keep_id",
        F.col("n").alias("group_size"),
        (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 0)).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
        *(["copy"] if copies else []),
    )


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_exact(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP10_SQL = r"""
WITH t AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS body FROM documents
), g AS (SELECT body, min(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY body)
SELECT t.doc_id, g.keep_id, g.group_size, t.doc_id = g.keep_id AS kept, t.text_sha256 FROM t JOIN g USING (body)
"""
