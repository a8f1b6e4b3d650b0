"""Monthly corpora: a table of texts keyed by (dataset, month), in document order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import fixed
from tidemark.functions.periods import month_of, shift_months

KEYS = ["dataset", "month"]


def write_corpus(corpus: DataFrame, path: str, mode: str = "overwrite") -> None:
    """One folder per (dataset, month), so that a scan of some months reads only those.

    Rows are spread over the document order too: a hot month is written by many
    tasks, and each file covers a narrow range of documents.
    """
    spread = corpus.repartitionByRange(*KEYS, "doc_ord")
    spread.write.mode(mode).partitionBy(*KEYS).parquet(path)


def read_corpus(
    spark: SparkSession, path: str, dataset: str | None = None,
    first: str | None = None, last: str | None = None,
) -> DataFrame:
    """Scan a corpus table; the filters are on partition columns and prune folders."""
    df = spark.read.option("mergeSchema", "false").parquet(path)
    if dataset is not None:
        df = df.where(F.col("dataset") == dataset)
    if first is not None:
        df = df.where(F.col("month") >= first)
    if last is not None:
        df = df.where(F.col("month") <= last)
    return df


def catalog(spark: SparkSession, root: str = "corpora") -> DataFrame:
    """The seven datasets with their modality and recipe: a fixed table of seven rows."""
    rows = [(name, modality, recipe, f"{root}/{name}") for name, modality, recipe in fixed.DATASETS]
    return spark.createDataFrame(rows, "dataset string, modality string, recipe string, path string")


def read_table(spark: SparkSession, path: str, key: str, *columns: str) -> DataFrame:
    """Columns of a parquet table; a lone file is hash-spread over the cores.

    A small file is otherwise read, and tokenized, by one task.  A folder of files is
    left alone, so a large corpus is never shuffled for this.
    """
    df = spark.read.parquet(path).select(*columns)
    if len(df.inputFiles()) != 1:
        return df
    return df.repartition(spark.sparkContext.defaultParallelism, key)


# --- corpora made from the given tables -------------------------------------
def month_slot(ordinal: Column) -> Column:
    """Spread documents over the 83 months from 2017-01 to 2023-11."""
    day = F.add_months(F.to_date(F.lit(fixed.FIRST_MONTH + "-01")), F.pmod(ordinal, F.lit(83)).cast("int"))
    return month_of(day)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents.parquet as a corpus: language is the dataset, doc_id the order."""
    docs = read_table(spark, f"{sf_dir}/documents.parquet", "doc_id", "doc_id", "lang", "text")
    return docs.select(
        F.col("lang").alias("dataset"),
        month_slot(F.col("doc_id")).alias("month"),
        F.col("doc_id").alias("doc_ord"),
        "text",
    )


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pages.parquet as a byte corpus."""
    raw = read_table(spark, f"{sf_dir}/pages.parquet", "page_id", "page_id", "html")
    return raw.select(
        F.lit("audio").alias("dataset"),
        month_slot(F.col("page_id")).alias("month"),
        F.col("page_id").alias("doc_ord"),
        F.encode(F.col("html"), "UTF-8").alias("audio"),
    )


def images(spark: SparkSession, sf_dir: str, width: int = 8) -> DataFrame:
    """embeddings.parquet as 8 x 8 grey images, row-major."""
    raw = read_table(spark, f"{sf_dir}/embeddings.parquet", "vec_id", "vec_id", "embedding")
    return raw.select(
        F.lit("bbc_image").alias("dataset"),
        month_slot(F.col("vec_id")).alias("month"),
        F.col("vec_id").alias("doc_ord"),
        F.lit(width).alias("width"),
        F.col("embedding").alias("pixels"),
    )


def logits(spark: SparkSession, sf_dir: str, chunk: int = 16) -> DataFrame:
    """embeddings.parquet as model output: 64 logits per position, label = observed symbol."""
    raw = read_table(spark, f"{sf_dir}/embeddings.parquet", "vec_id", "vec_id", "embedding", "label")
    return raw.select(
        month_slot(F.floor(F.col("vec_id") / chunk)).alias("month"),
        F.floor(F.col("vec_id") / chunk).alias("chunk_id"),
        F.pmod(F.col("vec_id"), F.lit(chunk)).cast("int").alias("off"),
        F.transform("embedding", lambda x: x.cast("double")).alias("logits"),
        F.col("label").alias("sym"),
    )


def ship_month(date: Column) -> Column:
    """Ship dates 1995-01 ... 2001-11 moved to 2017-01 ... 2023-11."""
    return month_of(shift_months(date, 264))
