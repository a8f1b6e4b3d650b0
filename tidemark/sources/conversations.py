"""conversations.parquet as questions, references, candidate answers and judge texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import text
from tidemark.operators.qa import zip_tables
from tidemark.sources.corpus import month_slot

def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/conversations.parquet")


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    users = _turns(spark, sf_dir).where(F.col("role") == "user")
    return users.select("conv_id", F.col("turn").alias("idx"), F.col("text").alias("question"))


def references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First word of the reply that follows a question."""
    replies = _turns(spark, sf_dir).where(F.col("role") == "assistant")
    return replies.select(
        "conv_id", (F.col("turn") - 1).alias("idx"), F.substring_index("text", " ", 1).alias("ref_answer")
    )


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sentences of the reply that follows a question, all of them, in order."""
    replies = _turns(spark, sf_dir).where(F.col("role") == "assistant")
    return replies.select("conv_id", (F.col("turn") - 1).alias("idx"), text.sentences(F.col("text")).alias("out"))


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answered questions: every question with a reference, its candidates and judge texts."""
    zipped = zip_tables(
        [questions(spark, sf_dir), references(spark, sf_dir), candidates(spark, sf_dir)], ["conv_id", "idx"]
    )
    return zipped.select(month_slot(F.col("conv_id")).alias("month"), "*", F.col("out").alias("judges"))
