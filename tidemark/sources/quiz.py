"""documents.parquet as articles, and stand-ins for what a model wrote about them.

Generated text is input of this library.  Here it is taken from the documents: every
third response is plain text that is no JSON, some questions hold a second ': ', and
verdicts are plain words or a whole text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import text
from tidemark.sources import corpus

KEYS = ["dataset", "month"]
PAIRS = 2


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = corpus.documents(spark, sf_dir)
    day = F.lpad((F.col("doc_ord") % 28 + 1).cast("string"), 2, "0")
    return docs.select(
        *KEYS, "doc_ord",
        F.substring_index("text", " ", 3).alias("title"),
        F.concat_ws("-", "month", day).alias("published_date"),
        F.substring_index("text", ".", 1).alias("description"),
        F.col("text").alias("content"),
        F.concat(F.lit("/articles/"), F.col("doc_ord").cast("string")).alias("link"),
    )


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One model text per article: a JSON list of pairs, or the bare text of the article."""
    docs = corpus.documents(spark, sf_dir)
    ends = F.element_at(text.sentences(F.col("text")), 1)

    def pair(i: int) -> F.Column:
        word = F.regexp_extract(F.col("text"), "([A-Za-z]+)", 1)
        lead = F.when(F.col("doc_ord") % 7 == i, F.lit("Which: ")).otherwise(F.lit(""))
        asked = F.concat(lead, F.lit(f"What follows {i} "), word, F.lit("?"))
        return F.struct(asked.alias("question"), F.coalesce(ends, F.lit("")).alias("answer"))

    listed = F.to_json(F.array(*[pair(i) for i in range(PAIRS)]))
    body = F.when(F.col("doc_ord") % 3 == 0, F.concat(F.lit("Sure, here are the pairs: "), "text")).otherwise(listed)
    return docs.select(*KEYS, "doc_ord", body.alias("response_text"))


def verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One verdict text per pair of each article."""
    docs = corpus.documents(spark, sf_dir)
    rows = docs.select(*KEYS, "doc_ord", "text", F.explode(F.sequence(F.lit(0), F.lit(PAIRS - 1))).alias("qa_ord"))
    slot = (F.col("doc_ord") + F.col("qa_ord")) % 5
    said = (
        F.when(slot == 0, "No, it is not.").when(slot == 1, "Not sure").when(slot == 2, F.col("text"))
        .otherwise("Yes")
    )
    return rows.select(*KEYS, "doc_ord", "qa_ord", said.alias("verdict_text"))
