"""Windows over token streams, and the counts that metrics divide by."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import chunks as c
from tidemark.operators.units import token_cache
from tidemark.plans import sqltext as q
from tidemark.plans.registry import query
from tidemark.sources import corpus

KEYS = ["dataset", "month"]
CONTEXT, NARROW, STRIDE, BATCH = 256, 64, 16, 4


def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_cache(corpus.documents(spark, sf_dir))


def digests(chunks: DataFrame) -> DataFrame:
    return chunks.select(
        *KEYS, "chunk_id", F.size("toks").alias("n_toks"), F.md5(F.array_join("toks", " ")).alias("digest")
    )


@query("fixed_chunks", f"""WITH {q.TOKENS}
SELECT dataset, month, pos // {CONTEXT} AS chunk_id, count(*)::INTEGER AS n_toks,
       md5(string_agg(tok, ' ' ORDER BY pos)) AS digest
FROM pos JOIN total USING (dataset, month) WHERE pos // {CONTEXT} < (n - 1) // {CONTEXT} GROUP BY ALL""")
def fixed_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(c.fixed_chunks(tokens(spark, sf_dir), CONTEXT))


@query("bos_chunks", f"""WITH {q.TOKENS}
SELECT dataset, month, pos // {CONTEXT} AS chunk_id, count(*)::INTEGER + 1 AS n_toks,
       md5('<s> ' || string_agg(tok, ' ' ORDER BY pos)) AS digest
FROM pos JOIN total USING (dataset, month)
WHERE pos // {CONTEXT} < (n - 1) // {CONTEXT} AND pos % {CONTEXT} < {CONTEXT - 1} GROUP BY ALL""")
def bos_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(c.fixed_chunks(tokens(spark, sf_dir), CONTEXT, bos="<s>"))


SLIDING = f"""{q.TOKENS},
cover AS (
  SELECT *, unnest(range(greatest(0, (pos - {NARROW} + {STRIDE}) // {STRIDE}), pos // {STRIDE} + 1)) AS chunk_id
  FROM (SELECT * FROM pos WHERE pos >= {NARROW}) UNION ALL
  SELECT *, unnest(range(0, pos // {STRIDE} + 1)) AS chunk_id FROM (SELECT * FROM pos WHERE pos < {NARROW})),
win AS (
  SELECT dataset, month, chunk_id, pos - chunk_id * {STRIDE} AS off, tok FROM cover JOIN total USING (dataset, month)
  WHERE chunk_id * {STRIDE} + {NARROW} <= n AND pos - chunk_id * {STRIDE} < {NARROW})"""


@query("sliding_chunks", f"""WITH {SLIDING}
SELECT dataset, month, chunk_id, count(*)::INTEGER AS n_toks, md5(string_agg(tok, ' ' ORDER BY off)) AS digest
FROM win GROUP BY ALL""")
def sliding_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(c.sliding_chunks(tokens(spark, sf_dir), NARROW, STRIDE))


@query("stride_scoring", f"""WITH {SLIDING}
SELECT dataset, month, count(*) AS n_scored, count(*) FILTER (chunk_id // {BATCH} = 0) AS n_first_batch
FROM win WHERE (chunk_id // {BATCH} = 0 AND off >= 1) OR off >= {NARROW - STRIDE + 1} GROUP BY ALL""")
def stride_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = c.explode_chunks(c.sliding_chunks(tokens(spark, sf_dir), NARROW, STRIDE))
    kept = rows.where(c.scored(F.col("off"), F.col("chunk_id"), NARROW, STRIDE, BATCH))
    return kept.groupBy(*KEYS).agg(
        F.count("*").alias("n_scored"),
        F.count_if(c.batch_of(F.col("chunk_id"), BATCH) == 0).alias("n_first_batch"),
    )


@query("batch_ids", f"""WITH {q.TOKENS},
ch AS (SELECT DISTINCT dataset, month, pos // {NARROW} AS chunk_id FROM pos JOIN total USING (dataset, month)
       WHERE pos // {NARROW} < (n - 1) // {NARROW})
SELECT dataset, month, batch_id, count(*) AS n_chunks, min(chunk_id) AS first_chunk FROM (
  SELECT *, (row_number() OVER (PARTITION BY dataset, month ORDER BY chunk_id) - 1) // {BATCH} AS batch_id FROM ch)
GROUP BY ALL""")
def batch_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = c.fixed_chunks(tokens(spark, sf_dir), NARROW)
    return cut.groupBy(*KEYS, c.batch_of(F.col("chunk_id"), BATCH).alias("batch_id")).agg(
        F.count("*").alias("n_chunks"), F.min("chunk_id").alias("first_chunk")
    )


METADATA = f"""{q.TOKENS},
placed AS (
  SELECT dataset, month, text, toks, n, (n - 1) // {CONTEXT} * {CONTEXT} AS cut,
         sum(len(toks)) OVER (PARTITION BY dataset, month ORDER BY doc_ord) - len(toks) AS start,
         row_number() OVER (PARTITION BY dataset, month ORDER BY doc_ord) AS i
  FROM docs JOIN total USING (dataset, month)),
behind AS (
  SELECT *, CASE
    WHEN start >= cut THEN CASE WHEN i = 1 THEN '' ELSE ' ' END || text
    WHEN start + len(toks) >= cut THEN substr(text, 1 + list_sum(list_transform(
      list_zip(regexp_split_to_array({q.lowered('text')}, {q.literal(q.WORDS)})[1:cut - start], toks[1:cut - start]),
      lambda p: length(p[1]) + length(p[2])))::BIGINT)
    ELSE '' END AS lost FROM placed),
tail AS (
  SELECT dataset, month, string_agg(lost, '' ORDER BY i) AS lost, length(string_agg(lost, '' ORDER BY i)) AS dropped_chars,
         strlen(string_agg(lost, '' ORDER BY i)) AS dropped_bytes FROM behind GROUP BY ALL),
size AS (
  SELECT dataset, month, sum(length(text)) + count(*) - 1 AS chars, sum(strlen(text)) + count(*) - 1 AS bytes
  FROM corpus GROUP BY ALL)"""


def metadata(spark: SparkSession, sf_dir: str, docs: DataFrame) -> DataFrame:
    return c.text_metadata(docs, corpus.documents(spark, sf_dir), CONTEXT)


@query("text_metadata", f"""WITH {METADATA}
SELECT dataset, month, n AS n_stream, {CONTEXT} AS context_size, NULL::INTEGER AS stride,
       (n - 1) // {CONTEXT} AS num_chunks, (n - 1) // {CONTEXT} * {CONTEXT} AS num_tokens,
       (chars - dropped_chars)::BIGINT AS num_chars, (bytes - dropped_bytes)::BIGINT AS num_bytes
FROM total JOIN tail USING (dataset, month) JOIN size USING (dataset, month)""")
def text_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metadata(spark, sf_dir, tokens(spark, sf_dir)).drop("dropped_chars", "dropped_bytes")


@query("dropped_tail", f"""WITH {METADATA}
SELECT dataset, month, n - (n - 1) // {CONTEXT} * {CONTEXT} AS dropped_tokens, dropped_chars, dropped_bytes
FROM total JOIN tail USING (dataset, month)""")
def dropped_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    tail = c.dropped_tail(tokens(spark, sf_dir), corpus.documents(spark, sf_dir), CONTEXT)
    return tail.select(*KEYS, "dropped_tokens", "dropped_chars", "dropped_bytes")


@query("byte_metadata", f"""WITH n AS (
  SELECT {q.month_slot('page_id')} AS month, least(sum(strlen(html)), 1048576)::BIGINT AS n_stream FROM pages GROUP BY ALL)
SELECT month, 'fixed' AS mode, n_stream, (n_stream - 1) // 2048 AS num_chunks,
       (n_stream - 1) // 2048 * 2048 AS num_bytes, n_stream - (n_stream - 1) // 2048 * 2048 AS bytes_dropped FROM n
UNION ALL
SELECT month, 'sliding', n_stream, k, k * 2048,
       n_stream - CASE WHEN k = 0 THEN 0 ELSE (k - 1) * 512 + 2048 END FROM (
  SELECT *, CASE WHEN n_stream < 2048 THEN 0 ELSE (n_stream - 2048) // 512 + 1 END AS k FROM n)""")
def byte_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = corpus.pages(spark, sf_dir).select(*KEYS, F.octet_length("audio").alias("n_bytes"))
    modes = {"fixed": c.byte_metadata(sizes), "sliding": c.byte_metadata(sizes, stride=512)}
    fixed, sliding = (df.withColumn("mode", F.lit(name)) for name, df in modes.items())
    return fixed.unionByName(sliding).select("month", "mode", "n_stream", "num_chunks", "num_bytes", "bytes_dropped")
