"""Code length under counted models, outside logits, bytes, and any batch function."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import fixed
from tidemark.functions.scoring import metric_columns
from tidemark.functions.text import seeded_start
from tidemark.operators import chunks as c
from tidemark.operators import pmf, predictors, records, units
from tidemark.operators.evaluate import evaluate
from tidemark.plans import sqltext as q
from tidemark.plans.chunk_queries import BATCH, CONTEXT, METADATA, NARROW, SLIDING, STRIDE, metadata, tokens
from tidemark.plans.registry import query
from tidemark.session import shared_folder
from tidemark.sources import corpus
from tidemark.sources.stages import materialise

KEYS = ["dataset", "month"]
CUTOFF = fixed.TEST_YEAR_START
FLOOR = fixed.PROBABILITY_FLOOR
DIGITS = {"bpb": 6, "ratio": 6, "compressed_size": 3, "bpt": 6, "bpc": 6}


# --- logits -----------------------------------------------------------------
def positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.logits(spark, sf_dir).withColumn("dataset", F.lit("logits"))


def probabilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pmf.softmax(positions(spark, sf_dir))


def cdfs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return probabilities(spark, sf_dir).withColumn("cdf", pmf.pmf_to_cdf(F.col("pmf")))


def integer_cdfs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cdfs(spark, sf_dir).withColumn("cdf", pmf.quantize_cdf(F.col("cdf")))


@query("softmax", f"""WITH {q.PMF}
SELECT chunk_id, off, round(pmf[sym + 1], 9) AS p_sym, round(list_max(pmf), 9) AS p_max,
       round(list_sum(pmf), 9) AS p_sum FROM pm""")
def softmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    return probabilities(spark, sf_dir).select(
        "chunk_id", "off",
        F.round(F.element_at("pmf", F.col("sym") + 1), 9).alias("p_sym"),
        F.round(F.array_max("pmf"), 9).alias("p_max"),
        F.round(F.aggregate("pmf", F.lit(0.0), lambda a, p: a + p), 9).alias("p_sum"),
    )


@query("restricted_softmax", f"""WITH {q.LOGITS},
few AS (SELECT chunk_id, off, sym, logits[1:10] AS l FROM lg),
e AS (SELECT chunk_id, off, sym, list_transform(l, lambda x: exp(x - list_max(l))) AS e FROM few)
SELECT chunk_id, off, sym AS sym_index, round(-log2(greatest(e[sym + 1] / list_sum(e), {FLOOR!r})), 6) AS bits FROM e""")
def restricted_softmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    allowed = list(range(10))
    few = pmf.softmax(pmf.restrict(corpus.logits(spark, sf_dir), allowed))
    indexed = few.withColumn("sym", pmf.symbol_index(F.col("sym"), allowed))
    return indexed.select(
        "chunk_id", "off", F.col("sym").alias("sym_index"), F.round(pmf.self_information(indexed), 6).alias("bits")
    )


@query("self_information", f"""WITH {q.PMF},
pred AS (SELECT *, lag(pmf) OVER (PARTITION BY chunk_id ORDER BY off) AS before FROM pm)
SELECT month, chunk_id, count(*) AS n_scored, round(sum(-log2(greatest(before[sym + 1], {FLOOR!r}))), 6) AS bits
FROM pred WHERE before IS NOT NULL GROUP BY ALL""")
def self_information(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = pmf.softmax(pmf.predicted(positions(spark, sf_dir)))
    return rows.groupBy("month", "chunk_id").agg(
        F.count("*").alias("n_scored"), F.round(F.sum(pmf.self_information(rows)), 6).alias("bits")
    )


@query("external_logits", f"""WITH {q.PMF}
SELECT s.month, count(*) AS n_scored, round(sum(-log2(greatest(p.pmf[s.sym + 1], {FLOOR!r}))), 6) AS bits
FROM pm s JOIN pm p ON p.chunk_id = s.chunk_id AND p.off + 1 = s.off GROUP BY ALL""")
def external_logits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of symbols, and scores that a model gives for their positions."""
    rows = positions(spark, sf_dir)
    toks = F.transform(F.array_sort(F.collect_list(F.struct("off", "sym"))), lambda p: p["sym"])
    windows = rows.groupBy(*pmf.CHUNK).agg(toks.alias("toks"))
    scored = pmf.softmax(pmf.predicted(rows))
    scores = scored.select(*pmf.CHUNK, "off", (-pmf.self_information(scored)).alias("log2_p"))
    return predictors.external_bits(windows, scores).select("month", "n_scored", F.round("bits", 6).alias("bits"))


@query("pmf_to_cdf", f"""WITH {q.CDF}
SELECT chunk_id, off, len(cdf)::INTEGER AS n, round(cdf[sym + 1], 9) AS low, round(cdf[sym + 2], 9) AS high,
       round(list_sum(cdf), 6) AS total FROM cd""")
def pmf_to_cdf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cdfs(spark, sf_dir).select(
        "chunk_id", "off", F.size("cdf").alias("n"),
        F.round(F.element_at("cdf", F.col("sym") + 1), 9).alias("low"),
        F.round(F.element_at("cdf", F.col("sym") + 2), 9).alias("high"),
        F.round(F.aggregate("cdf", F.lit(0.0), lambda a, x: a + x), 6).alias("total"),
    )


@query("quantized_cdf", f"""WITH {q.CDF}
SELECT chunk_id, off, list_sum(q)::BIGINT AS total, md5(array_to_string(q, ',')) AS digest FROM qc""")
def quantized_cdf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return integer_cdfs(spark, sf_dir).select(
        "chunk_id", "off",
        F.aggregate("cdf", F.lit(0).cast("bigint"), lambda a, x: a + x).alias("total"),
        F.md5(F.array_join(F.col("cdf").cast("array<string>"), ",")).alias("digest"),
    )


@query("quantized_code_length", f"""WITH {q.CDF},
b AS (SELECT month, chunk_id, -log2(((CASE WHEN sym = 63 THEN 1073741824 ELSE q[sym + 2] END) - q[sym + 1])
      / 1073741824.0::DOUBLE) AS bits FROM qc)
SELECT month, chunk_id, round(sum(bits), 6) AS bits, ceil((sum(bits) + 2) / 8)::BIGINT AS n_bytes FROM b GROUP BY ALL""")
def quantized_code_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = integer_cdfs(spark, sf_dir).withColumn("bits", pmf.quantized_bits(F.col("cdf"), F.col("sym")))
    return rows.groupBy("month", "chunk_id").agg(
        F.round(F.sum("bits"), 6).alias("bits"), pmf.coded_bytes(F.sum("bits")).alias("n_bytes")
    )


@query("cdf_range_join", f"""WITH {q.CDF},
pts AS (SELECT chunk_id, off, unnest(range(0, 4)) AS j FROM lg),
codes AS (SELECT *, {q.seeded_start("chunk_id || ':' || off || ':' || j", '1073741824')} AS point FROM pts),
ivl AS (
  SELECT chunk_id, off, unnest(range(0, 64)) AS sym, unnest(q[1:64]) AS lo,
         unnest(list_concat(q[2:64], [1073741824])) AS hi FROM qc)
SELECT chunk_id, off, j::INTEGER AS j, point, ivl.sym::INTEGER AS decoded
FROM codes JOIN ivl USING (chunk_id, off) WHERE lo <= point AND point < hi""")
def cdf_range_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    on = ["chunk_id", "off"]
    contexts = corpus.logits(spark, sf_dir).select(*on, F.explode(F.sequence(F.lit(0), F.lit(3))).alias("j"))
    key = F.concat_ws(":", *on, "j")
    points = contexts.withColumn("point", seeded_start(key, fixed.SHUFFLE_SEED, F.lit(pmf.SCALE)))
    tables = integer_cdfs(spark, sf_dir).select(*on, "cdf")
    return pmf.decode_points(tables, points, on).select(*on, "j", "point", "decoded")


# --- counted models ---------------------------------------------------------
@query("unigram_bpb", f"""WITH {q.TOKENS},
vocab AS (SELECT tok, count(*) AS c FROM pos WHERE month < '{CUTOFF}' GROUP BY tok),
model AS (SELECT sum(c) + count(*) + 1 AS size FROM vocab),
bits AS (SELECT dataset, month, count(*) AS n_tokens, sum(log2(size) - log2(coalesce(c, 0) + 1)) AS bits
         FROM pos LEFT JOIN vocab USING (tok) CROSS JOIN model GROUP BY ALL),
size AS (SELECT dataset, month, sum(strlen(text))::BIGINT AS n_bytes FROM corpus GROUP BY ALL)
SELECT dataset, month, n_tokens, n_bytes, round(bits, 3) AS bits, round(bits / n_bytes, 6) AS bpb,
       round(bits / n_tokens, 6) AS bpt FROM bits JOIN size USING (dataset, month)""")
def unigram_bpb(spark: SparkSession, sf_dir: str) -> DataFrame:
    bits = predictors.unigram_bits(units.tokenize(corpus.documents(spark, sf_dir)), CUTOFF)
    return bits.select(
        *KEYS, "n_tokens", "n_bytes", F.round("bits", 3).alias("bits"),
        F.round(F.try_divide("bits", "n_bytes"), 6).alias("bpb"),
        F.round(F.try_divide("bits", "n_tokens"), 6).alias("bpt"),
    )


@query("bigram_bpb", f"""WITH {q.TOKENS},
kept AS (SELECT dataset, month, tok, pos % {CONTEXT} AS off,
                lag(tok) OVER (PARTITION BY dataset, month, pos // {CONTEXT} ORDER BY pos) AS prev
         FROM pos JOIN total USING (dataset, month) WHERE pos // {CONTEXT} < (n - 1) // {CONTEXT}),
pairs AS (SELECT * FROM kept WHERE off >= 1),
train AS (SELECT * FROM pairs WHERE month < '{CUTOFF}'),
cp AS (SELECT prev, tok, count(*) AS c_pair FROM train GROUP BY ALL),
cv AS (SELECT prev, count(*) AS c_prev FROM train GROUP BY ALL),
ct AS (SELECT tok, count(*) AS c FROM train GROUP BY ALL),
model AS (SELECT sum(c) + count(*) + 1 AS size FROM ct)
SELECT dataset, month, count(*) AS n_scored, round(sum(-log2(greatest(
         0.5::DOUBLE * coalesce(c_pair / c_prev, 0) + 0.5::DOUBLE * (coalesce(c, 0) + 1) / size, {FLOOR!r}))), 3) AS bits
FROM pairs LEFT JOIN cp USING (prev, tok) LEFT JOIN cv USING (prev) LEFT JOIN ct USING (tok) CROSS JOIN model
GROUP BY ALL""")
def bigram_bpb(spark: SparkSession, sf_dir: str) -> DataFrame:
    bits = predictors.bigram_bits(c.fixed_chunks(tokens(spark, sf_dir), CONTEXT), CUTOFF)
    return bits.select(*KEYS, "n_scored", F.round("bits", 3).alias("bits"))


CACHE = f"""vocab AS (SELECT tok, count(*) AS c FROM pos WHERE month < '{CUTOFF}' GROUP BY tok),
model AS (SELECT sum(c) + count(*) + 1 AS size FROM vocab),
seen AS (SELECT *, row_number() OVER (PARTITION BY dataset, month, chunk_id, tok ORDER BY off) - 1 AS earlier FROM win)
SELECT dataset, month, count(*) AS n_scored, round(sum(-log2(greatest(
         0.5::DOUBLE * (coalesce(c, 0) + 1) / size + 0.5::DOUBLE * earlier / off, {FLOOR!r}))), 3) AS bits
FROM seen LEFT JOIN vocab USING (tok) CROSS JOIN model"""


@query("cache_bpb_ctx", f"""WITH {q.TOKENS},
win AS (SELECT dataset, month, pos // {CONTEXT} AS chunk_id, pos % {CONTEXT} AS off, tok
        FROM pos JOIN total USING (dataset, month) WHERE pos // {CONTEXT} < (n - 1) // {CONTEXT}),
{CACHE} WHERE off >= 1 GROUP BY ALL""")
def cache_bpb_ctx(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = tokens(spark, sf_dir)
    bits = predictors.cache_bits(c.fixed_chunks(docs, CONTEXT), predictors.vocabulary(docs, CUTOFF), CONTEXT)
    return bits.select(*KEYS, "n_scored", F.round("bits", 3).alias("bits"))


@query("cache_bpb_stride", f"""WITH {SLIDING},
{CACHE} WHERE (chunk_id // {BATCH} = 0 AND off >= 1) OR off >= {NARROW - STRIDE + 1} GROUP BY ALL""")
def cache_bpb_stride(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = tokens(spark, sf_dir)
    bits = predictors.cache_bits(
        c.sliding_chunks(docs, NARROW, STRIDE), predictors.vocabulary(docs, CUTOFF), NARROW, STRIDE, BATCH
    )
    return bits.select(*KEYS, "n_scored", F.round("bits", 3).alias("bits"))


@query("byte_entropy", f"""WITH {q.CORPUS},
b AS (SELECT dataset, month, doc_ord, unnest(h) AS byte, generate_subscripts(h, 1) AS i FROM (
        SELECT dataset, month, doc_ord, regexp_extract_all(hex(encode(text)), '..') AS h FROM corpus)),
pr AS (SELECT dataset, month, byte, coalesce(lag(byte) OVER (PARTITION BY doc_ord ORDER BY i), '-') AS prev FROM b),
k AS (SELECT dataset, month, prev, byte, count(*) AS k FROM pr GROUP BY ALL),
s AS (SELECT *, sum(k) OVER (PARTITION BY dataset, month) AS a, sum(k) OVER (PARTITION BY dataset, month, prev) AS p,
             sum(k) OVER (PARTITION BY dataset, month, byte) AS o FROM k)
SELECT dataset, month, sum(k)::BIGINT AS n_bytes, round(-sum(k * log2(o / a)) / sum(k), 6) AS order0_bpb,
       round(-sum(k * log2(k / p)) / sum(k), 6) AS order1_bpb FROM s GROUP BY ALL""")
def byte_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    bits = predictors.byte_entropy(predictors.byte_pair_counts(corpus.documents(spark, sf_dir)))
    return bits.select(
        *KEYS, "n_bytes", F.round("order0_bpb", 6).alias("order0_bpb"), F.round("order1_bpb", 6).alias("order1_bpb")
    )


@query("compression_metrics", f"""WITH {METADATA},
kept AS (SELECT dataset, month, tok FROM pos JOIN total USING (dataset, month) WHERE pos < (n - 1) // {CONTEXT} * {CONTEXT}),
vocab AS (SELECT tok, count(*) AS c FROM kept WHERE month < '{CUTOFF}' GROUP BY tok),
model AS (SELECT sum(c) + count(*) + 1 AS size FROM vocab),
bits AS (SELECT dataset, month, sum(log2(size) - log2(coalesce(c, 0) + 1)) / 8 AS sz
         FROM kept LEFT JOIN vocab USING (tok) CROSS JOIN model GROUP BY ALL),
m AS (SELECT dataset, month, sz, (n - 1) // {CONTEXT} AS batches, chars - dropped_chars AS nc, bytes - dropped_bytes AS nb
      FROM total JOIN tail USING (dataset, month) JOIN size USING (dataset, month) LEFT JOIN bits USING (dataset, month))
SELECT dataset, month, round(sz * 8 / nullif(nb, 0), 6) AS bpb, nb::BIGINT AS original_size, round(sz / nullif(nb, 0), 6) AS ratio,
       round(sz, 3) AS compressed_size, {CONTEXT} AS context_size, NULL::INTEGER AS stride,
       batches, NULL::DOUBLE AS time_used,
       round(sz * 8 / nullif(batches * {CONTEXT}, 0), 6) AS bpt, round(sz * 8 / nullif(nc, 0), 6) AS bpc FROM m""")
def compression_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All metrics of one model, from its bits over the windows and the counts of the source text."""
    docs = tokens(spark, sf_dir)
    windows = c.fixed_chunks(docs, CONTEXT).withColumn("n_bytes", F.lit(0))
    bits = predictors.unigram_bits(windows, CUTOFF).select(*KEYS, "bits")
    rows = metadata(spark, sf_dir, docs).join(bits, KEYS, "left").withColumn("time_used", F.lit(None).cast("double"))
    rows = rows.select(*KEYS, *metric_columns(F.col("bits") / 8))
    return rows.withColumns({name: F.round(name, n) for name, n in DIGITS.items()})


@query("model_records", f"""WITH {METADATA},
win AS (SELECT dataset, month, pos // {CONTEXT} AS chunk_id, pos % {CONTEXT} AS off, tok
        FROM pos JOIN total USING (dataset, month) WHERE pos // {CONTEXT} < (n - 1) // {CONTEXT}),
bits AS (WITH {CACHE.replace("round(", "(").replace(", 3) AS bits", ") AS bits")} WHERE off >= 1 GROUP BY ALL),
m AS (SELECT dataset, month, n, (n - 1) // {CONTEXT} AS batches, chars - dropped_chars AS nc, bytes - dropped_bytes AS nb,
             bits / 8 AS sz FROM total JOIN tail USING (dataset, month) JOIN size USING (dataset, month)
      LEFT JOIN bits USING (dataset, month))
SELECT dataset, month, 'cache-{CONTEXT}' AS model, round(sz * 8 / nb, 6) AS bpb, nb::BIGINT AS original_size,
       round(sz / nb, 6) AS ratio, round(sz, 3) AS compressed_size, {CONTEXT} AS context_size, NULL::INTEGER AS stride,
       batches, NULL::DOUBLE AS time_used, round(sz * 8 / nullif(batches * {CONTEXT}, 0), 6) AS bpt,
       round(sz * 8 / nc, 6) AS bpc FROM m""")
def model_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens, windows, a model's bits and the corpus counts to one record per month."""
    docs = tokens(spark, sf_dir)
    bits = predictors.cache_bits(c.fixed_chunks(docs, CONTEXT), predictors.vocabulary(docs, CUTOFF), CONTEXT)
    rows = records.model_records(bits, metadata(spark, sf_dir, docs), "models/cache")
    return rows.withColumns({name: F.round(name, n) for name, n in DIGITS.items()})


#: Which recipe each corpus of the composed run goes through; 'arxiv' is English text with section signs.
RECIPE_OF = {"en": "news", "fr": "wiki", "es": "math", "de": "code", "arxiv": "arxiv"}
UNIT_BUDGET = 3_000
FEW = {"en": fixed.NEWS_ARTICLES, "es": fixed.MATH_QUESTIONS}

MAIN = f"""WITH {q.CORPUS},
corp AS (
  SELECT dataset, month, doc_ord, text,
         row_number() OVER (PARTITION BY dataset, month ORDER BY doc_ord) AS i,
         row_number() OVER (PARTITION BY dataset, month ORDER BY {q.seeded_hash('doc_ord')}, doc_ord) AS shuffled FROM corpus
  UNION ALL SELECT 'arxiv', month, doc_ord, replace(text, chr(10), '§ '), 1, 1 FROM corpus WHERE dataset = 'en'),
ln AS (SELECT *, CASE WHEN right(text, 1) = chr(10) THEN string_split(text, chr(10))[:-2] ELSE string_split(text, chr(10)) END AS l FROM corp),
sec AS (
  SELECT *, list_transform(list_filter(list_transform(string_split_regex(replace(regexp_replace(text, '^.*?(§)', '\\1', 's'), '§.§', '§.' || chr(2)), '§\\s'),
            lambda p: replace(p, chr(2), '§')), lambda p: regexp_replace(p, '\\s+', '', 'g') <> ''),
            lambda p: regexp_replace(replace(replace(p, '<cit.>', ''), '<ref>', ''), '\\s+', ' ', 'g')) AS s FROM ln),
un AS (
  SELECT dataset, month, CASE WHEN dataset = 'de' THEN shuffled ELSE doc_ord END AS o, CASE dataset
      WHEN 'en' THEN {q.SENTENCES} WHEN 'fr' THEN ({q.SENTENCES})[1:{fixed.WIKI_SENTENCES}] WHEN 'es' THEN [text]
      WHEN 'arxiv' THEN s[1:{fixed.ARXIV_SECTIONS}]
      ELSE [array_to_string(CASE WHEN len(l) > {fixed.CODE_LINES}
        THEN l[{q.seeded_start('doc_ord', f'len(l) - {fixed.CODE_LINES}')} + 1:{q.seeded_start('doc_ord', f'len(l) - {fixed.CODE_LINES}')} + {fixed.CODE_LINES}]
        ELSE l END, chr(10))] END AS u
  FROM sec WHERE i <= CASE dataset {" ".join(f"WHEN '{d}' THEN {n}" for d, n in FEW.items())} ELSE i END),
unit AS (
  SELECT *, sum(strlen(text)) OVER (PARTITION BY dataset, month ORDER BY o, k) AS upto
  FROM (SELECT dataset, month, o, unnest(u) AS text, generate_subscripts(u, 1) AS k FROM un)),
docs AS (
  SELECT dataset, month, text, {q.words('text')} AS toks, row_number() OVER (PARTITION BY dataset, month ORDER BY o, k) AS i,
         CASE WHEN dataset = 'de' THEN '' ELSE ' ' END AS gap
  FROM unit WHERE upto <= {UNIT_BUDGET}),
pos AS (
  SELECT dataset, month, tok, row_number() OVER (PARTITION BY dataset, month ORDER BY i, j) - 1 AS pos
  FROM (SELECT dataset, month, i, unnest(toks) AS tok, generate_subscripts(toks, 1) AS j FROM docs)),
total AS (SELECT dataset, month, count(*) AS n, (count(*) - 1) // {CONTEXT} * {CONTEXT} AS cut FROM pos GROUP BY ALL),
placed AS (
  SELECT docs.*, cut, sum(len(toks)) OVER (PARTITION BY dataset, month ORDER BY i) - len(toks) AS start FROM docs JOIN total USING (dataset, month)),
tail AS (
  SELECT dataset, month, string_agg(CASE WHEN i = 1 THEN '' ELSE gap END || text, '' ORDER BY i) AS stream, string_agg(CASE
    WHEN start >= cut THEN CASE WHEN i = 1 THEN '' ELSE gap END || text
    WHEN start + len(toks) >= cut THEN substr(text, 1 + list_sum(list_transform(
      list_zip(regexp_split_to_array({q.lowered('text')}, {q.literal(q.WORDS)})[1:cut - start], toks[1:cut - start]),
      lambda p: length(p[1]) + length(p[2])))::BIGINT) ELSE '' END, '' ORDER BY i) AS lost
  FROM placed GROUP BY ALL),
kept AS (SELECT dataset, month, tok FROM pos JOIN total USING (dataset, month) WHERE pos < cut),
vocab AS (SELECT dataset, tok, count(*) AS c FROM kept WHERE month < '{CUTOFF}' GROUP BY ALL),
model AS (SELECT dataset, sum(c) + count(*) + 1 AS size FROM vocab GROUP BY ALL),
bits AS (
  SELECT dataset, month, sum(log2(size) - log2(coalesce(c, 0) + 1)) / 8 AS sz
  FROM kept JOIN model USING (dataset) LEFT JOIN vocab USING (dataset, tok) GROUP BY ALL),
m AS (
  SELECT dataset, month, sz, cut // {CONTEXT} AS batches, length(stream) - length(lost) AS nc, strlen(stream) - strlen(lost) AS nb
  FROM total JOIN tail USING (dataset, month) LEFT JOIN bits USING (dataset, month))
SELECT dataset, month, 'unigram-{CONTEXT}' AS model, round(sz * 8 / nullif(nb, 0), 6) AS bpb, nb::BIGINT AS original_size,
       round(sz / nullif(nb, 0), 6) AS ratio, round(sz, 3) AS compressed_size, {CONTEXT} AS context_size, NULL::INTEGER AS stride,
       batches, NULL::DOUBLE AS time_used, round(sz * 8 / nullif(batches * {CONTEXT}, 0), 6) AS bpt,
       round(sz * 8 / nullif(nc, 0), 6) AS bpc FROM m"""


@query("main_pipeline", MAIN)
def main_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five corpora, each scanned by itself from a table partitioned by dataset and month, through recipes to records."""
    docs = corpus.documents(spark, sf_dir)
    papers = docs.where(F.col("dataset") == "en").withColumns({"dataset": F.lit("arxiv"), "text": F.replace("text", F.lit("\n"), F.lit("§ "))})
    path = shared_folder(spark, "corpus")
    corpus.write_corpus(docs.unionByName(papers), path)

    def bits(windows: DataFrame) -> DataFrame:
        return predictors.unigram_bits(windows.withColumn("n_bytes", F.lit(0)), CUTOFF).select(*KEYS, "bits")

    scans = {d: corpus.read_corpus(spark, path, d, fixed.FIRST_MONTH, fixed.LAST_MONTH) for d in RECIPE_OF}
    # Records are one row per month.  Each corpus is finished by itself, so no plan holds the steps of all five.
    records_of = (evaluate(scans[d], recipe, bits, "owner/unigram", CONTEXT, budget=UNIT_BUDGET) for d, recipe in RECIPE_OF.items())
    rows = reduce(DataFrame.unionByName, [materialise(rows, "records") for rows in records_of])
    return rows.withColumns({name: F.round(name, n) for name, n in DIGITS.items()})


@query("byte_records", f"""WITH {METADATA},
b AS (SELECT dataset, month, list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda h: ('0x' || h)::INTEGER) AS v FROM corpus),
p AS (SELECT dataset, month, unnest(list_prepend(-1, v[:-2])) AS prev, unnest(v) AS byte FROM b WHERE len(v) > 0),
k AS (SELECT dataset, month, prev, byte, count(*) AS k FROM p GROUP BY ALL),
s AS (SELECT dataset, month, -sum(k * log2(k / n)) / 8 AS sz
      FROM (SELECT *, sum(k) OVER (PARTITION BY dataset, month, prev) AS n FROM k) GROUP BY ALL),
m AS (SELECT dataset, month, sz, n AS tokens, (n - 1) // {CONTEXT} AS batches, chars - dropped_chars AS nc, bytes - dropped_bytes AS nb
      FROM total JOIN tail USING (dataset, month) JOIN size USING (dataset, month) JOIN s USING (dataset, month))
SELECT dataset, month, 'bytes-order1' AS model, round(sz * 8 / nullif(nb, 0), 6) AS bpb, nb::BIGINT AS original_size,
       round(sz / nullif(nb, 0), 6) AS ratio, round(sz, 3) AS compressed_size, NULL::INTEGER AS context_size,
       NULL::INTEGER AS stride, batches, NULL::DOUBLE AS time_used,
       round(sz * 8 / nullif(batches * {CONTEXT}, 0), 6) AS bpt, round(sz * 8 / nullif(nc, 0), 6) AS bpc FROM m""")
def byte_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The baseline's record of each month: code length of all bytes, given the byte before, over the corpus counts."""
    pairs = predictors.byte_pair_counts(corpus.documents(spark, sf_dir))
    sizes = predictors.byte_code_length(pairs).withColumn("model", F.lit("bytes-order1"))
    rows = records.baseline_records(sizes, metadata(spark, sf_dir, tokens(spark, sf_dir)))
    return rows.withColumns({name: F.round(name, n) for name, n in DIGITS.items()})


# --- batch functions ----------------------------------------------------------
@query("udf_predictor", f"""WITH {q.TOKENS},
k AS (SELECT dataset, month, pos // {CONTEXT} AS chunk_id, tok, count(*) AS k FROM pos JOIN total USING (dataset, month)
      WHERE pos // {CONTEXT} < (n - 1) // {CONTEXT} GROUP BY ALL)
SELECT dataset, month, count(DISTINCT chunk_id) AS n_chunks, round(sum(-k * log2(k / {CONTEXT})), 3) AS bits
FROM k GROUP BY ALL""")
def udf_predictor(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = c.fixed_chunks(tokens(spark, sf_dir), CONTEXT)
    bits = predictors.batch_predictor_bits(cut, predictors.window_entropy_bits)
    return bits.groupBy(*KEYS).agg(F.count("*").alias("n_chunks"), F.round(F.sum("bits"), 3).alias("bits"))
