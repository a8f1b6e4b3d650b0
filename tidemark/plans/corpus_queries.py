"""Corpus scans, units, tokens and samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import fixed, periods, text
from tidemark.operators import units
from tidemark.operators.pmf import symbol_index
from tidemark.operators.predictors import byte_pair_counts
from tidemark.operators.sampling import byte_slices, patches
from tidemark.plans import sqltext as q
from tidemark.plans.registry import query
from tidemark.sources import binary, corpus

KEYS = ["dataset", "month"]
LANGUAGE_DATASETS = {"en": "bbc_news", "fr": "wikitext", "de": "code", "es": "arxiv"}


def digest(words: str | F.Column, sep: str = " ") -> F.Column:
    return F.md5(F.array_join(words, sep))


@query("corpus_scan", f"""WITH {q.CORPUS}
SELECT dataset, month, count(*) AS n_docs, sum(strlen(text))::BIGINT AS n_bytes, max(doc_ord) AS last_doc
FROM corpus WHERE month BETWEEN '2017-01' AND '2023-11' GROUP BY ALL""")
def corpus_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = corpus.documents(spark, sf_dir).where(F.col("month").between(fixed.FIRST_MONTH, fixed.LAST_MONTH))
    return docs.groupBy(*KEYS).agg(
        F.count("*").alias("n_docs"), F.sum(F.octet_length("text")).alias("n_bytes"),
        F.max("doc_ord").alias("last_doc"),
    )


@query("month_spine", f"""WITH {q.CORPUS},
n AS (SELECT dataset, month, count(*) AS n_docs FROM corpus GROUP BY ALL),
bounds AS (SELECT dataset, min(month) AS a, max(month) AS b FROM n GROUP BY ALL),
spine AS (SELECT dataset, strftime(unnest(generate_series((a || '-01')::DATE, (b || '-01')::DATE, INTERVAL 1 MONTH)), '%Y-%m') AS month FROM bounds)
SELECT s.dataset, s.month, coalesce(n_docs, 0) AS n_docs FROM spine s LEFT JOIN n USING (dataset, month)""")
def month_spine(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = corpus.documents(spark, sf_dir).groupBy(*KEYS).agg(F.count("*").alias("n_docs"))
    bounds = n.groupBy("dataset").agg(F.min("month").alias("start"), F.max("month").alias("end"))
    return periods.spine(bounds).join(n, KEYS, "left").select(*KEYS, F.coalesce("n_docs", F.lit(0)).alias("n_docs"))


@query("dataset_catalog", f"""WITH cat(dataset, modality, recipe) AS (
  VALUES {', '.join(str(row) for row in fixed.DATASETS)}),
n AS (SELECT CASE lang {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in LANGUAGE_DATASETS.items())} END AS dataset,
             count(*) AS n_docs FROM documents GROUP BY ALL)
SELECT dataset, modality, recipe, 'corpora/' || dataset AS path, coalesce(n_docs, 0) AS n_docs
FROM cat LEFT JOIN n USING (dataset)""")
def dataset_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.create_map(*[F.lit(x) for pair in LANGUAGE_DATASETS.items() for x in pair])
    n = corpus.documents(spark, sf_dir).groupBy(names[F.col("dataset")].alias("dataset")).agg(
        F.count("*").alias("n_docs")
    )
    return corpus.catalog(spark).join(n, "dataset", "left").select(
        "dataset", "modality", "recipe", "path", F.coalesce("n_docs", F.lit(0)).alias("n_docs")
    )


@query("sentence_split", f"""WITH {q.UNITS}
SELECT doc_ord, unit_ord::INTEGER AS unit_ord, length(unit) AS n_chars, md5(unit) AS digest FROM units""")
def sentence_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = units.sentence_units(corpus.documents(spark, sf_dir))
    return rows.select(
        "doc_ord", "unit_ord", F.length("unit").cast("bigint").alias("n_chars"), F.md5("unit").alias("digest")
    )


@query("top_n_units", f"""WITH {q.CORPUS},
few AS (SELECT * FROM corpus QUALIFY row_number() OVER (PARTITION BY dataset, month ORDER BY doc_ord) <= 5),
u AS (SELECT dataset, month, doc_ord, ({q.SENTENCES})[1:8] AS u FROM few)
SELECT dataset, month, doc_ord, unit_ord::INTEGER AS unit_ord, md5(unit) AS digest FROM (
  SELECT dataset, month, doc_ord, unnest(u) AS unit, generate_subscripts(u, 1) - 1 AS unit_ord FROM u)""")
def top_n_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    few = units.first_documents(corpus.documents(spark, sf_dir), 5)
    return units.sentence_units(few, 8).select(*KEYS, "doc_ord", "unit_ord", F.md5("unit").alias("digest"))


@query("byte_budget", f"""WITH {q.UNITS},
run AS (SELECT *, sum(strlen(unit)) OVER (PARTITION BY dataset, month ORDER BY doc_ord, unit_ord) AS upto FROM units)
SELECT dataset, month, count(*) AS n_units, sum(strlen(unit))::BIGINT AS n_bytes, max(doc_ord) AS last_doc
FROM run WHERE upto <= 8192 GROUP BY ALL""")
def byte_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = units.byte_budget(units.sentence_units(corpus.documents(spark, sf_dir)), 8192)
    return kept.groupBy(*KEYS).agg(
        F.count("*").alias("n_units"), F.sum("n_bytes").alias("n_bytes"), F.max("doc_ord").alias("last_doc")
    )


@query("stream_build", f"""WITH {q.UNITS},
run AS (SELECT *, sum(strlen(unit)) OVER (PARTITION BY dataset, month ORDER BY doc_ord, unit_ord) AS upto FROM units),
st AS (SELECT dataset, month, count(*) AS n_units, string_agg(unit, ' ' ORDER BY doc_ord, unit_ord) AS stream
       FROM run WHERE upto <= {fixed.TEXT_BUDGET} GROUP BY ALL)
SELECT dataset, month, n_units, length(stream) AS n_chars, strlen(stream) AS n_bytes, md5(stream) AS digest FROM st""")
def stream_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    streams = units.build_stream(units.sentence_units(corpus.documents(spark, sf_dir)))
    return streams.select(
        *KEYS, "n_units", F.length("stream").cast("bigint").alias("n_chars"),
        F.octet_length("stream").cast("bigint").alias("n_bytes"), F.md5("stream").alias("digest"),
    )


@query("section_split", rf"""WITH body AS (
  SELECT doc_id AS doc_ord, regexp_replace(replace(text, chr(10), '§ '), '^.*?(§)', '\1', 's') AS body FROM documents),
parts AS (
  SELECT doc_ord, list_transform(string_split_regex(replace(body, '§.§', '§.' || chr(2)), '§\s'),
         lambda p: replace(p, chr(2), '§')) AS parts FROM body),
tidy AS (
  SELECT doc_ord, list_transform(list_filter(parts, lambda p: regexp_replace(p, '\s+', '', 'g') <> ''),
         lambda p: regexp_replace(replace(replace(p, '<cit.>', ''), '<ref>', ''), '\s+', ' ', 'g'))[1:2] AS u FROM parts)
SELECT doc_ord, unit_ord::INTEGER AS unit_ord, md5(unit) AS digest FROM (
  SELECT doc_ord, unnest(u) AS unit, generate_subscripts(u, 1) - 1 AS unit_ord FROM tidy)""")
def section_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = corpus.documents(spark, sf_dir).withColumn("text", F.replace("text", F.lit("\n"), F.lit("§ ")))
    return units.section_units(marked).select("doc_ord", "unit_ord", F.md5("unit").alias("digest"))


@query("line_blocks", """WITH l AS (
  SELECT doc_id AS doc_ord, list_filter(string_split(text, chr(10)),
         lambda s: trim(s, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) <> '') AS lines FROM documents)
SELECT doc_ord, len(lines)::INTEGER AS n_lines, md5(array_to_string(lines, chr(10))) AS digest FROM l""")
def line_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = corpus.documents(spark, sf_dir).withColumn("lines", text.filled_lines(F.col("text")))
    return lines.select("doc_ord", F.size("lines").alias("n_lines"), digest("lines", "\n").alias("digest"))


@query("block_sample", rf"""WITH {q.CORPUS},
raw AS (SELECT dataset, month, doc_ord, string_split_regex(text,
    '\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x{{85}}\x{{2028}}\x{{2029}}]') AS l FROM corpus),
lines AS (SELECT dataset, month, doc_ord, CASE WHEN l[-1] = '' THEN l[1:len(l) - 1] ELSE l END AS l FROM raw),
runs AS (SELECT *, {q.seeded_start('doc_ord', 'len(l) - 12')} AS s FROM lines),
cut AS (SELECT dataset, month, doc_ord, CASE WHEN len(l) > 12 THEN l[s + 1:s + 12] ELSE l END AS l FROM runs)
SELECT dataset, month,
       row_number() OVER (PARTITION BY dataset, month ORDER BY {q.seeded_hash('doc_ord')}, doc_ord) - 1 AS doc_ord,
       len(l)::INTEGER AS n_lines, md5(array_to_string(l, chr(10))) AS digest FROM cut""")
def block_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = units.code_units(corpus.documents(spark, sf_dir), 12)
    return files.select(
        *KEYS, "doc_ord", F.size(F.split("unit", "\n")).alias("n_lines"), F.md5("unit").alias("digest")
    )


@query("word_tokenize", f"""SELECT doc_id AS doc_ord, len(t)::INTEGER AS n_toks, md5(array_to_string(t, ' ')) AS digest
FROM (SELECT doc_id, {q.words('text')} AS t FROM documents)""")
def word_tokenize(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = units.tokenize(corpus.documents(spark, sf_dir))
    return docs.select("doc_ord", "n_toks", digest("toks").alias("digest"))


# A table with gaps and in no order.
BYTE_IDS = [1000 + b * 77 % 256 * 5 for b in range(256)]


@query("byte_tokenize", """WITH b AS (
  SELECT doc_id AS doc_ord, list_transform(regexp_extract_all(hex(encode(text)), '..'),
         lambda h: 1000 + ('0x' || h)::INTEGER * 77 % 256 * 5) AS ids FROM documents)
SELECT doc_ord, len(ids)::INTEGER AS n_toks, list_sum(ids)::BIGINT AS id_sum,
       md5(array_to_string(ids, ',')) AS digest FROM b""")
def byte_tokenize(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = corpus.documents(spark, sf_dir).withColumn("ids", text.byte_tokens(F.col("text"), BYTE_IDS))
    return docs.select(
        "doc_ord", F.size("ids").alias("n_toks"),
        F.aggregate("ids", F.lit(0).cast("bigint"), lambda a, i: a + i).alias("id_sum"),
        digest(F.col("ids").cast("array<string>"), ",").alias("digest"),
    )


@query("byte_inverse", """WITH b AS (
  SELECT lang AS dataset, unnest(regexp_extract_all(hex(encode(text)), '..')) AS h FROM documents)
SELECT dataset, 1000 + ('0x' || h)::INTEGER * 77 % 256 * 5 AS tok, ('0x' || h)::INTEGER AS byte, '<0x' || h || '>' AS name, count(*) AS k
FROM b GROUP BY ALL""")
def byte_inverse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes to ids and back; the table is read from rows."""
    table = text.read_byte_table(spark.createDataFrame(list(enumerate(BYTE_IDS)), "byte int, id int"))
    ids = F.array(*[F.lit(i) for i in table])
    counts = byte_pair_counts(corpus.documents(spark, sf_dir))
    toks = counts.groupBy("dataset", F.element_at(ids, F.col("byte") + 1).alias("tok")).agg(F.sum("k").alias("k"))
    back = toks.withColumn("byte", text.byte_of_token(F.col("tok"), table))
    return back.select("dataset", "tok", "byte", text.byte_token_name(F.col("byte")).alias("name"), "k")


@query("two_stage_cut", f"""SELECT doc_id AS doc_ord, len(t)::INTEGER AS n_toks, md5(array_to_string(t, ' ')) AS digest
FROM (SELECT doc_id, ({q.words('substr(text, 1, 1000)')})[1:100] AS t FROM documents)""")
def two_stage_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = corpus.documents(spark, sf_dir).withColumn("cut", text.cut_text(F.col("text"), 100))
    return docs.select("doc_ord", F.size("cut").alias("n_toks"), digest("cut").alias("digest"))


@query("seeded_shuffle", f"""WITH {q.CORPUS}
SELECT dataset, month, doc_ord,
       row_number() OVER (PARTITION BY dataset, month ORDER BY {q.seeded_hash('doc_ord')}, doc_ord) - 1 AS rank
FROM corpus""")
def seeded_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = corpus.documents(spark, sf_dir).drop("text")
    return units.seeded_order(docs).select(*KEYS, "doc_ord", "rank")


@query("byte_chunk_sample", f"""WITH p AS (
  SELECT {q.month_slot('page_id')} AS month, page_id AS doc_ord, hex(encode(html)) AS h, strlen(html) AS n FROM pages),
s AS (SELECT *, unnest(CASE WHEN n >= 256 * 20 THEN range(0, 20) ELSE [0] END) AS slice_ord FROM p),
st AS (SELECT *, CASE WHEN n >= 256 * 20 THEN
    {q.seeded_start("doc_ord || ':' || slice_ord", 'n - 256')} ELSE 0 END AS start FROM s)
SELECT month, doc_ord, slice_ord::INTEGER AS slice_ord, start::INTEGER AS start,
       md5(CASE WHEN n >= 256 * 20 THEN substr(h, 2 * start + 1, 512) ELSE h END) AS digest FROM st""")
def byte_chunk_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    slices = byte_slices(corpus.pages(spark, sf_dir), "audio", 256, 20)
    return slices.select("month", "doc_ord", "slice_ord", "start", F.md5(F.hex("audio")).alias("digest"))


@query("patch_sample", f"""WITH i AS (
  SELECT {q.month_slot('vec_id')} AS month, vec_id AS doc_ord, embedding AS px,
         {q.seeded_start("vec_id || ':top'", '8 - 3')} AS top, {q.seeded_start("vec_id || ':left'", '8 - 5')} AS lft
  FROM embeddings),
p AS (SELECT *, flatten(list_transform(range(top, top + 3), lambda r: px[r * 8 + lft + 1:r * 8 + lft + 5])) AS patch FROM i)
SELECT month, doc_ord, top, lft AS "left", len(patch)::INTEGER AS n_pixels,
       round(list_sum(list_transform(patch, lambda x: x::DOUBLE)), 6) AS pixel_sum FROM p""")
def patch_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = patches(corpus.images(spark, sf_dir), 3, 5)
    total = F.aggregate("patch", F.lit(0.0), lambda a, x: a + x.cast("double"))
    return cut.select(
        "month", "doc_ord", "top", "left", F.size("patch").alias("n_pixels"), F.round(total, 6).alias("pixel_sum")
    )


@query("binary_source", f"""WITH p AS (
  SELECT {q.month_slot('page_id')} AS month, page_id, hex(encode(html)) AS h FROM pages)
SELECT month, strlen(s) // 2 AS n_bytes, md5(s) AS digest FROM (
  SELECT month, substr(string_agg(h, '' ORDER BY page_id), 1, 2 * 20000) AS s FROM p GROUP BY ALL)""")
def binary_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    streams = binary.byte_stream(corpus.pages(spark, sf_dir), "audio", 20000)
    return streams.select(
        "month", F.octet_length("stream").cast("bigint").alias("n_bytes"), F.md5(F.hex("stream")).alias("digest")
    )
