"""Shared pieces of the checking SQL, built from the same fixed values as the queries."""

from __future__ import annotations

from tidemark.functions import fixed, text
from tidemark.sources.results import BRAND_MODELS

WORDS = text.WORD_PATTERN


def literal(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def literals(values: list[str]) -> str:
    return "(" + ", ".join(literal(v) for v in values) + ")"


def month_slot(ordinal: str) -> str:
    return f"strftime(DATE '2017-01-01' + to_months(({ordinal} % 83)::INTEGER), '%Y-%m')"


def lowered(value: str) -> str:
    return f"lower(replace({value}, '{text.LONG_CAPITAL}', 'I'))"


def words(value: str) -> str:
    return f"regexp_extract_all({lowered(value)}, {literal(WORDS)})"


def seeded_hash(key: str, seed: int = fixed.SHUFFLE_SEED) -> str:
    return f"md5('{seed}:' || ({key}))"


def seeded_start(key: str, span: str, seed: int = fixed.SHUFFLE_SEED) -> str:
    head = f"('0x' || substr({seeded_hash(key, seed)}, 1, 8))::BIGINT"
    return f"(CASE WHEN ({span}) > 1 THEN {head} % greatest({span}, 1) ELSE 0 END)::INTEGER"


def render(template: str, **holes: str) -> str:
    """A template as SQL concatenation; `holes` are SQL expressions."""
    sql = literal(template)
    for name, value in holes.items():
        sql = sql.replace("{%s}" % name, f"' || coalesce({value}, '') || '")
    return f"({sql})"


CORPUS = f"""corpus AS (
  SELECT lang AS dataset, {month_slot('doc_id')} AS month, doc_id AS doc_ord, text FROM documents)"""

TOKENS = f"""{CORPUS},
docs AS (SELECT *, {words('text')} AS toks FROM corpus),
pos AS (
  SELECT dataset, month, tok, row_number() OVER (PARTITION BY dataset, month ORDER BY doc_ord, i) - 1 AS pos
  FROM (SELECT dataset, month, doc_ord, unnest(toks) AS tok, generate_subscripts(toks, 1) AS i FROM docs)),
total AS (SELECT dataset, month, count(*) AS n FROM pos GROUP BY ALL)"""

SENTENCES = r"""list_filter(string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(30), 'g'), chr(30)), lambda s: s <> '')"""

UNITS = f"""{CORPUS},
units AS (
  SELECT dataset, month, doc_ord, unnest(u) AS unit, generate_subscripts(u, 1) - 1 AS unit_ord
  FROM (SELECT dataset, month, doc_ord, {SENTENCES} AS u FROM corpus))"""

LOGITS = f"""lg AS (
  SELECT vec_id, {month_slot('vec_id // 16')} AS month, vec_id // 16 AS chunk_id, (vec_id % 16)::INTEGER AS off,
         list_transform(embedding, lambda x: x::DOUBLE) AS logits, label AS sym FROM embeddings)"""

PMF = f"""{LOGITS},
ex AS (SELECT *, list_transform(logits, lambda x: exp(x - list_max(logits))) AS e FROM lg),
pm AS (SELECT * EXCLUDE (e, logits), list_transform(e, lambda x: x / list_sum(e)) AS pmf FROM ex)"""

CDF = f"""{PMF},
cd AS (
  SELECT * EXCLUDE (pmf),
         list_transform(range(0, 65), lambda i: least(coalesce(list_sum(pmf[1:i]), 0.0), 1.0)) AS cdf FROM pm),
qc AS (
  SELECT * EXCLUDE (cdf),
         list_transform(range(0, 65), lambda i: round_even(cdf[i + 1] * (1073741824 - 64), 0)::BIGINT + i) AS q
  FROM cd)"""

MODEL = "[" + ", ".join(literal(m) for m in BRAND_MODELS) + "][regexp_extract(p_brand, '([0-9]+)$', 1)::INTEGER]"


def results(*more: str) -> str:
    extra = "".join(f", {c}" for c in more)
    return f"""results AS (
  SELECT *, compressed_size / original_size AS ratio FROM (
    SELECT l_returnflag AS dataset, {MODEL} AS model,
           strftime(l_shipdate + to_months(264), '%Y-%m') AS month{extra},
           sum(round(l_extendedprice * 100)::BIGINT)::BIGINT AS original_size,
           sum(round(l_extendedprice * 100)::BIGINT * round(l_discount * 100)::BIGINT)::DOUBLE / 100 AS compressed_size,
           sum(l_quantity::BIGINT)::BIGINT AS num_tokens,
           count(*) AS batches
    FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL))"""


RESULTS = results()

AVERAGES = f"""{RESULTS},
averages AS (
  SELECT dataset, model, avg(ratio) FILTER (month BETWEEN '2017-01' AND '2023-11') AS avg_all,
         avg(ratio) FILTER (month BETWEEN '2023-01' AND '2023-11') AS avg_test,
         avg(ratio) FILTER (month BETWEEN '2017-01' AND '2022-12') AS avg_train,
         count(ratio) FILTER (month BETWEEN '2017-01' AND '2023-11') AS n_months
  FROM results GROUP BY ALL)"""

GAPS = f"""{AVERAGES},
gaps AS (
  SELECT dataset, model, avg_test - avg_train AS gap, avg_test - avg_all AS gap_all,
         avg_test * 100 AS performance, (avg_test - avg_train) * 100 AS robustness FROM averages)"""

#: Series of a performance / robustness chart.
PLOTTED = f"""{GAPS},
plotted AS (SELECT * FROM gaps WHERE model IN {literals(list(fixed.MODEL_LABELS))}
  AND model NOT IN {literals(fixed.EXCLUDED_MODELS)} AND model NOT IN {literals(fixed.CODECS)})"""

ANSWERS = f"""answers AS (
  SELECT {month_slot('q.conv_id')} AS month, q.conv_id, q.turn AS idx, q.text AS question,
         string_split(r.text, ' ')[1] AS ref_answer, {SENTENCES.replace('(text,', '(r.text,')} AS out, out AS judges
  FROM conversations q JOIN conversations r ON r.conv_id = q.conv_id AND r.turn = q.turn + 1 AND r.role = 'assistant'
  WHERE q.role = 'user')"""


def verdict(value: str) -> str:
    return f"CASE WHEN contains(lower({value}), 'yes') THEN true WHEN contains(lower({value}), 'no') THEN false END"
