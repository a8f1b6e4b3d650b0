"""Analysis of result records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import fixed
from tidemark.operators import results as r
from tidemark.operators import series
from tidemark.operators.pmf import coded_bytes
from tidemark.plans import sqltext as q
from tidemark.plans.registry import query
from tidemark.session import shared_folder
from tidemark.sources import results as src
from tidemark.sources.stages import materialise

KEYS = ["dataset", "model", "month"]
MONTHS = [f"{y}-{m:02d}" for y in range(2017, 2024) for m in range(1, 13) if (y, m) <= (2023, 11)]
FLAG_TASKS = {"A": "Wikitext", "N": "BBC News", "R": "Code"}
TASK_CASE = "CASE dataset " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in FLAG_TASKS.items()) + " END"
VARIANT_SLOT = "((l_linenumber - 1) % 4)::INTEGER AS slot"
VARIANT_CASE = "CASE slot WHEN 0 THEN '2K' WHEN 1 THEN '2K+SW' WHEN 2 THEN '4K' ELSE '8K' END"
# Models without a 4K result of their own.
NO_4K = ["Baichuan2-7B-Base", "Llama-2-7B-HF"]


def base(spark: SparkSession, sf_dir: str) -> DataFrame:
    return src.line_results(spark, sf_dir)


def rounded(df: DataFrame, *names: str, digits: int = 8) -> DataFrame:
    return df.withColumns({n: F.round(n, digits) for n in names})


# --- union, dedupe ----------------------------------------------------------
ROOTS = f"""roots AS (
  SELECT dataset, model, month, ratio, CASE l_linestatus WHEN 'F' THEN 0 ELSE 1 END AS priority FROM (
    WITH {q.results('l_linestatus')} SELECT * FROM results))"""


def roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Written, so that lines are scanned once for both roots.
    both = materialise(src.line_results(spark, sf_dir, "l_linestatus").select(*KEYS, "ratio", "l_linestatus"), "roots")
    parts = [both.where(F.col("l_linestatus") == status).drop("l_linestatus") for status in ("F", "O")]
    return r.union_roots(parts)


@query("union_results", f"""WITH {ROOTS}
SELECT dataset, model, month, priority, round(ratio, 8) AS ratio FROM roots""")
def union_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(roots(spark, sf_dir), "ratio")


@query("dedupe_first", f"""WITH {ROOTS}
SELECT dataset, model, month, priority, round(ratio, 8) AS ratio FROM roots
QUALIFY row_number() OVER (PARTITION BY dataset, model, month ORDER BY priority) = 1""")
def dedupe_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(r.dedupe_first(roots(spark, sf_dir)), "ratio")


# --- model names ------------------------------------------------------------
@query("exclude_models", f"""WITH {q.RESULTS}
SELECT dataset, model, month, round(ratio, 8) AS ratio FROM results
WHERE model NOT IN {q.literals(fixed.EXCLUDED_MODELS)}""")
def exclude_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(r.exclude_models(base(spark, sf_dir)).select(*KEYS, "ratio"), "ratio")


@query("project_ratio", f"""WITH {q.RESULTS}
SELECT dataset, model, month, round(ratio, 8) AS ratio FROM results""")
def project_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(base(spark, sf_dir).select(*KEYS, "ratio"), "ratio")


@query("drop_baselines", f"""WITH {q.RESULTS}
SELECT dataset, model, count(*) AS n_months, round(avg(ratio), 8) AS ratio FROM results
WHERE model NOT IN {q.literals(fixed.CODECS)} GROUP BY ALL""")
def drop_baselines(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = r.drop_codecs(base(spark, sf_dir))
    return rounded(kept.groupBy("dataset", "model").agg(
        F.count("*").alias("n_months"), F.avg("ratio").alias("ratio")
    ), "ratio")


LABELS = "labels_dim(model, label) AS (VALUES " + ", ".join(
    f"({q.literal(m)}, {q.literal(label)})" for m, label in fixed.MODEL_LABELS.items()
) + ")"


@query("label_models", f"""WITH {q.RESULTS}, {LABELS}
SELECT dataset, label, month, round(ratio * 100, 6) AS percent FROM results JOIN labels_dim USING (model)""")
def label_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = r.label_models(base(spark, sf_dir))
    return named.select("dataset", "label", "month", F.round(F.col("ratio") * 100, 6).alias("percent"))


def sql_any(text: str, tags: list[str]) -> str:
    return "(" + " OR ".join(f"contains({text}, {q.literal(t.lower())})" for t in tags) + ")"


@query("family_filter", f"""WITH {q.RESULTS}, m AS (SELECT model, count(*) AS n FROM results GROUP BY ALL)
SELECT model, n, contains(model, '7B') OR contains(model, '6B') AS small_exact,
       contains(lower(model), '7b') OR contains(lower(model), '6b') AS small,
       {sql_any('lower(model)', fixed.LARGE_TAGS)} AS large, model IN {q.literals(fixed.LLAMA_FAMILY)} AS llama,
       {sql_any('lower(model)', fixed.LONG_CONTEXT_FAMILIES)} AS long_context FROM m""")
def family_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    models = base(spark, sf_dir).groupBy("model").agg(F.count("*").alias("n"))
    name = F.col("model")
    return models.select(
        "model", "n", (name.contains("7B") | name.contains("6B")).alias("small_exact"),
        r.is_small(name).alias("small"), r.is_large(name).alias("large"), r.is_llama(name).alias("llama"),
        r.is_long_context(name).alias("long_context"),
    )


@query("complete_models", f"""WITH {q.RESULTS},
want AS (SELECT dataset, count(DISTINCT month) AS w FROM results GROUP BY ALL),
have AS (SELECT dataset, model, count(ratio) AS h FROM results GROUP BY ALL)
SELECT dataset, model, month, round(ratio, 8) AS ratio FROM results JOIN want USING (dataset)
JOIN have USING (dataset, model) WHERE h = w""")
def complete_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(r.complete_models(base(spark, sf_dir)).select(*KEYS, "ratio"), "ratio")


@query("model_key", f"""WITH {q.results('l_linenumber')},
k AS (SELECT 'owner/' || model AS name, (1024 * l_linenumber)::INTEGER AS context_size, count(*) AS n FROM results GROUP BY ALL)
SELECT name, context_size, n, CASE WHEN context_size = 2048 THEN split_part(name, '/', 2)
       ELSE split_part(name, '/', 2) || '-' || context_size END AS key FROM k""")
def model_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = src.line_results(spark, sf_dir, "l_linenumber").groupBy(
        F.concat(F.lit("owner/"), "model").alias("name"), (F.col("l_linenumber") * 1024).alias("context_size")
    ).agg(F.count("*").alias("n"))
    return rows.withColumn("key", r.model_key(F.col("name"), F.col("context_size")))


@query("path_model", f"""WITH {q.RESULTS}
SELECT 'save/' || dataset || '/' || month || '/' || model || '.json' AS path, dataset, month, model FROM results""")
def path_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.concat(F.lit("save/"), "dataset", F.lit("/"), "month", F.lit("/"), "model", F.lit(".json"))
    paths = base(spark, sf_dir).select(path.alias("path"))
    return paths.select("path", *[c.alias(k) for k, c in src.path_keys(F.col("path")).items()])


CONTEXTS = f"""{q.results('l_linenumber')},
long AS (SELECT dataset, model || '-' || (2 * l_linenumber) || 'k' AS model, ratio FROM results)"""


def long_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Result names that end in a context size, as '-<n>k'."""
    rows = src.line_results(spark, sf_dir, "l_linenumber")
    size = (F.col("l_linenumber") * 2).cast("string")
    return rows.withColumn("model", F.concat("model", F.lit("-"), size, F.lit("k")))


@query("context_key", f"""WITH {CONTEXTS}
SELECT model, regexp_extract(model, '^(.*)-([0-9]+)k$', 1) AS family,
       regexp_extract(model, '^(.*)-([0-9]+)k$', 2)::INTEGER AS context_size, count(*) AS n FROM long GROUP BY ALL""")
def context_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = long_results(spark, sf_dir).groupBy("model").agg(F.count("*").alias("n"))
    family, size = r.context_key(F.col("model"))
    return rows.select("model", family.alias("family"), size.alias("context_size"), "n")


@query("context_curve", f"""WITH {CONTEXTS}
SELECT regexp_extract(model, '^(.*)-([0-9]+)k$', 1) AS family,
       regexp_extract(model, '^(.*)-([0-9]+)k$', 2)::INTEGER AS context_size,
       round(avg(ratio * 100), 6) AS performance, family NOT IN {q.literals(fixed.LONG_CONTEXT_HIDDEN)} AS visible
FROM long GROUP BY ALL""")
def context_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    curve = r.context_curve(long_results(spark, sf_dir)).withColumn("visible", r.long_context_visible(F.col("family")))
    return rounded(curve, "performance", digits=6)


@query("default_visible", f"""WITH {q.RESULTS}, {LABELS},
k AS (SELECT CASE dataset WHEN 'A' THEN 'code' WHEN 'N' THEN 'wikitext' ELSE 'math' END AS task, label, count(*) AS n
      FROM results JOIN labels_dim USING (model) GROUP BY ALL)
SELECT task, label, n, (contains(lower(label), 'codellama') AND task IN {q.literals(fixed.CODE_MODEL_TASKS)})
       OR label NOT IN {q.literals(fixed.HIDDEN_LABELS)} AS visible FROM k""")
def default_visible(spark: SparkSession, sf_dir: str) -> DataFrame:
    task = F.when(F.col("dataset") == "A", "code").when(F.col("dataset") == "N", "wikitext").otherwise("math")
    rows = r.label_models(base(spark, sf_dir)).groupBy(task.alias("task"), "label").agg(F.count("*").alias("n"))
    return rows.withColumn("visible", r.default_visible(F.col("label"), F.col("task")))


# --- context variants -------------------------------------------------------
VARIANTS = f"""{q.results(VARIANT_SLOT)},
var AS (SELECT dataset, model, month, {VARIANT_CASE} AS variant, ratio FROM results
        WHERE NOT (slot = 2 AND model IN {q.literals(NO_4K)}))"""


def variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    slot = F.col("slot")
    names = F.when(slot == 0, "2K").when(slot == 1, "2K+SW").when(slot == 2, "4K").otherwise("8K")
    rows = src.line_results(spark, sf_dir, F.pmod(F.col("l_linenumber") - 1, F.lit(4)).cast("int").alias("slot"))
    absent = (slot == 2) & F.col("model").isin(NO_4K)
    return rows.where(~absent).select("dataset", "model", "month", names.alias("variant"), "ratio")


@query("context_variants", f"""WITH {VARIANTS}
SELECT a.dataset, a.model, a.month, round(a.ratio, 8) AS "2K", round(b.ratio, 8) AS "2K+SW", round(c.ratio, 8) AS "8K"
FROM (SELECT * FROM var WHERE variant = '2K') a
JOIN (SELECT * FROM var WHERE variant = '2K+SW') b USING (dataset, model, month)
JOIN (SELECT * FROM var WHERE variant = '8K') c USING (dataset, model, month)""")
def context_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ["2K", "2K+SW", "8K"]
    return rounded(r.context_variants(variants(spark, sf_dir), names), *names)


MATRIX = f"""{VARIANTS},
mat AS (SELECT dataset, model, """ + ", ".join(
    f"avg(ratio) FILTER (variant = '{v}') AS \"{v}\"" for v in fixed.CONTEXT_VARIANTS
) + " FROM var WHERE month BETWEEN '2023-01' AND '2023-11' GROUP BY ALL)"


@query("context_matrix", f"""WITH {MATRIX}
SELECT dataset, model, {', '.join(f'round("{v}", 8) AS "{v}"' for v in fixed.CONTEXT_VARIANTS)} FROM mat""")
def context_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(r.context_matrix(variants(spark, sf_dir)), *fixed.CONTEXT_VARIANTS)


@query("context_fallback", f"""WITH {MATRIX}
SELECT dataset, model, round("2K", 8) AS "2K", round("2K+SW", 8) AS "2K+SW", round(coalesce("4K", "8K"), 8) AS "4K",
       round(CASE WHEN "4K" IS NOT NULL THEN "8K" END, 8) AS "8K" FROM mat""")
def context_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(r.context_fallback(r.context_matrix(variants(spark, sf_dir))), *fixed.CONTEXT_VARIANTS)


# --- periods ----------------------------------------------------------------
@query("period_averages", f"""WITH {q.AVERAGES}
SELECT dataset, model, round(avg_all, 8) AS avg_all, round(avg_test, 8) AS avg_test,
       round(avg_train, 8) AS avg_train, n_months FROM averages""")
def period_averages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(r.period_averages(base(spark, sf_dir)), "avg_all", "avg_test", "avg_train")


@query("robustness_gap", f"""WITH {q.GAPS}
SELECT dataset, model, round(gap, 8) AS gap, round(gap_all, 8) AS gap_all,
       round(performance, 6) AS performance, round(robustness, 6) AS robustness FROM gaps""")
def robustness_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    gaps = r.robustness_gap(r.period_averages(base(spark, sf_dir)))
    return rounded(rounded(gaps, "gap", "gap_all"), "performance", "robustness", digits=6)


@query("coverage_check", f"""WITH {q.AVERAGES} SELECT dataset, model, n_months FROM averages WHERE n_months < 83""")
def coverage_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r.coverage(r.period_averages(base(spark, sf_dir)), len(MONTHS))


def sql_digits(x: str, digits: int) -> str:
    """Text of x below one (leading zero cut) and above (significant figures), zero padded."""
    above = "CASE " + " ".join(
        f"WHEN {x} < {10 ** n} THEN printf('%.{digits - n}f', {x})" for n in range(1, digits + 1)
    ) + f" ELSE printf('%.0f', {x}) END"
    return (f"CASE WHEN {x} < 1 THEN regexp_replace(printf('%.{digits}f', {x}), '^0+', '') ELSE {above} END")


@query("format_gap", f"""WITH {q.AVERAGES},
v AS (SELECT dataset, model, round(avg_all * 100, 8) AS a, round(avg_test * 100, 8) AS t,
             round((avg_test - avg_train) * 100, 8) AS g FROM averages)
SELECT dataset, model, {sql_digits('a', 4)} AS avg_text,
       CASE WHEN t IS NOT NULL THEN concat_ws(' ', {sql_digits('t', 4)}, CASE WHEN g > 0 THEN '↑' WHEN g <= 0 THEN '↓' END, CASE WHEN g IS NOT NULL THEN {sql_digits('abs(g)', 3)} END) END AS test_text
FROM v""")
def format_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r.formatted(r.period_averages(base(spark, sf_dir)))


@query("range_stats", f"""WITH {q.PLOTTED},
c AS (SELECT dataset, performance, greatest(robustness, 0.0) AS robustness FROM plotted)
SELECT dataset, """ + ", ".join(
    f"round(min({n}), 6) AS min_{n}, round(max({n}), 6) AS max_{n}, "
    f"round(min({n}) - (max({n}) - min({n})) * 0.05::DOUBLE, 6) AS from_{n}, "
    f"round(max({n}) + (max({n}) - min({n})) * 0.05::DOUBLE, 6) AS to_{n}, round((max({n}) + min({n})) / 2, 6) AS mid_{n}"
    for n in ("performance", "robustness")
) + " FROM c GROUP BY ALL")
def range_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = r.range_stats(r.plotted(r.robustness_gap(r.period_averages(base(spark, sf_dir)))))
    return rounded(stats, *[n for n in stats.columns if n != "dataset"], digits=6)


@query("quadrants", f"""WITH {q.PLOTTED},
c AS (SELECT dataset, model, performance, greatest(robustness, 0.0) AS robustness FROM plotted),
m AS (SELECT dataset, (max(performance) + min(performance)) / 2 AS mp, (max(robustness) + min(robustness)) / 2 AS mr
      FROM c GROUP BY ALL)
SELECT dataset, model, round(performance, 6) AS performance, round(robustness, 6) AS robustness,
       CASE WHEN performance <= mp THEN 'low' ELSE 'high' END || '/' ||
       CASE WHEN robustness <= mr THEN 'low' ELSE 'high' END AS quadrant FROM c JOIN m USING (dataset)""")
def quadrants(spark: SparkSession, sf_dir: str) -> DataFrame:
    gaps = r.plotted(r.robustness_gap(r.period_averages(base(spark, sf_dir))))
    return rounded(r.quadrants(gaps), "performance", "robustness", digits=6)


@query("leaderboard", f"""WITH {q.AVERAGES}
SELECT dataset, model, round(avg_test, 8) AS avg_test,
       row_number() OVER (PARTITION BY dataset ORDER BY avg_test NULLS LAST, model)::INTEGER AS place FROM averages""")
def leaderboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(r.leaderboard(r.period_averages(base(spark, sf_dir))), "avg_test")


# --- pivots -----------------------------------------------------------------
@query("pivot_results", f"""WITH {q.RESULTS} SELECT dataset, model, """ + ", ".join(
    f"round(max(ratio) FILTER (month = '{m}'), 8) AS \"{m}\"" for m in MONTHS
) + " FROM results GROUP BY ALL")
def pivot_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(r.pivot_months(base(spark, sf_dir), MONTHS), *MONTHS)


TASK_NAMES = list(FLAG_TASKS.values())


def by_task(df: DataFrame) -> DataFrame:
    names = F.create_map(*[F.lit(x) for pair in FLAG_TASKS.items() for x in pair])
    return df.withColumn("dataset", names[F.col("dataset")])


@query("task_matrix", f"""WITH {q.RESULTS}, {LABELS},
t AS (SELECT {TASK_CASE} AS task, label AS model, ratio FROM results JOIN labels_dim USING (model)),
drv AS (SELECT DISTINCT model FROM t WHERE task = 'Wikitext')
SELECT model, """ + ", ".join(
    f"round(avg(ratio) FILTER (task = '{t}'), 8) AS \"{t}\"" for t in fixed.TABLE_TASKS
) + " FROM drv LEFT JOIN t USING (model) GROUP BY ALL")
def task_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = r.label_models(by_task(base(spark, sf_dir))).drop("model").withColumnRenamed("label", "model")
    return rounded(r.task_matrix(named, "Wikitext", fixed.TABLE_TASKS), *fixed.TABLE_TASKS)


#: Flag and status of a line to the six tasks of the published table.
SIX_TASKS = dict(zip(["NF", "AF", "AO", "NO", "RF", "RO"], fixed.TABLE_TASKS))
SIX_CASE = "CASE dataset || l_linestatus " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in SIX_TASKS.items()) + " END"


def six_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.create_map(*[F.lit(x) for pair in SIX_TASKS.items() for x in pair])
    rows = src.line_results(spark, sf_dir, "l_linestatus")
    return rows.withColumn("dataset", names[F.concat("dataset", "l_linestatus")]).drop("l_linestatus")


@query("big_table", f"""WITH {q.results('l_linestatus')}, {LABELS},
av AS (
  SELECT {SIX_CASE} AS task, label AS model, round(avg(ratio) FILTER (month BETWEEN '2017-01' AND '2023-11') * 100, 8) AS a,
         round(avg(ratio) FILTER (month BETWEEN '2023-01' AND '2023-11') * 100, 8) AS t,
         round((avg(ratio) FILTER (month BETWEEN '2023-01' AND '2023-11') - avg(ratio) FILTER (month BETWEEN '2017-01' AND '2022-12')) * 100, 8) AS g
  FROM results JOIN labels_dim USING (model) WHERE model NOT IN {q.literals(fixed.EXCLUDED_MODELS)} GROUP BY ALL),
cells AS (
  SELECT task, model, {sql_digits('a', 4)} AS avg_text,
         CASE WHEN t IS NOT NULL THEN concat_ws(' ', {sql_digits('t', 4)}, CASE WHEN g > 0 THEN '↑' WHEN g <= 0 THEN '↓' END, CASE WHEN g IS NOT NULL THEN {sql_digits('abs(g)', 3)} END) END AS test_text FROM av)
SELECT model, """ + ", ".join(
    f"max(avg_text) FILTER (task = '{t}') AS \"{t} Avg.\", max(test_text) FILTER (task = '{t}') AS \"{t} 2023\"" for t in fixed.TABLE_TASKS
) + f" FROM cells GROUP BY ALL HAVING count(*) FILTER (task = '{fixed.TABLE_TASKS[0]}') > 0")
def big_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r.published_table(six_tasks(spark, sf_dir))


@query("averages_cube", f"""WITH {q.RESULTS}
SELECT dataset, model, grouping(dataset, model)::INTEGER AS level,
       round(avg(ratio) FILTER (month BETWEEN '2017-01' AND '2023-11'), 8) AS avg_all,
       round(avg(ratio) FILTER (month BETWEEN '2023-01' AND '2023-11'), 8) AS avg_test,
       count(ratio) FILTER (month BETWEEN '2017-01' AND '2023-11') AS n
FROM results GROUP BY CUBE (dataset, model)""")
def averages_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(r.averages_cube(base(spark, sf_dir)), "avg_all", "avg_test")


@query("tokenizer_efficiency", f"""WITH {q.RESULTS},
m AS (SELECT dataset, model, compressed_size, compressed_size * 8 / num_tokens AS bpt,
             compressed_size * 8 / original_size AS bpb FROM results
      WHERE model IN {q.literals(fixed.TOKENIZER_MODELS)} AND month BETWEEN '2023-01' AND '2023-11')
SELECT dataset, model, round(sum(compressed_size * 8 / nullif(bpt, 0)), 3) AS total_tokens, round(avg(bpt), 6) AS mean_bpt,
       round(avg(bpb), 8) AS mean_bpb FROM m GROUP BY ALL""")
def tokenizer_efficiency(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = base(spark, sf_dir).withColumns({
        "bpt": F.try_divide(F.col("compressed_size") * 8, "num_tokens"),
        "bpb": F.try_divide(F.col("compressed_size") * 8, "original_size"),
    })
    table = r.tokenizer_efficiency(rows)
    return rounded(rounded(rounded(table, "total_tokens", digits=3), "mean_bpt", digits=6), "mean_bpb")


@query("metric_families", f"""WITH {q.RESULTS}
SELECT dataset, model, month, round(ratio, 8) AS ratio, original_size,
       CASE WHEN model NOT IN {q.literals(fixed.CODECS)} THEN round((ceil((compressed_size * 8 + 2) / 8)) / original_size, 8) END AS ac_ratio,
       CASE WHEN model NOT IN {q.literals(fixed.CODECS)} THEN original_size END AS ac_original_size FROM results""")
def metric_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size by self-information beside the whole bytes an interval coder needs."""
    rows = materialise(base(spark, sf_dir), "records")
    model = rows.select(*KEYS, "ratio", "original_size")
    coder = r.drop_codecs(rows).select(
        *KEYS, F.try_divide(coded_bytes(F.col("compressed_size") * 8), "original_size").alias("ratio"), "original_size"
    )
    return rounded(r.metric_families(model, coder), "ratio", "ac_ratio")


# --- series -----------------------------------------------------------------
@query("repair_month", f"""WITH {q.RESULTS},
n AS (SELECT *, (lag(ratio) OVER w + lead(ratio) OVER w) / 2 AS mean FROM results
      WINDOW w AS (PARTITION BY dataset, model ORDER BY month))
SELECT dataset, model, month, round(CASE WHEN month = '2021-03' THEN coalesce(mean, ratio) ELSE ratio END, 8) AS repaired
FROM n""")
def repair_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(series.repair_month(base(spark, sf_dir)).select(*KEYS, "repaired"), "repaired")


@query("exp_smoothing", f"""WITH RECURSIVE {q.RESULTS},
o AS (SELECT dataset, model, month, ratio, row_number() OVER (PARTITION BY dataset, model ORDER BY month) AS i FROM results),
y AS (SELECT dataset, model, month, i, ratio AS smoothed FROM o WHERE i = 1
      UNION ALL
      SELECT o.dataset, o.model, o.month, o.i, 0.3::DOUBLE * o.ratio + 0.7::DOUBLE * y.smoothed
      FROM y JOIN o ON o.dataset = y.dataset AND o.model = y.model AND o.i = y.i + 1)
SELECT dataset, model, month, round(smoothed, 8) AS smoothed FROM y""")
def exp_smoothing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(series.exponential_smoothing(base(spark, sf_dir)), "smoothed")


@query("drift_vs_first", f"""WITH {q.RESULTS}
SELECT dataset, model, month, round(ratio / nullif(first_value(ratio) OVER (PARTITION BY dataset, model ORDER BY month), 0) - 1, 8) AS drift
FROM results""")
def drift_vs_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(series.drift_vs_first(base(spark, sf_dir)).select(*KEYS, "drift"), "drift")


@query("cumulative_time", f"""WITH {q.RESULTS}
SELECT dataset, model, month, sum(num_tokens) OVER (PARTITION BY dataset, model ORDER BY month)::BIGINT AS elapsed
FROM results""")
def cumulative_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.cumulative_time(base(spark, sf_dir), "num_tokens").select(*KEYS, "elapsed")


# --- files ------------------------------------------------------------------
@query("nested_export", f"""WITH {q.RESULTS}
SELECT dataset, model, count(*)::INTEGER AS n_months, min(month) AS first_month, max(month) AS last_month,
       round(sum(ratio), 8) AS ratio_sum FROM results GROUP BY ALL""")
def nested_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number texts differ between engines, so the exported object is described by its content."""
    exported = src.nested_export(base(spark, sf_dir))
    months = F.json_object_keys("by_month")
    values = F.map_values(F.from_json("by_month", "map<string,double>"))
    return exported.select(
        "dataset", "model", F.size(months).alias("n_months"), F.element_at(months, 1).alias("first_month"),
        F.element_at(months, -1).alias("last_month"),
        F.round(F.aggregate(values, F.lit(0.0), lambda a, v: a + v), 8).alias("ratio_sum"),
    )


@query("nested_import", f"""WITH {q.RESULTS} SELECT dataset, model, month, round(ratio, 8) AS ratio FROM results""")
def nested_import(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(src.nested_import(src.nested_export(base(spark, sf_dir))), "ratio")


RECORDS = f"""WITH {q.RESULTS}
SELECT dataset, model, month, round(ratio, 8) AS ratio, original_size, batches,
       round(compressed_size * 8 / num_tokens, 6) AS bpt FROM results"""


def stored(spark: SparkSession, sf_dir: str, folders: tuple[str, ...]) -> DataFrame:
    rows = base(spark, sf_dir).withColumn("bpt", F.try_divide(F.col("compressed_size") * 8, "num_tokens"))
    path = shared_folder(spark, "results")
    src.write_results(rows, path, folders)
    back = src.scan_results(spark, path).select(*KEYS, "ratio", "original_size", "batches", "bpt")
    return rounded(rounded(back, "ratio"), "bpt", digits=6)


@query("write_results", RECORDS)
def write_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored(spark, sf_dir, ("dataset", "month"))


@query("scan_results", RECORDS)
def scan_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two of the three keys are read back from the folder names."""
    return stored(spark, sf_dir, ("dataset", "model"))


@query("malformed_results", f"""WITH {q.RESULTS},
r AS (SELECT *, (substr(month, 1, 4)::INTEGER + substr(month, 6, 2)::INTEGER + length(model)) % 7 = 0 AS bad FROM results)
SELECT dataset, month, count(*) FILTER (NOT bad) AS n_good, count(*) FILTER (bad) AS n_bad,
       round(coalesce(sum(ratio) FILTER (NOT bad), 0), 6) AS ratio FROM r GROUP BY ALL""")
def malformed_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of which some are cut off halfway, read back: good ones used, bad ones counted by their path."""
    rows = base(spark, sf_dir).select(*KEYS, "ratio")
    slot = F.substring("month", 1, 4).cast("int") + F.substring("month", 6, 2).cast("int") + F.length("model")
    line = F.to_json(F.struct("model", "ratio"))
    cut = F.when(slot % 7 == 0, F.substring(line, F.lit(1), F.floor(F.length(line) / 2).cast("int"))).otherwise(line)
    path = shared_folder(spark, "malformed")
    rows.select("dataset", "month", cut.alias("value")).write.partitionBy("dataset", "month").text(path)
    good = src.scan_results(spark, path).select("dataset", "month", F.lit(1).alias("n_good"), F.lit(0).alias("n_bad"), "ratio")
    bad = src.malformed_results(spark, path).select("dataset", "month", F.lit(0).alias("n_good"), F.lit(1).alias("n_bad"), F.lit(0.0).alias("ratio"))
    return good.unionByName(bad).groupBy("dataset", "month").agg(
        F.sum("n_good").alias("n_good"), F.sum("n_bad").alias("n_bad"), F.round(F.sum("ratio"), 6).alias("ratio")
    )
