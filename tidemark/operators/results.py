"""Analysis of result records: one row per (dataset, model, month).

After `dedupe_first` a table has at most (datasets x models x months) rows.  Windows
over one series are as long as the calendar.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions import fixed, formats

KEYS = ["dataset", "model", "month"]


# --- union and dedupe -------------------------------------------------------
def union_roots(roots: list[DataFrame]) -> DataFrame:
    """Result folders in priority order, first one wins later."""
    marked = [df.withColumn("priority", F.lit(i)) for i, df in enumerate(roots)]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), marked)


def dedupe_first(results: DataFrame, order: tuple[str, ...] = ("priority", "path")) -> DataFrame:
    """One record per key, from the first root that has it and the first path in that root.

    Columns of `order` that the table lacks are passed over; what is still equal is settled by the record itself, so
    the choice repeats.  min_by combines map-side, so copies of one key never meet in a sort.
    """
    rest = [c for c in results.columns if c not in KEYS]
    ranked = [c for c in order if c in rest] + [c for c in rest if c not in order]
    first = F.min_by(F.struct(*rest), F.struct(*ranked)).alias("_first")
    return results.groupBy(*KEYS).agg(first).select(*KEYS, "_first.*")


# --- model names ------------------------------------------------------------
def exclude_models(results: DataFrame, names: list[str] = fixed.EXCLUDED_MODELS) -> DataFrame:
    return results.where(~F.col("model").isin(names))


def drop_codecs(results: DataFrame) -> DataFrame:
    return exclude_models(results, fixed.CODECS)


def label_dim(spark: SparkSession, labels: dict[str, str] = fixed.MODEL_LABELS) -> DataFrame:
    return spark.createDataFrame(list(labels.items()), "model string, label string")


def label_models(results: DataFrame, labels: dict[str, str] = fixed.MODEL_LABELS) -> DataFrame:
    """Keep only models with a label.  The label table is a fixed list of names."""
    dim = label_dim(results.sparkSession, labels)
    return results.join(F.broadcast(dim), "model")


def model_key(name: Column, context: Column) -> Column:
    """File name of a model's record: no owner part; the context size unless it is the default."""
    short = F.element_at(F.split(name, "/"), -1)
    return F.when(context == fixed.CONTEXT_SIZE, short).otherwise(F.concat_ws("-", short, context.cast("string")))


def context_key(model: Column) -> tuple[Column, Column]:
    """'Qwen-7B-12k' -> ('Qwen-7B', 12); NULL context when the name has none."""
    pattern = "^(.*)-([0-9]+)[kK]$"
    size = F.regexp_extract(model, pattern, 2)
    base = F.when(size != "", F.regexp_extract(model, pattern, 1)).otherwise(model)
    return base, F.when(size != "", size).cast("int")


def is_small(model: Column) -> Column:
    return F.lower(model).contains("7b") | F.lower(model).contains("6b")


def is_large(model: Column) -> Column:
    return any_of(F.lower(model), fixed.LARGE_TAGS)


def is_llama(model: Column) -> Column:
    return model.isin(fixed.LLAMA_FAMILY)


def any_of(text: Column, tags: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [text.contains(tag.lower()) for tag in tags])


def is_long_context(model: Column) -> Column:
    return any_of(F.lower(model), fixed.LONG_CONTEXT_FAMILIES)


def default_visible(label: Column, task: Column) -> Column:
    """Hidden by default when listed, except code models on code-like tasks."""
    code_model = F.lower(label).contains("codellama") & task.isin(fixed.CODE_MODEL_TASKS)
    return code_model | ~label.isin(fixed.HIDDEN_LABELS)


def long_context_visible(family: Column) -> Column:
    """The same for the chart over context sizes, which has a list of its own."""
    return ~family.isin(fixed.LONG_CONTEXT_HIDDEN)


# --- completeness -----------------------------------------------------------
def complete_models(results: DataFrame) -> DataFrame:
    """Series that have a value in every month of their dataset.

    Two windows over the records, so what made the records is computed once.  A window
    holds one row per model and month of a dataset.
    """
    wanted = F.size(F.collect_set("month").over(W.partitionBy("dataset")))
    found = F.count("ratio").over(W.partitionBy("dataset", "model"))
    return results.withColumns({"_want": wanted, "_have": found}).where("_have = _want").drop("_want", "_have")


# --- periods ----------------------------------------------------------------
def in_range(month: Column) -> Column:
    return month.between(fixed.FIRST_MONTH, fixed.LAST_MONTH)


def is_test(month: Column) -> Column:
    return month.between(fixed.TEST_YEAR_START, fixed.LAST_MONTH)


def is_train(month: Column) -> Column:
    return in_range(month) & (month < fixed.TEST_YEAR_START)


def period_averages(results: DataFrame) -> DataFrame:
    """Average ratio over all months, the test year and the months before it."""
    month, ratio = F.col("month"), F.col("ratio")
    return results.groupBy("dataset", "model").agg(
        F.avg(F.when(in_range(month), ratio)).alias("avg_all"),
        F.avg(F.when(is_test(month), ratio)).alias("avg_test"),
        F.avg(F.when(is_train(month), ratio)).alias("avg_train"),
        F.count(F.when(in_range(month), ratio)).alias("n_months"),
    )


def averages_cube(results: DataFrame) -> DataFrame:
    """Averages per (dataset, model), per dataset, per model and over everything, in one pass.

    `level` is the grouping id: bit 1 where the dataset and bit 0 where the model is summed over.
    """
    month, ratio = F.col("month"), F.col("ratio")
    return results.cube("dataset", "model").agg(
        F.grouping_id().cast("int").alias("level"),
        F.avg(F.when(in_range(month), ratio)).alias("avg_all"),
        F.avg(F.when(is_test(month), ratio)).alias("avg_test"),
        F.count(F.when(in_range(month), ratio)).alias("n"),
    )


def robustness_gap(averages: DataFrame) -> DataFrame:
    """Test minus training average, and test minus overall; also in percent."""
    gap, gap_all = F.col("avg_test") - F.col("avg_train"), F.col("avg_test") - F.col("avg_all")
    return averages.select(
        "dataset", "model",
        gap.alias("gap"), gap_all.alias("gap_all"),
        (F.col("avg_test") * 100).alias("performance"), (gap * 100).alias("robustness"),
    )


def coverage(averages: DataFrame, minimum: int = fixed.COVERAGE_MONTHS) -> DataFrame:
    return averages.where(F.col("n_months") < minimum).select("dataset", "model", "n_months")


def formatted(averages: DataFrame) -> DataFrame:
    """The two table cells of a series: overall average, and test average with its gap."""
    gap = F.round((F.col("avg_test") - F.col("avg_train")) * 100, 8)
    return averages.select(
        "dataset", "model",
        formats.fixed_digits(F.round(F.col("avg_all") * 100, 8)).alias("avg_text"),
        formats.with_gap(F.round(F.col("avg_test") * 100, 8), gap).alias("test_text"),
    )


def published_table(results: DataFrame, tasks: list[str] = fixed.TABLE_TASKS) -> DataFrame:
    """Text cells 'task Avg.' and 'task 2023' per model; `dataset` names the task and `model` a raw name.

    The first task drives: models without it are left out, and other tasks may be empty.
    """
    named = label_models(exclude_models(results)).drop("model").withColumnRenamed("label", "model")
    cells = formatted(period_averages(named.where(F.col("dataset").isin(tasks))))
    wide = cells.groupBy("model").pivot("dataset", tasks).agg(F.first("avg_text").alias("Avg."), F.first("test_text").alias("2023"))
    columns = [F.col(f"`{t}_{m}`").alias(f"{t} {m}") for t in tasks for m in ("Avg.", "2023")]
    return wide.where(F.col(f"`{tasks[0]}_Avg.`").isNotNull()).select("model", *columns)


# --- pivots -----------------------------------------------------------------
def pivot_months(results: DataFrame, months: list[str], value: str = "ratio") -> DataFrame:
    """Model x month; the months are given, so no extra job looks for them."""
    return results.groupBy("dataset", "model").pivot("month", months).agg(F.first(value))


def task_matrix(results: DataFrame, driving: str, tasks: list[str], value: str = "ratio") -> DataFrame:
    """Average per task for each model of the driving dataset; other tasks may be empty."""
    averages = [F.avg(F.when(F.col("dataset") == task, F.col(value))).alias(task) for task in tasks]
    wide = results.groupBy("model").agg(F.count_if(F.col("dataset") == driving).alias("_driving"), *averages)
    return wide.where("_driving > 0").drop("_driving")


def context_matrix(results: DataFrame, variants: list[str] = fixed.CONTEXT_VARIANTS) -> DataFrame:
    """Mean ratio of the test months per dataset, model and context variant."""
    test = results.where(is_test(F.col("month")))
    return test.groupBy("dataset", "model").pivot("variant", variants).agg(F.avg("ratio"))


def context_variants(results: DataFrame, variants: list[str]) -> DataFrame:
    """Months for which a model has every one of the given variants, side by side.

    One conditional aggregation in place of a chain of joins.
    """
    wide = results.where(F.col("variant").isin(variants)).groupBy("dataset", "model", "month").pivot("variant", variants).agg(
        F.first("ratio")
    )
    return wide.dropna(subset=variants)


def context_fallback(matrix: DataFrame) -> DataFrame:
    """Where there is no 4K result the long one stands in for it, and 8K is absent."""
    missing = F.col("4K").isNull()
    return matrix.select(
        "dataset", "model", "2K", "2K+SW",
        F.when(missing, F.col("8K")).otherwise(F.col("4K")).alias("4K"),
        F.when(~missing, F.col("8K")).alias("8K"),
    )


def context_curve(results: DataFrame) -> DataFrame:
    """Mean percent per (model, context size) over all months."""
    base, size = context_key(F.col("model"))
    keyed = results.select(base.alias("family"), size.alias("context_size"), "ratio")
    return keyed.where(F.col("context_size").isNotNull()).groupBy("family", "context_size").agg(
        F.avg(F.col("ratio") * 100).alias("performance")
    )


def tokenizer_efficiency(results: DataFrame, models: list[str] = fixed.TOKENIZER_MODELS) -> DataFrame:
    """Token count recovered from size and bits per token, with mean bpt and bpb, in the test year."""
    kept = results.where(F.col("model").isin(models) & is_test(F.col("month")))
    return kept.groupBy("dataset", "model").agg(
        F.sum(F.try_divide(F.col("compressed_size") * 8, "bpt")).alias("total_tokens"),
        F.avg("bpt").alias("mean_bpt"),
        F.avg("bpb").alias("mean_bpb"),
    )


def metric_families(model_metrics: DataFrame, coder_metrics: DataFrame, prefix: str = "ac_") -> DataFrame:
    """Model metrics with those of the interval coder beside them under a prefix."""
    names = {c: prefix + c for c in coder_metrics.columns if c not in KEYS}
    return model_metrics.join(coder_metrics.withColumnsRenamed(names), KEYS, "left")


# --- performance against robustness ----------------------------------------
def plotted(gaps: DataFrame, family: Column | None = None) -> DataFrame:
    """Series of a performance / robustness chart: no excluded models, no codecs, only labelled ones of `family`."""
    named = drop_codecs(exclude_models(label_models(gaps)))
    return named if family is None else named.where(family)


def clamped(gaps: DataFrame) -> DataFrame:
    return gaps.withColumn("robustness", F.greatest("robustness", F.lit(0.0)))


def range_stats(gaps: DataFrame, padding: float = 0.05) -> DataFrame:
    """Limits with padding and midpoints of both measures, per dataset."""
    aggs = []
    for name in ("performance", "robustness"):
        low, high = F.min(name), F.max(name)
        room = (high - low) * padding
        aggs += [
            low.alias(f"min_{name}"), high.alias(f"max_{name}"),
            (low - room).alias(f"from_{name}"), (high + room).alias(f"to_{name}"),
            ((high + low) / 2).alias(f"mid_{name}"),
        ]
    return clamped(gaps).groupBy("dataset").agg(*aggs)


def quadrants(gaps: DataFrame) -> DataFrame:
    """Side of the midpoints each series falls on; lower is better for both.

    A window holds the models of one dataset.
    """
    models = W.partitionBy("dataset")

    def side(name: str) -> Column:
        middle = (F.max(name).over(models) + F.min(name).over(models)) / 2
        return F.when(F.col(name) <= middle, F.lit("low")).otherwise(F.lit("high"))

    return clamped(gaps).select(
        "dataset", "model", "performance", "robustness",
        F.concat_ws("/", side("performance"), side("robustness")).alias("quadrant"),
    )


def leaderboard(averages: DataFrame) -> DataFrame:
    """Place of each model in its dataset by test average; the rows of a dataset are its models."""
    order = W.partitionBy("dataset").orderBy(F.col("avg_test").asc_nulls_last(), "model")
    return averages.select("dataset", "model", "avg_test", F.row_number().over(order).alias("place"))
