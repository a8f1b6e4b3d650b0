"""Result records: one small JSON per (dataset, month, model), and tables of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions import fixed
from tidemark.sources.corpus import ship_month

KEYS = ["dataset", "model", "month"]

RECORD = T.StructType([
    T.StructField("bpb", T.DoubleType()),
    T.StructField("original_size", T.LongType()),
    T.StructField("ratio", T.DoubleType()),
    T.StructField("compressed_size", T.DoubleType()),
    T.StructField("context_size", T.StringType()),
    T.StructField("stride", T.StringType()),
    T.StructField("batches", T.LongType()),
    T.StructField("time_used", T.DoubleType()),
    T.StructField("bpt", T.DoubleType()),
    T.StructField("bpc", T.DoubleType()),
])
NESTED = "map<string,map<string,double>>"


def write_results(
    results: DataFrame, path: str, folders: tuple[str, ...] = ("dataset", "month"), mode: str = "overwrite",
) -> None:
    """JSON lines in one folder per key, each written by one of a few range-split tasks."""
    results.repartitionByRange(*folders, *KEYS).write.mode(mode).partitionBy(*folders).json(path)


def path_keys(path: Column) -> dict[str, Column]:
    """Keys from '<dataset>/<month>/<model>.json', or from 'key=value' folders."""

    def folder(name: str, position: str) -> Column:
        named = F.regexp_extract(path, f"{name}=([^/]+)", 1)
        return F.when(named != "", F.url_decode(named)).otherwise(F.regexp_extract(path, position, 1))

    return {
        "dataset": folder("dataset", r"([^/]+)/[^/]+/[^/]+$"),
        "month": folder("month", r"([^/]+)/[^/]+$"),
        "model": folder("model", r"([^/]+)\.json$"),
    }


def path_model(path: Column) -> Column:
    """File name without its .json ending, so 'Qwen1.5-7B' keeps its dot."""
    return F.regexp_extract(path, r"([^/]+)\.json$", 1)


def _records(spark: SparkSession, path: str, pretty: bool) -> DataFrame:
    """Records with keys and `_bad`, the text of those that are no JSON object of this schema."""
    keys = [T.StructField(k, T.StringType()) for k in KEYS]
    schema = T.StructType([*keys, *RECORD.fields, T.StructField("_bad", T.StringType())])
    reader = spark.read.schema(schema).option("recursiveFileLookup", "true").option("columnNameOfCorruptRecord", "_bad")
    raw = reader.option("mode", "PERMISSIVE").option("multiLine", str(pretty).lower()).json(path)
    # Always true, and looks at every field: a field that a query doesn't need isn't parsed, and its fault not seen.
    raw = raw.where(F.xxhash64(*RECORD.fieldNames()) % 1 == 0)
    from_path = path_keys(F.col("_metadata.file_path"))
    return raw.withColumns({"path": F.col("_metadata.file_path")} | {k: F.coalesce(F.col(k), from_path[k]) for k in KEYS})


def malformed_results(spark: SparkSession, path: str, pretty: bool = False) -> DataFrame:
    """dataset, month, model (as far as the path tells), path and text of the records that `scan_results` leaves out."""
    bad = _records(spark, path, pretty).where(F.col("_bad").isNotNull())
    return bad.select(*KEYS, "path", F.col("_bad").alias("record"))


def scan_results(spark: SparkSession, path: str, pretty: bool = False) -> DataFrame:
    """All well-formed records below a folder; keys come from the record, or else from its path.

    `pretty` reads files that hold one indented object each.  The text 'None' reads as NULL.  One broken file stops
    nothing: what can't be read is listed by `malformed_results`.
    """
    raw = _records(spark, path, pretty).where(F.col("_bad").isNull()).drop("_bad", "path")
    sized = {n: F.expr(f"try_cast({n} as int)") for n in ("context_size", "stride")}
    return raw.withColumns(sized)


def nested_export(results: DataFrame, value: str = "ratio") -> DataFrame:
    """Per dataset and model one JSON object month -> value, months sorted.

    A model has one row per month, so the collected list is as long as the calendar.
    """
    months = F.array_sort(F.collect_list(F.struct("month", value)))
    return results.groupBy("dataset", "model").agg(
        F.to_json(F.map_from_entries(months)).alias("by_month")
    )


def nested_documents(results: DataFrame, value: str = "ratio") -> DataFrame:
    """Per dataset the whole nested object model -> month -> value, both levels sorted."""
    months = F.map_from_entries(F.array_sort(F.collect_list(F.struct("month", value))))
    series = results.groupBy("dataset", "model").agg(months.alias("months"))
    rows = F.collect_list(F.struct("model", F.to_json("months").alias("months")))
    sorted_rows = F.transform(F.array_sort(rows), lambda m: F.struct(
        m["model"], F.from_json(m["months"], "map<string,double>")
    ))
    return series.groupBy("dataset").agg(F.to_json(F.map_from_entries(sorted_rows)).alias("value"))


def nested_import(exported: DataFrame, column: str = "by_month") -> DataFrame:
    """JSON objects month -> value back to rows."""
    parsed = F.from_json(column, "map<string,double>")
    return exported.select("dataset", "model", F.explode(parsed).alias("month", "ratio"))


def nested_document(text: DataFrame, column: str = "value") -> DataFrame:
    """A whole nested JSON document model -> month -> value to rows."""
    outer = text.select(F.explode(F.from_json(column, NESTED)).alias("model", "_months"))
    return outer.select("model", F.explode("_months").alias("month", "ratio"))


# --- results made from the given tables -------------------------------------
BRAND_MODELS = [
    *[m for m in fixed.MODEL_LABELS if m not in fixed.CODECS],
    *fixed.EXCLUDED_MODELS, *fixed.CODECS,
    "Qwen-7B-12288-long", "Qwen1.5-7B-12288-long",
]


def brand_model(brand: Column) -> Column:
    """Model name of 'Brand#1' ... 'Brand#25'."""
    number = F.regexp_extract(brand, "([0-9]+)$", 1).cast("int")
    return F.element_at(F.array(*[F.lit(m) for m in BRAND_MODELS]), number)


def line_results(spark: SparkSession, sf_dir: str, *more: str | Column) -> DataFrame:
    """lineitem and part as result records; sizes are whole cents, so sums are exact.

    `more` adds line columns to the keys.  Spark broadcasts part while it is small and
    shuffles both sides by part once it is not; a part with a large share of all lines
    is then split by the adaptive skew join.  The sums combine map-side, so only a few
    rows per task go on from the join.
    """
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    part = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", brand_model(F.col("p_brand")).alias("model"))
    # Money is never negative here; round() would go through a decimal object per value.
    cents = F.floor(F.col("l_extendedprice") * 100 + 0.5)
    share = F.floor(F.col("l_discount") * 100 + 0.5)
    summed = lines.join(part, F.col("l_partkey") == F.col("p_partkey")).groupBy(
        F.col("l_returnflag").alias("dataset"), "model", ship_month(F.col("l_shipdate")).alias("month"), *more,
    ).agg(
        F.sum(cents).alias("original_size"),
        (F.sum(cents * share) / 100).alias("compressed_size"),
        F.sum(F.col("l_quantity").cast("bigint")).alias("num_tokens"),
        F.count("*").alias("batches"),
    )
    return summed.withColumn("ratio", F.try_divide("compressed_size", "original_size"))
