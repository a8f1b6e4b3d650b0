"""Result records of a month: a model's bits, or a baseline's size, over the corpus counts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.scoring import metric_columns
from tidemark.operators.results import model_key
from tidemark.sources.stages import todo

KEYS = ["dataset", "month"]


def model_records(
    bits: DataFrame, metadata: DataFrame, model: str, text: bool = True, extra: dict[str, Callable] | None = None,
) -> DataFrame:
    """Metrics per month from the bits of a model; months without a window have NULL ratios.

    Both sides hold one row per month.  `bits` may carry `time_used`.
    """
    joined = metadata.join(bits, KEYS, "left")
    if "time_used" not in joined.columns:
        joined = joined.withColumn("time_used", F.lit(None).cast("double"))
    name = model_key(F.lit(model), F.col("context_size")).alias("model")
    return joined.select(*KEYS, name, *metric_columns(F.col("bits") / 8, text, extra=extra))


def baseline_records(sizes: DataFrame, metadata: DataFrame, text: bool = True) -> DataFrame:
    """Metrics per month and baseline; `sizes`: model and compressed_size per month.

    A baseline compresses the whole stream, while the counts leave out the dropped tail, as
    for models.  It has no context size and no time of its own.
    """
    joined = sizes.withColumnRenamed("compressed_size", "_size").join(
        metadata.withColumns({
            "context_size": F.lit(None).cast("int"), "time_used": F.lit(None).cast("double"),
        }), KEYS,
    )
    return joined.select(*KEYS, "model", *metric_columns(F.col("_size").cast("double"), text))


def with_coder(records: DataFrame, coder: DataFrame, metadata: DataFrame, text: bool = True) -> DataFrame:
    """Add the metrics of the interval coder's whole bytes under the prefix 'ac_'.

    `coder` has `n_bytes` per month.
    """
    sizes = coder.withColumnRenamed("n_bytes", "_size").join(
        metadata.withColumn("time_used", F.lit(None).cast("double")), KEYS
    )
    coded = sizes.select(*KEYS, *metric_columns(F.col("_size").cast("double"), text, prefix="ac_"))
    return records.join(coded, KEYS, "left")


def unscored(docs: DataFrame, records: DataFrame, model: str) -> DataFrame:
    """Documents of months that have no record of the model yet."""
    return todo(docs, records.where(F.col("model") == model), KEYS)
