"""Repeatable samples inside one record: line runs, byte slices, image patches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import fixed
from tidemark.functions.text import seeded_start
from tidemark.operators.units import line_run

__all__ = ["line_run", "byte_slices", "patches"]


def byte_slices(
    records: DataFrame, column: str = "audio", size: int = fixed.AUDIO_CHUNK_BYTES,
    per_record: int = fixed.AUDIO_CHUNKS_PER_FILE, seed: int = fixed.SHUFFLE_SEED,
) -> DataFrame:
    """`per_record` random slices of a long record; a short one is one slice, whole."""
    n = F.octet_length(column)
    long = n >= size * per_record
    slots = F.when(long, F.sequence(F.lit(0), F.lit(per_record - 1))).otherwise(F.array(F.lit(0)))
    rows = records.select("*", F.explode(slots).alias("slice_ord"))
    key = F.concat_ws(":", "doc_ord", "slice_ord")
    start = F.when(long, seeded_start(key, seed, n - size)).otherwise(F.lit(0))
    width = F.when(long, F.lit(size)).otherwise(n)
    placed = rows.withColumns({"start": start, "_width": width})
    return placed.withColumn(column, F.substring(F.col(column), F.col("start") + 1, F.col("_width"))).drop("_width")


def patches(
    images: DataFrame, height: int = fixed.PATCH_HEIGHT, width: int = fixed.PATCH_WIDTH,
    seed: int = fixed.SHUFFLE_SEED,
) -> DataFrame:
    """One patch per image, row-major; a short side uses the full extent of the image."""
    placed = images.where(F.col("pixels").isNotNull()).withColumns({
        "_w": F.least(F.col("width"), F.lit(width)),
        "_h": F.least((F.size("pixels") / F.col("width")).cast("int"), F.lit(height)),
        "top": seeded_start(
            F.concat_ws(":", "doc_ord", F.lit("top")), seed, (F.size("pixels") / F.col("width")).cast("int") - height
        ),
        "left": seeded_start(F.concat_ws(":", "doc_ord", F.lit("left")), seed, F.col("width") - width),
    })
    rows = F.transform(
        F.sequence(F.col("top"), F.col("top") + F.col("_h") - 1),
        lambda r: F.slice("pixels", r * F.col("width") + F.col("left") + 1, F.col("_w")),
    )
    return placed.withColumn("patch", F.flatten(rows)).drop("_w", "_h")
