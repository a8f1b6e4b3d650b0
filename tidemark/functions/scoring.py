"""Scores of generated answers and the registry of compression metrics."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions.text import strip

WHOLE_WORD = r"(^|[^\p{{L}}\p{{N}}_]){}($|[^\p{{L}}\p{{N}}_])"


# --- answers ----------------------------------------------------------------
def contains_answer(out: Column, ref_answer: Column) -> Column:
    return F.lower(out).contains(F.lower(ref_answer))


def verdict(text: Column, whole_words: bool = False) -> Column:
    """true on 'yes', else false on 'no', else NULL; by substring unless asked otherwise."""
    low = F.lower(text)
    if whole_words:
        yes, no = low.rlike(WHOLE_WORD.format("yes")), low.rlike(WHOLE_WORD.format("no"))
    else:
        yes, no = low.contains("yes"), low.contains("no")
    return F.when(yes, F.lit(True)).when(no, F.lit(False))


def _mean(values: Column) -> Column:
    """Average of a short array, NULLs left out; NULL when nothing is left."""
    kept = F.filter(values, lambda v: v.isNotNull())
    total = F.aggregate(kept, F.lit(0.0), lambda a, v: a + v.cast("double"))
    return F.try_divide(total, F.size(kept).cast("double"))


def substring_accuracy(outs: Column, ref_answer: Column) -> Column:
    return _mean(F.transform(outs, lambda o: contains_answer(o, ref_answer).cast("int")))


def judge_accuracy(judges: Column) -> Column:
    return _mean(F.transform(judges, lambda j: verdict(j).cast("int")))


def edit_distance_score(outs: Column, ref_answer: Column) -> Column:
    """Share of the reference that survives the mean edit distance; may be negative."""
    ref = F.lower(strip(ref_answer))
    distance = _mean(F.transform(outs, lambda o: F.levenshtein(ref, F.lower(strip(o)))))
    size = F.length(ref_answer).cast("double")
    return F.try_divide(size - distance, size)


# --- compression metrics ----------------------------------------------------
METRICS: dict[str, Callable[[Column], Column]] = {
    "bpb": lambda size: F.try_divide(size * 8, F.col("num_bytes")),
    "original_size": lambda size: F.col("num_bytes"),
    "ratio": lambda size: F.try_divide(size, F.col("num_bytes")),
    "compressed_size": lambda size: size,
    "context_size": lambda size: F.col("context_size"),
    "stride": lambda size: F.col("stride"),
    "batches": lambda size: F.col("num_chunks"),
    "time_used": lambda size: F.col("time_used"),
}
TEXT_METRICS: dict[str, Callable[[Column], Column]] = {
    "bpt": lambda size: F.try_divide(size * 8, F.col("num_tokens")),
    "bpc": lambda size: F.try_divide(size * 8, F.col("num_chars")),
}


def metric_columns(size: Column, text: bool = True, prefix: str = "", extra: dict | None = None) -> list[Column]:
    """Metric columns of one compressed size; `extra` adds or replaces entries by name."""
    registry = {**METRICS, **(TEXT_METRICS if text else {}), **(extra or {})}
    return [make(size).alias(prefix + name) for name, make in registry.items()]
