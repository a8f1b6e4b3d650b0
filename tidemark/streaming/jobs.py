"""Structured Streaming for months that keep arriving.

Every job reads a stream, keeps its state under a checkpoint and writes files, so a lost executor or a restart goes on
from the last committed batch.  What a batch writes goes to a folder of its number and replaces that folder, so a
batch that is run again leaves the same files.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager
from urllib.parse import unquote

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery

from tidemark.functions import fixed
from tidemark.session import table_or_none
from tidemark.sources.stages import todo

KEYS = ["dataset", "month"]


def watch(spark: SparkSession, path: str, schema: T.StructType, files_per_batch: int = 1000) -> DataFrame:
    """A Parquet table, a folder of files or a lone one, as a stream.  No result depends on `files_per_batch`.

    A stream takes a plain path for a folder; a pattern, here one that only the path itself matches, may be a file too.
    """
    path = path.rstrip("/")
    if not set(path) & set("*?[{"):
        path = f"{path[:-1]}[{path[-1]}]"
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def _start(writer, root: str) -> StreamingQuery:
    return writer.option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start()


def run_once(query: StreamingQuery) -> None:
    query.awaitTermination()


def _unchanged(rows: DataFrame) -> DataFrame:
    return rows


# --- new keys only ----------------------------------------------------------
def process_new_keys(
    spark: SparkSession, path: str, schema: T.StructType, process: Callable[[DataFrame], DataFrame], root: str,
    shape: Callable[[DataFrame], DataFrame] = _unchanged, keys: list[str] = KEYS, files_per_batch: int = 1000,
) -> None:
    """Run `process` on the rows whose key has no result yet, when all that has arrived is read, and add its result.

    `schema` names columns that are in the files; `shape` makes rows with `keys` from those of the files.  A key counts as done once a run that read it has ended, so
    its rows may come in any number of batches of that run.  No row is kept: the stream writes a log of which file
    holds which keys, `process` reads the files of open keys at their place, and `closed` names the last batch that is in the
    results, so what an interrupted run has logged is taken up by the next.  Results go to one folder per key.
    """
    target, log, closed = f"{root}/results", f"{root}/log", f"{root}/closed"

    def batch(df: DataFrame, batch_id: int) -> None:
        df.distinct().write.mode("overwrite").parquet(f"{log}/batch={batch_id}")

    arrived = watch(spark, path, schema, files_per_batch)
    run_once(_start(shape(arrived.withColumn("_file", F.col("_metadata.file_path"))).select("_file", *keys).writeStream.foreachBatch(batch), root))
    seen, ends = table_or_none(spark, log), table_or_none(spark, closed)
    if seen is None:
        return
    last = -1 if ends is None else ends.agg(F.max("batch")).first()[0]
    newest = seen.agg(F.max("batch")).first()[0]
    if newest is None or newest <= last:
        return
    done = table_or_none(spark, target)

    def is_open(rows: DataFrame) -> DataFrame:
        return rows if done is None else todo(rows, done, keys)

    # A scan is given its files by the driver in any case; here these are the ones with an open key.
    files = [unquote(r["_file"]) for r in is_open(seen.where(F.col("batch") > last)).select("_file").distinct().collect()]
    if files:
        rows = is_open(shape(spark.read.schema(schema).parquet(*files).withColumn("_file", F.lit(None).cast("string"))).drop("_file"))
        (
            process(rows).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(target)
        )
    spark.range(1).select(F.lit(newest).alias("batch")).write.mode("append").parquet(closed)


# --- running aggregates -----------------------------------------------------
#: After so many batches their rows are merged into a snapshot.
COMPACT = 16


def _newest(rows: DataFrame, keys: list[str]) -> DataFrame:
    rest = [c for c in rows.columns if c not in (*keys, "batch")]
    newest = F.max_by(F.struct(*rest), "batch").alias("_row")
    return rows.groupBy(*keys).agg(newest, F.max("batch").alias("batch")).select(*keys, "_row.*", "batch")


def _history(spark: SparkSession, root: str, upto: int | None = None) -> tuple[DataFrame, int]:
    """The newest snapshot that is complete and all rows of batches after it; the number the snapshot ends with."""
    rows = spark.read.parquet(f"{root}/updates")
    if upto is not None:
        rows = rows.where(F.col("batch") <= upto)
    known = table_or_none(spark, f"{root}/compacted")
    last = None if known is None else known.agg(F.max("upto")).first()[0]
    if last is None:
        return rows, -1
    return spark.read.parquet(f"{root}/snapshots/upto-{last}").unionByName(rows.where(F.col("batch") > last)), last


def _updates(totals: DataFrame, keys: list[str], root: str, mode: str = "update", compact: int = COMPACT) -> StreamingQuery:
    """Each batch leaves the rows of the groups it changed; every `compact` batches a snapshot of all groups is written."""

    def batch(df: DataFrame, batch_id: int) -> None:
        spark = df.sparkSession
        df.write.mode("overwrite").parquet(f"{root}/updates/batch={batch_id}")
        known = table_or_none(spark, f"{root}/compacted") if (batch_id + 1) % compact == 0 else None
        if (batch_id + 1) % compact == 0 and (known is None or known.where(F.col("upto") == batch_id).isEmpty()):
            rows, _ = _history(spark, root, batch_id)
            _newest(rows, keys).write.mode("overwrite").parquet(f"{root}/snapshots/upto-{batch_id}")
            spark.range(1).write.mode("overwrite").parquet(f"{root}/compacted/upto={batch_id}")

    return _start(totals.writeStream.outputMode(mode).foreachBatch(batch), root)


def running_totals(stream: DataFrame, keys: list[str], sums: dict[str, Column], root: str, compact: int = COMPACT) -> StreamingQuery:
    """Sums per key."""
    return _updates(stream.groupBy(*keys).agg(*[F.sum(c).alias(name) for name, c in sums.items()]), keys, root, compact=compact)


def latest(spark: SparkSession, root: str, keys: list[str]) -> DataFrame:
    """The newest row of each key: from the last snapshot and the batches after it, not from every batch ever written."""
    rows, _ = _history(spark, root)
    return _newest(rows, keys).drop("batch")


# --- closed periods ---------------------------------------------------------
def period_metric(
    spark: SparkSession, path: str, schema: T.StructType, time: str, series: str, value: str, period: str, delay: str, root: str,
    files_per_batch: int = 1000,
) -> StreamingQuery:
    """Mean per (series, period), closed by a watermark that the data carry.

    The mark of a file is the latest time in all files before it (by modification time, then path) less `delay`.  A row
    whose period ended at or before the mark of its file is late: it counts nowhere and goes to a table of late rows.
    Neither depends on how files fall into batches, as a batch's own numbers would.  What is kept is one row for each
    series and period that is still open; closed ones are put out and leave the state.
    """
    stream = watch(spark, path, schema, files_per_batch)
    timed = stream.withColumns({
        "_ts": F.col(time).cast("timestamp"), "_file": F.struct(F.col("_metadata.file_modification_time").alias("at"), F.col("_metadata.file_path").alias("path")),
    })
    interval = F.expr(f"INTERVAL {delay}")

    def batch(df: DataFrame, batch_id: int) -> None:
        session = df.sparkSession
        before = state(session, root, batch_id)
        start = session.range(1).select(F.lit(None).cast("timestamp").alias("newest")) if before is None else before.agg(F.max("newest").alias("newest"))
        # One row per file of the batch, at most `files_per_batch` of them.
        files = df.groupBy("_file").agg(F.max("_ts").alias("top")).crossJoin(start)
        earlier = W.orderBy("_file").rowsBetween(W.unboundedPreceding, -1)
        upto = W.orderBy("_file").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
        marks = files.select(
            "_file", (F.greatest("newest", F.max("top").over(earlier)) - interval).alias("mark"),
            F.greatest("newest", F.max("top").over(upto)).alias("newest"),
        )
        marks.write.mode("overwrite").parquet(f"{root}/marks/batch={batch_id}")
        marks = session.read.schema(marks.schema).parquet(f"{root}/marks/batch={batch_id}")
        rows = df.where("_ts IS NOT NULL").withColumn("_w", F.window("_ts", period)).join(F.broadcast(marks), "_file")
        is_late = F.coalesce(F.col("_w.end") <= F.col("mark"), F.lit(False))
        rows.where(is_late).select(*schema.names, "mark").write.mode("overwrite").parquet(f"{root}/late/batch={batch_id}")
        sums = rows.where(~is_late).groupBy(F.col("_w.start").alias("start"), F.col("_w.end").alias("end"), series).agg(
            F.count(F.lit(1)).alias("n"), F.count(value).alias("n_value"), F.sum(F.col(value).cast("double")).alias("total")
        )
        if before is not None:
            sums = sums.unionByName(before.where("start IS NOT NULL").select(*sums.columns)).groupBy("start", "end", series).agg(
                *(F.sum(c).alias(c) for c in ("n", "n_value", "total"))
            )
        newest = start if marks.isEmpty() else marks.agg(F.max("newest").alias("newest"))
        both = sums.crossJoin(F.broadcast(newest)).withColumn("closed", F.coalesce(F.col("end") <= F.col("newest") - interval, F.lit(False)))
        mean = F.try_divide("total", "n_value").alias("mean")
        both.where("closed").select("start", "end", series, "n", mean).write.mode("overwrite").parquet(f"{root}/closed/batch={batch_id}")
        # A row without a period carries the newest time on when no period is open.
        still = both.where("NOT closed").drop("closed")
        carried = newest.select(*[F.col(c) if c == "newest" else F.lit(None).cast(still.schema[c].dataType).alias(c) for c in still.columns])
        still.unionByName(carried).write.mode("overwrite").parquet(f"{root}/open/batch={batch_id}")

    return _start(timed.writeStream.foreachBatch(batch), root)


def state(spark: SparkSession, root: str, before: int | None = None) -> DataFrame | None:
    """Open periods after the last batch, or the last one before batch `before`."""
    rows = table_or_none(spark, f"{root}/open")
    if rows is None:
        return None
    rows = rows if before is None else rows.where(F.col("batch") < before)
    last = rows.agg(F.max("batch")).first()[0]
    return None if last is None else spark.read.parquet(f"{root}/open/batch={last}")


def closed_periods(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.parquet(f"{root}/closed").drop("batch")


def late_rows(spark: SparkSession, root: str) -> DataFrame:
    """Rows that came after their period was closed, with the mark that closed it."""
    return spark.read.parquet(f"{root}/late").drop("batch")


# --- first one wins ---------------------------------------------------------
def first_arrival(stream: DataFrame, time: str, keys: list[str], root: str) -> StreamingQuery:
    """The row of each key that is first by `time`, then by its other columns; read it with `latest`.

    State holds one row per key and never expires, so a copy that comes late can't count as new.  min_by combines
    map-side: a key with very many copies sends one row per task.
    """
    rest = [c for c in stream.columns if c not in keys]
    first = F.min_by(F.struct(*rest), F.struct(time, *[c for c in rest if c != time])).alias("_first")
    return _updates(stream.groupBy(*keys).agg(first).select(*keys, "_first.*"), keys, root)


# --- smoothing --------------------------------------------------------------
STATE_STORE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}


@contextmanager
def _settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


class _Smoother(StatefulProcessor):
    """Map state of a series: period -> value and level.  A period that arrives changes the levels from there on."""

    def __init__(self, series: str, period: str, value: str, period_type: T.DataType, alpha: float):
        self.names, self.alpha = (series, period, value), alpha
        self.key = T.StructType([T.StructField("period", period_type)])

    def init(self, handle) -> None:
        self.points = handle.getMapState("points", self.key, "value double, level double")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        series, period, value = self.names
        new: dict = {}
        for frame in rows:
            frame = frame.dropna(subset=[period, value])
            for at, x in zip(frame[period].dt.to_pydatetime() if hasattr(frame[period], "dt") else frame[period], frame[value]):
                new[at] = max(x, new.get(at, x))
        known = {k[0]: (v[0], v[1]) for k, v in self.points.iterator()}
        changed = {at: x for at, x in new.items() if at not in known or x > known[at][0]}
        if not changed:
            return
        first = min(changed)
        earlier = [at for at in known if at < first]
        level = known[max(earlier)][1] if earlier else None
        values = {at: v[0] for at, v in known.items() if at > first} | changed
        out = []
        for at in sorted(values):
            level = values[at] if level is None else self.alpha * values[at] + (1 - self.alpha) * level
            self.points.updateValue((at,), (float(values[at]), float(level)))
            out.append((key[0], at, level))
        yield pd.DataFrame(out, columns=[series, period, "smoothed"])

    def close(self) -> None:
        pass


def smooth(
    stream: DataFrame, series: str, period: str, value: str, root: str, alpha: float = fixed.SMOOTHING_ALPHA,
) -> StreamingQuery:
    """Exponential smoothing of period means, whatever the order they arrive in; read it with `latest`.

    Input is one row per (series, period); of rows that repeat one the largest value counts, and rows without a
    period or a value don't.  The state holds each period's value and level.  A period that comes late folds its series
    anew from there on, and the changed levels are put out again.
    """
    fields = {f.name: f.dataType for f in stream.schema}
    out = T.StructType([
        T.StructField(series, fields[series]), T.StructField(period, fields[period]),
        T.StructField("smoothed", T.DoubleType()),
    ])
    with _settings(stream.sparkSession, STATE_STORE):
        levels = stream.select(series, period, F.col(value).cast("double").alias(value)).groupBy(series).transformWithStateInPandas(
            _Smoother(series, period, value, fields[period], alpha), out, "update", "none"
        )
        return _updates(levels, [series, period], root)
