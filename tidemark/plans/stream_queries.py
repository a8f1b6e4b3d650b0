"""Streaming jobs run to the end of their input; each must equal the batch result."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import text
from tidemark.plans import sqltext as q
from tidemark.plans.registry import query
from tidemark.session import shared_folder
from tidemark.sources import corpus
from tidemark.streaming import jobs

KEYS = ["dataset", "month"]


def monthly(docs: DataFrame) -> DataFrame:
    return docs.withColumns({
        "dataset": F.col("lang"), "month": corpus.month_slot(F.col("doc_id")), "doc_ord": F.col("doc_id"),
    })


def document_source(spark: SparkSession, sf_dir: str) -> tuple:
    path = f"{sf_dir}/documents.parquet"
    return path, spark.read.parquet(path).schema


def event_source(spark: SparkSession, sf_dir: str) -> tuple:
    path = f"{sf_dir}/events.parquet"
    return path, spark.read.parquet(path).schema


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.watch(spark, *event_source(spark, sf_dir))


MONTHLY = f"""WITH {q.CORPUS}
SELECT dataset, month, sum(strlen(text))::BIGINT AS n_bytes, sum(len({q.words('text')}))::BIGINT AS n_tokens
FROM corpus GROUP BY ALL"""


def sizes() -> dict[str, F.Column]:
    return {"n_bytes": F.octet_length("text"), "n_tokens": F.size(text.words(F.col("text")))}


@query("stream_new_months", MONTHLY)
def stream_new_months(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stream is started twice; the second start finds every month done."""
    root = shared_folder(spark, "new-months")

    def process(df: DataFrame) -> DataFrame:
        return df.groupBy(*KEYS).agg(*[F.sum(c).alias(name) for name, c in sizes().items()])

    for _ in range(2):
        jobs.process_new_keys(spark, *document_source(spark, sf_dir), process, root, monthly)
    return spark.read.parquet(f"{root}/results").select(*KEYS, "n_bytes", "n_tokens")


@query("stream_totals", MONTHLY)
def stream_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = shared_folder(spark, "totals")
    jobs.run_once(jobs.running_totals(monthly(jobs.watch(spark, *document_source(spark, sf_dir))), KEYS, sizes(), root))
    return jobs.latest(spark, root, KEYS)


PERIODS = """last AS (SELECT max(ts) - INTERVAL 1 HOUR AS mark FROM events),
per AS (SELECT date_trunc('day', ts) AS start, event_type, count(*) AS n, avg(value) AS mean FROM events GROUP BY ALL),
closed AS (SELECT * FROM per, last WHERE start + INTERVAL 1 DAY <= mark)"""


def periods(spark: SparkSession, sf_dir: str) -> str:
    root = shared_folder(spark, "periods")
    jobs.run_once(jobs.period_metric(spark, *event_source(spark, sf_dir), "ts", "event_type", "value", "1 day", "1 hour", root))
    return root


@query("stream_periods", f"""WITH {PERIODS}
SELECT strftime(start, '%Y-%m-%d') AS day, event_type, n, round(mean, 6) AS mean FROM closed""")
def stream_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = jobs.closed_periods(spark, periods(spark, sf_dir))
    return rows.select(
        F.date_format("start", "yyyy-MM-dd").alias("day"), "event_type", "n", F.round("mean", 6).alias("mean")
    )


FILES = 8


@query("stream_late", f"""WITH e AS (SELECT *, (event_id * 7 + user_id) % {FILES} AS f FROM events),
tops AS (SELECT f, max(ts) AS top FROM e GROUP BY f),
marks AS (SELECT f, max(top) OVER (ORDER BY f ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - INTERVAL 20 DAY AS mark FROM tops)
SELECT event_id, event_type, strftime(ts, '%Y-%m-%d') AS day, strftime(mark, '%Y-%m-%d %H') AS mark
FROM e JOIN marks USING (f) WHERE date_trunc('day', ts) + INTERVAL 1 DAY <= mark""")
def stream_late(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events that arrive in several files; those whose day is closed by the files before theirs are listed as late."""
    path, schema = event_source(spark, sf_dir)
    root = shared_folder(spark, "late")
    events = spark.read.parquet(path).withColumn("f", ((F.col("event_id") * 7 + F.col("user_id")) % FILES).cast("int"))
    for f in range(FILES):
        events.where(F.col("f") == f).drop("f").coalesce(1).write.parquet(f"{root}/in/f{f}")
    jobs.run_once(jobs.period_metric(spark, f"{root}/in/*", schema, "ts", "event_type", "value", "1 day", "20 days", root, 3))
    return jobs.late_rows(spark, root).select(
        "event_id", "event_type", F.date_format("ts", "yyyy-MM-dd").alias("day"), F.date_format("mark", "yyyy-MM-dd HH").alias("mark")
    )


@query("stream_dedupe", """SELECT user_id, event_type, event_id, ts, value FROM events
QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id, value) = 1""")
def stream_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = shared_folder(spark, "first")
    keys, rest = ["user_id", "event_type"], ["event_id", "ts", "value"]
    jobs.run_once(jobs.first_arrival(event_stream(spark, sf_dir).select(*keys, *rest), "ts", keys, root))
    return jobs.latest(spark, root, keys).select(*keys, *rest)


@query("stream_smoothing", f"""WITH RECURSIVE {PERIODS},
o AS (SELECT event_type, start, mean, row_number() OVER (PARTITION BY event_type ORDER BY start) AS i FROM closed),
y AS (SELECT event_type, start, i, mean AS s FROM o WHERE i = 1
      UNION ALL SELECT o.event_type, o.start, o.i, 0.3::DOUBLE * o.mean + 0.7::DOUBLE * y.s
      FROM y JOIN o ON o.event_type = y.event_type AND o.i = y.i + 1)
SELECT event_type, strftime(start, '%Y-%m-%d') AS day, round(s, 6) AS smoothed FROM y""")
def stream_smoothing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A second stream reads the closed periods of the first."""
    first = periods(spark, sf_dir)
    root = shared_folder(spark, "smoothed")
    stream = jobs.watch(spark, f"{first}/closed/*", jobs.closed_periods(spark, first).schema)
    jobs.run_once(jobs.smooth(stream, "event_type", "start", "mean", root))
    rows = jobs.latest(spark, root, ["event_type", "start"])
    return rows.select("event_type", F.date_format("start", "yyyy-MM-dd").alias("day"), F.round("smoothed", 6).alias("smoothed"))
