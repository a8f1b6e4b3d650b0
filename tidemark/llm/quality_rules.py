"""Quality rules with host verdicts.

Each document is measured and judged by rules.  Failures are summed by host (`source`).  A host's rate for a rule is
shrunk towards all hosts: a beta prior is fitted to the hosts' rates by moments, and the posterior mean is used, so
a host with few documents is judged mostly by the prior.  A host whose shrunk rate for a rule is above `host_limit`
fails, and its verdict is joined back to its documents.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.store import written

_SYMBOL = re.compile(r"[#*$%&|<>]")
RULES = ("short", "repetitive", "symbols", "dup_lines", "word_length")
METRICS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long"
#: Host tables up to this many rows are broadcast; larger ones are joined by a shuffle.
BROADCAST_ROWS = 10_000


def measure(text: str) -> tuple[int, int, int, int, int, int]:
    """The six numbers of METRICS for one text."""
    words = text.encode().split()  # bytes.split() splits at the six ASCII white-space characters exactly
    seen, dups, lines = set(), 0, 0
    if "\n" in text:
        for line in text.split("\n"):
            if line.strip(" \t\n\r\x0b\x0c"):
                lines += 1
                dups += line in seen
                seen.add(line)
    else:
        lines = int(bool(words))
    windows = list(zip(words, words[1:], words[2:]))
    repeat = 0
    if len(set(windows)) < len(windows):
        times, covered = Counter(windows), 0  # covered: first place not yet counted
        for i, w in enumerate(windows):
            if times[w] > 1:
                repeat += i + 3 - max(i, covered)
                covered = i + 3
    chars = len(b"".join(words).decode())
    return len(words), chars, len(_SYMBOL.findall(text)), dups, repeat, lines


def metrics(docs: DataFrame) -> DataFrame:
    """doc_id, host and METRICS per row.  Null text has no words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [measure(t or "") for t in batch.column("text").to_pylist()]
            cols = list(zip(*rows)) if rows else [[]] * 6
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("host"), *(pa.array(c, pa.int64()) for c in cols)],
                ["doc_id", "host", *(m.split()[0] for m in METRICS.split(", "))],
            )

    source = docs.select(F.col("doc_id").cast("long"), F.col("source").cast("string").alias("host"), "text")
    return source.mapInArrow(run, f"doc_id long, host string, {METRICS}")


def failures() -> dict[str, F.Column]:
    """Rules in whole numbers, so no rounding decides."""
    c = F.col
    return {
        "short": c("n_words") < 50,
        "repetitive": 100 * c("n_repeat_words") > 50 * c("n_words"),
        "symbols": 10 * c("n_symbols") > c("n_words"),
        "dup_lines": 10 * c("n_dup_lines") > 3 * c("n_lines"),
        "word_length": (c("word_chars") < 2 * c("n_words")) | (c("word_chars") > 15 * c("n_words")),
    }


def host_verdicts(measured: DataFrame, host_limit: float = 0.5) -> DataFrame:
    """host, n_docs, host_rate (largest shrunk rate), host_failed.  Documents without a host have no verdict.

    Moments: with mean m and variance v of the hosts' rates, the prior's weight is m(1-m)/v - 1, at least 1; hosts
    that all have the same rate give the weight 1e6.
    """
    counts = measured.where("host IS NOT NULL").groupBy("host").agg(
        F.count(F.lit(1)).alias("n_docs"), *(F.sum(f.cast("long")).alias(name) for name, f in failures().items())
    )
    counts = written(counts, "hosts")
    rate = {r: F.col(r) / F.col("n_docs") for r in RULES}
    prior = counts.agg(
        *(F.avg(rate[r]).alias(f"m_{r}") for r in RULES), *(F.var_pop(rate[r]).alias(f"v_{r}") for r in RULES)
    )  # one row
    joined = counts.join(F.broadcast(prior))
    shrunk = []
    for r in RULES:
        m, v = F.col(f"m_{r}"), F.col(f"v_{r}")
        weight = F.when(v > 1e-12, F.greatest(F.lit(1.0), m * (1 - m) / F.greatest(v, F.lit(1e-12)) - 1)).otherwise(1e6)
        shrunk.append((F.col(r) + m * weight) / (F.col("n_docs") + weight))
    return joined.select(
        "host", "n_docs", F.greatest(*shrunk).alias("host_rate"), (F.greatest(*shrunk) > host_limit).alias("host_failed")
    )


def quality(docs: DataFrame, host_limit: float = 0.5) -> DataFrame:
    """doc_id, METRICS without n_lines, base_failed, kept, host_rate; one row per row of `docs`.

    docs: doc_id, text, source; other columns are ignored.  kept is false if base_failed, else true unless the
    document's host failed.  Null source: no host verdict, host_rate null.  Empty table: no rows.
    """
    measured = written(metrics(docs), "metrics")
    hosts = written(host_verdicts(measured, host_limit), "verdicts")
    if hosts.count() <= BROADCAST_ROWS:
        hosts = F.broadcast(hosts)
    rules = failures()
    failed = rules["short"] | rules["repetitive"]
    return measured.join(hosts, "host", "left").select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"),
        (~failed & ~F.coalesce("host_failed", F.lit(False))).alias("kept"),
        "host_rate",
    )


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("host_rate")


_SQL_RULES = {
    "short": "n_words < 50",
    "repetitive": "100 * n_repeat_words > 50 * n_words",
    "symbols": "10 * n_symbols > n_words",
    "dup_lines": "10 * n_dup_lines > 3 * n_lines",
    "word_length": "(word_chars < 2 * n_words OR word_chars > 15 * n_words)",
}
_SQL_SHRUNK = ", ".join(
    f"(h.{r} + m_{r} * w_{r}) / (h.n_docs + w_{r})" for r in RULES
)
OP5_SQL = rf"""
WITH d AS (
  SELECT doc_id, source AS host, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), places AS (
  SELECT doc_id, i, w[i] || ' ' || w[i+1] || ' ' || w[i+2] AS g
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d)
), again AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM places) WHERE n > 1
), repeats AS (
  SELECT doc_id, count(DISTINCT i + k) AS n FROM again, (VALUES (0), (1), (2)) v(k) GROUP BY doc_id
), rows AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d
), dups AS (
  SELECT doc_id, count(*) - count(DISTINCT line) AS n, count(*) AS lines FROM rows
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id
), m AS (
  SELECT d.doc_id, host, len(w) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
         CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
         coalesce(dups.n, 0) AS n_dup_lines, coalesce(repeats.n, 0) AS n_repeat_words, coalesce(dups.lines, 0) AS n_lines
  FROM d LEFT JOIN repeats USING (doc_id) LEFT JOIN dups USING (doc_id)
), h AS (
  SELECT host, count(*) AS n_docs, {', '.join(f'count(*) FILTER ({c}) AS {r}' for r, c in _SQL_RULES.items())}
  FROM m WHERE host IS NOT NULL GROUP BY host
), p AS (SELECT {', '.join(f'avg({r} / n_docs) AS m_{r}, var_pop({r} / n_docs) AS v_{r}' for r in RULES)} FROM h
), q AS (SELECT *, {', '.join(f'CASE WHEN v_{r} > 1e-12 THEN greatest(1.0, m_{r} * (1 - m_{r}) / greatest(v_{r}, 1e-12) - 1) ELSE 1e6 END AS w_{r}' for r in RULES)} FROM p
), verdict AS (SELECT h.host, greatest({_SQL_SHRUNK}) > 0.5 AS host_failed FROM h, q)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       ({_SQL_RULES['short']} OR {_SQL_RULES['repetitive']}) AS base_failed,
       NOT ({_SQL_RULES['short']} OR {_SQL_RULES['repetitive']}) AND NOT coalesce(host_failed, false) AS kept
FROM m LEFT JOIN verdict USING (host)
"""
