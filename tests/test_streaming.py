"""Streams over files that arrive in several steps, against the batch result."""

from __future__ import annotations

import datetime as dt
import pathlib
import random

import pytest
from pyspark.sql import functions as F

from tidemark.streaming import jobs

SCHEMA = "dataset string, month string, n bigint"


def drop(spark, folder, name, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("overwrite").parquet(f"{folder}/{name}")


@pytest.fixture
def folder(tmp_path):
    return str(tmp_path / "in put")


def fields(spark, schema):
    return spark.createDataFrame([], schema).schema


def watch(spark, folder, schema):
    return jobs.watch(spark, f"{folder}/*", fields(spark, schema))


def totals(df):
    return df.groupBy(*jobs.KEYS).agg(F.sum("n").alias("n"))


def written_bytes(folder):
    return sum(f.stat().st_size for f in pathlib.Path(folder).rglob("*.parquet"))


def test_only_new_months_are_processed(spark, folder, tmp_path):
    root = str(tmp_path / "out")
    source = (spark, f"{folder}/*", fields(spark, SCHEMA))
    drop(spark, folder, "one", [("d", "2020-01", 1), ("d", "2020-01", 2)], SCHEMA)
    jobs.process_new_keys(*source, totals, root)
    drop(spark, folder, "two", [("d", "2020-01", 100), ("d", "2020-02", 5)], SCHEMA)
    jobs.process_new_keys(*source, totals, root)
    jobs.process_new_keys(*source, totals, root)
    got = {r.month: r.n for r in spark.read.parquet(f"{root}/results").collect()}
    assert got == {"2020-01": 3, "2020-02": 5}


def test_no_row_is_kept_twice(spark, folder, tmp_path):
    """What a run writes grows with files and keys, not with rows."""
    root, schema = str(tmp_path / "out"), SCHEMA + ", text string"
    rows = [("d", "2020-01", i, f"{i * 7919 % 104729} some text {i}" * 5) for i in range(5_000)]
    drop(spark, folder, "one", rows, schema)
    jobs.process_new_keys(spark, f"{folder}/*", fields(spark, schema), totals, root)
    assert written_bytes(root) < written_bytes(folder) / 20
    assert spark.read.parquet(f"{root}/log").count() == 1


def test_an_interrupted_run_is_taken_up(spark, folder, tmp_path):
    root = str(tmp_path / "out")
    source = (spark, f"{folder}/*", fields(spark, SCHEMA))
    drop(spark, folder, "one", [("d", "2020-01", 1)], SCHEMA)

    def fails(df):
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError):
        jobs.process_new_keys(*source, fails, root)
    drop(spark, folder, "two", [("d", "2020-01", 2), ("d", "2020-02", 7)], SCHEMA)
    jobs.process_new_keys(*source, totals, root)
    assert {r.month: r.n for r in spark.read.parquet(f"{root}/results").collect()} == {"2020-01": 3, "2020-02": 7}


def test_running_totals_over_two_starts(spark, folder, tmp_path):
    root = str(tmp_path / "out")
    for name, rows in [("one", [("d", "2020-01", 1), ("d", "2020-02", 7)]), ("two", [("d", "2020-01", 100)])]:
        drop(spark, folder, name, rows, SCHEMA)
        stream = watch(spark, folder, SCHEMA)
        jobs.run_once(jobs.running_totals(stream, jobs.KEYS, {"n": F.col("n")}, root))
    got = {r.month: r.n for r in jobs.latest(spark, root, jobs.KEYS).collect()}
    assert got == {"2020-01": 101, "2020-02": 7}


EVENTS = "ts timestamp_ntz, series string, value double"


def at(day, hour=0):
    return dt.datetime(2024, 1, day, hour)


CUTS = (1, 2, 1000)


def every_cut(spark, folder, schema):
    """The same files one by one, two by two, and in one batch."""
    return [(n, jobs.watch(spark, f"{folder}/*", fields(spark, schema), n)) for n in CUTS]


def test_a_month_may_span_batches(spark, folder, tmp_path):
    for i in range(4):
        drop(spark, folder, f"f{i}", [("d", "2020-01", 10**i), ("d", "2020-02", i)], SCHEMA)
    for n in CUTS:
        root = str(tmp_path / f"out{n}")
        jobs.process_new_keys(spark, f"{folder}/*", fields(spark, SCHEMA), totals, root, files_per_batch=n)
        assert {r.month: r.n for r in spark.read.parquet(f"{root}/results").collect()} == {"2020-01": 1111, "2020-02": 6}


def test_lone_file_and_folder(spark, folder, tmp_path):
    import glob

    drop(spark, folder, "t.parquet", [("d", "2020-01", 1), ("d", "2020-01", 2)], SCHEMA)
    lone = glob.glob(f"{folder}/t.parquet/part-*")[0]
    for i, path in enumerate((f"{folder}/t.parquet", lone)):
        root = str(tmp_path / f"out{i}")
        jobs.run_once(jobs.running_totals(jobs.watch(spark, path, fields(spark, SCHEMA)), jobs.KEYS, {"n": F.col("n")}, root))
        assert [r.n for r in jobs.latest(spark, root, jobs.KEYS).collect()] == [3]


def test_snapshots_replace_old_batches(spark, folder, tmp_path):
    for i in range(7):
        drop(spark, folder, f"f{i}", [("d", "2020-01", 10**i), ("d", f"2021-0{i + 1}", i)], SCHEMA)
    root = str(tmp_path / "out")
    stream = jobs.watch(spark, f"{folder}/*", fields(spark, SCHEMA), 1)
    jobs.run_once(jobs.running_totals(stream, jobs.KEYS, {"n": F.col("n")}, root, compact=3))
    rows, last = jobs._history(spark, root)
    assert last == 5
    read = {r[0].rsplit("/", 2)[1] for r in rows.select(F.input_file_name()).collect()}
    assert read == {"upto-5", "batch=6"}
    got = {r.month: r.n for r in jobs.latest(spark, root, jobs.KEYS).collect()}
    assert got == {"2020-01": 1111111} | {f"2021-0{i + 1}": i for i in range(7)}


def test_late_rows_are_listed_and_state_is_bounded(spark, folder, tmp_path):
    """A row is late by the files before its own, so every cut agrees; only open periods are kept."""
    steps = [
        [(at(1), "a", 1.0), (at(1, 5), "a", 3.0), (at(3), "a", 9.0), (at(1), "b", 4.0)],
        [(at(5), "a", 1.0), (at(2, 23), "a", 5.0)],  # the first day is closed by now, the second isn't
        [(at(1, 6), "a", 50.0), (None, "a", 7.0), (at(5, 2), "a", 2.0), (at(4), "b", None), (at(4), "b", 8.0)],
        [(at(i), s, 1.0) for i in range(6, 26) for s in "ab"],
        [(at(25, 1), "a", 3.0), (at(5, 3), "b", 3.0)],
    ]
    for i, rows in enumerate(steps):
        drop(spark, folder, f"s{i}", rows, EVENTS)
    for n in CUTS:
        root = str(tmp_path / f"out{n}")
        jobs.run_once(jobs.period_metric(spark, f"{folder}/*", fields(spark, EVENTS), "ts", "series", "value", "1 day", "24 hours", root, n))
        rows = jobs.closed_periods(spark, root).collect()
        got = {(r.series, r.start.day): (r.n, r["mean"]) for r in rows}
        assert len(rows) == len(got)
        first = {("a", 1): (2, 2.0), ("b", 1): (1, 4.0), ("a", 2): (1, 5.0), ("a", 3): (1, 9.0), ("a", 5): (2, 1.5), ("b", 4): (2, 8.0)}
        assert got == first | {(s, i): (1, 1.0) for i in range(6, 24) for s in "ab"}
        late = sorted((r.ts.day, r.series, r.value, r.mark.day) for r in jobs.late_rows(spark, root).collect())
        assert late == [(1, "a", 50.0, 4), (5, "b", 3.0, 24)]
        still = jobs.state(spark, root).where("start IS NOT NULL").collect()
        assert sorted((r.series, r.start.day, r.n) for r in still) == [("a", 24, 1), ("a", 25, 2), ("b", 24, 1), ("b", 25, 1)]


def test_first_arrival(spark, folder, tmp_path):
    drop(spark, folder, "one", [(at(2), "a", float(i)) for i in range(200)] + [(at(1), "b", 1.0)], EVENTS)
    drop(spark, folder, "two", [(at(1), "a", 5.0), (at(2), "c", 1.0)], EVENTS)
    drop(spark, folder, "three", [(at(20), "b", 5.0), (at(20), "a", 1.0)], EVENTS)
    for n, stream in every_cut(spark, folder, EVENTS):
        root = str(tmp_path / f"out{n}")
        jobs.run_once(jobs.first_arrival(stream, "ts", ["series"], root))
        got = sorted((r.series, r.ts.day, r.value) for r in jobs.latest(spark, root, ["series"]).collect())
        assert got == [("a", 1, 5.0), ("b", 1, 1.0), ("c", 2, 1.0)]


def smoothed(spark, root):
    rows = jobs.latest(spark, root, ["series", "ts"]).collect()
    return {(r.series, r.ts.day): r.smoothed for r in rows}


def test_smoothing_goes_on_from_its_state(spark, folder, tmp_path):
    root = str(tmp_path / "out")
    steps = [[(at(2), "a", 2.0), (at(1), "a", 4.0), (at(1), "b", 1.0)], [(at(3), "a", 8.0), (None, "a", 1.0), (at(9), "a", None)]]
    for i, rows in enumerate(steps):
        drop(spark, folder, f"s{i}", rows, EVENTS)
        jobs.run_once(jobs.smooth(watch(spark, folder, EVENTS), "series", "ts", "value", root, 0.5))
    assert smoothed(spark, root) == {("a", 1): 4.0, ("a", 2): 3.0, ("a", 3): 5.5, ("b", 1): 1.0}


@pytest.mark.parametrize("seed", [1, 2])
def test_smoothing_takes_any_order_in_any_cut(spark, folder, tmp_path, seed):
    rng = random.Random(seed)
    points = [(at(i), s, float(rng.randrange(100))) for i in range(1, 20) for s in "ab"]
    want = {}
    for s in "ab":
        level = None
        for t, _, x in sorted(p for p in points if p[1] == s):
            level = x if level is None else 0.3 * x + 0.7 * level
            want[s, t.day] = level
    rng.shuffle(points)
    points += [points[0], (points[1][0], points[1][1], points[1][2] - 1)]  # again, and again with a smaller value
    for i in range(5):
        drop(spark, folder, f"s{i}", points[i::5], EVENTS)
    for n, stream in every_cut(spark, folder, EVENTS):
        root = str(tmp_path / f"out{n}")
        jobs.run_once(jobs.smooth(stream, "series", "ts", "value", root, 0.3))
        got = smoothed(spark, root)
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
