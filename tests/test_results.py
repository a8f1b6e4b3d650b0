from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from tidemark.functions import periods
from tidemark.operators import results as r
from tidemark.operators import series
from tidemark.sources import results as src
from tidemark.sources import stages

SCHEMA = "dataset string, model string, month string, ratio double"


def frame(spark, points, model="m"):
    return spark.createDataFrame([("d", model, month, x) for month, x in points], SCHEMA)


@pytest.mark.parametrize("months,want", [
    (["2021-02", "2021-03", "2021-04"], [1.0, 2.0, 3.0]),
    (["2021-03", "2021-04", "2021-05"], [1.0, 9.0, 3.0]),
    (["2021-01", "2021-02", "2021-03"], [1.0, 9.0, 3.0]),
    (["2021-02", "2021-04", "2021-05"], [1.0, 9.0, 3.0]),
])
def test_repair(spark, months, want):
    rows = series.repair_month(frame(spark, zip(months, [1.0, 9.0, 3.0]))).orderBy("month").collect()
    assert [x.repaired for x in rows] == want


def test_smoothing(spark):
    xs = [4.0, 2.0, 8.0, 1.0]
    months = ["2020-01", "2020-02", "2020-04", "2020-05"]
    rows = series.exponential_smoothing(frame(spark, zip(months, xs)).orderBy(F.rand()), 0.5).orderBy("month").collect()
    assert [x.smoothed for x in rows] == [4.0, 3.0, 5.5, 3.25]
    single = series.exponential_smoothing(frame(spark, [("2020-01", 7.0)])).collect()
    assert [x.smoothed for x in single] == [7.0]


def test_drift_and_elapsed(spark):
    df = frame(spark, [("2020-02", 3.0), ("2020-01", 2.0), ("2020-03", 1.0)])
    assert [x.drift for x in series.drift_vs_first(df).orderBy("month").collect()] == [0.0, 0.5, -0.5]
    assert [x.elapsed for x in series.cumulative_time(df, "ratio").orderBy("month").collect()] == [2.0, 5.0, 6.0]


def test_spine(spark):
    bounds = spark.createDataFrame([("2019-11", "2020-02")], "start string, end string")
    assert [x.month for x in periods.spine(bounds).collect()] == ["2019-11", "2019-12", "2020-01", "2020-02"]
    n = spark.range(1).select(periods.month_number(F.lit("2020-01")) - periods.month_number(F.lit("2019-12"))).first()[0]
    assert n == 1


def test_complete_models(spark):
    df = frame(spark, [("2020-01", 1.0), ("2020-02", 1.0)], "full").unionByName(
        frame(spark, [("2020-01", 1.0)], "gap")).unionByName(frame(spark, [("2020-01", 1.0), ("2020-02", None)], "null"))
    assert {x.model for x in r.complete_models(df).collect()} == {"full"}


def test_union_first_wins(spark):
    a, b = frame(spark, [("2020-01", 1.0)]), frame(spark, [("2020-01", 2.0), ("2020-02", 3.0)])
    rows = r.dedupe_first(r.union_roots([a, b])).orderBy("month").collect()
    assert [(x.month, x.ratio, x.priority) for x in rows] == [("2020-01", 1.0, 0), ("2020-02", 3.0, 1)]


def test_names(spark):
    df = spark.createDataFrame([("a/b/Qwen1.5-7B", 2048), ("gemma-7b", 8192)], "m string, c int")
    assert [x[0] for x in df.select(r.model_key(F.col("m"), F.col("c"))).collect()] == ["Qwen1.5-7B", "gemma-7b-8192"]
    names = spark.createDataFrame([("Qwen-7B-12k",), ("Qwen-7B",)], "m string")
    got = [tuple(x) for x in names.select(*r.context_key(F.col("m"))).collect()]
    assert got == [("Qwen-7B", 12), ("Qwen-7B", None)]


def test_gap_and_ranges(spark):
    rows = [("d", m, month, x) for m, xs in {"a": (1.0, 2.0), "b": (2.0, 1.0)}.items()
            for month, x in zip(["2022-12", "2023-01"], xs)]
    averages = r.period_averages(spark.createDataFrame([*rows, ("d", "a", "2030-01", 99.0)], SCHEMA))
    gaps = {x.model: x for x in r.robustness_gap(averages).collect()}
    assert (gaps["a"].gap, gaps["b"].gap, gaps["a"].performance) == (1.0, -1.0, 200.0)
    stats = r.range_stats(r.robustness_gap(averages)).first()
    assert (stats.min_robustness, stats.max_robustness, stats.mid_performance) == (0.0, 100.0, 150.0)
    assert {x.model: x.quadrant for x in r.quadrants(r.robustness_gap(averages)).collect()} == {
        "a": "high/high", "b": "low/low"}
    assert {x.n_months for x in averages.collect()} == {2}
    assert r.coverage(averages).count() == 2


def test_reads_indented_files_keyed_by_path(spark, tmp_path):
    for model, size in [("Qwen1.5-7B", 2048), ("zlib", "None")]:
        folder = tmp_path / "wikitext" / "2020-01"
        folder.mkdir(parents=True, exist_ok=True)
        record = {"bpb": 0.8, "original_size": 100, "ratio": 0.1, "compressed_size": 10.0, "context_size": size,
                  "stride": "None", "batches": 3, "time_used": 1.5, "bpt": 3.0, "bpc": 0.9}
        (folder / f"{model}.json").write_text(json.dumps(record, indent=2))
    got = {x.model: x for x in src.scan_results(spark, str(tmp_path), pretty=True).collect()}
    assert set(got) == {"Qwen1.5-7B", "zlib"}
    row = got["Qwen1.5-7B"]
    assert (row.dataset, row.month, row.context_size, row.stride, row.ratio) == ("wikitext", "2020-01", 2048, None, 0.1)
    assert got["zlib"].context_size is None


def test_nested_document(spark):
    text = json.dumps({"m": {"2020-01": 0.5, "2020-02": 0.25}, "n": {"2020-01": 1.0}})
    rows = src.nested_document(spark.createDataFrame([(text,)], "value string")).collect()
    assert {(x.model, x.month): x.ratio for x in rows} == {
        ("m", "2020-01"): 0.5, ("m", "2020-02"): 0.25, ("n", "2020-01"): 1.0}


def test_nested_documents_are_sorted_and_read_back(spark):
    df = frame(spark, [("2020-02", 0.25), ("2020-01", 0.5)], "n").unionByName(frame(spark, [("2020-01", 1.0)], "m"))
    out = src.nested_documents(df)
    assert out.first().value == '{"m":{"2020-01":1.0},"n":{"2020-01":0.5,"2020-02":0.25}}'
    assert src.nested_document(out).count() == 3


def test_stage_rewrite_leaves_other_months(spark, tmp_path):
    root = str(tmp_path)
    stages.write_stage(frame(spark, [("2020-01", 1.0), ("2020-02", 2.0)]), root, "answers")
    stages.write_stage(frame(spark, [("2020-02", 9.0)]), root, "answers")
    got = {x.month: x.ratio for x in stages.read_stage(spark, root, "answers").collect()}
    assert got == {"2020-01": 1.0, "2020-02": 9.0}
    with pytest.raises(ValueError):
        stages.write_stage(frame(spark, [("2020-02", 9.0)]), root, "other")


def test_materialise_uses_the_shared_folder(spark, shared):
    df = stages.materialise(spark.range(5), "numbers")
    assert sorted(x.id for x in df.collect()) == [0, 1, 2, 3, 4]
    assert [p for p in shared.iterdir() if p.name.startswith("tidemark-numbers-")]


def test_first_path_wins_inside_a_root(spark):
    rows = [("d", "m", "2020-01", 0, "b/x", 1.0), ("d", "m", "2020-01", 0, "a/x", 2.0), ("d", "m", "2020-01", 1, "0", 3.0)]
    df = spark.createDataFrame(rows, "dataset string, model string, month string, priority int, path string, ratio double")
    assert r.dedupe_first(df.repartition(3)).first().ratio == 2.0


def test_smoothing_of_a_long_series(spark):
    """A million points of one series in small buckets, beside short ones, equal the plain fold."""
    n = 1_000_000
    value = F.pmod(F.hash("at"), F.lit(1_000)).cast("double")
    long = spark.range(n).select(F.lit("d").alias("dataset"), F.lit("m").alias("model"), F.col("id").alias("at")).withColumn("x", value)
    few = spark.createDataFrame([("d", "k", 5, 4.0), ("d", "k", 9_000, None), ("d", "k", 90_000, 8.0), ("e", "m", 3, 1.0)], long.schema)
    got = series.exponential_smoothing(
        long.unionByName(few).repartition(6), 0.25, "x", order="at", bucket=F.floor(F.col("at") / 4_096)
    ).toPandas().sort_values(["dataset", "model", "at"])
    xs = long.orderBy("at").toPandas().x.to_numpy()
    level, want = xs[0], [xs[0]]
    for x in xs[1:]:
        level = 0.25 * x + 0.75 * level
        want.append(level)
    one = got[(got.dataset == "d") & (got.model == "m")]
    assert (one["at"].to_numpy() == range(n)).all() and abs(one.smoothed.to_numpy() - want).max() < 1e-9
    rest = got[got.model + got.dataset != "md"]
    assert list(zip(rest.dataset, rest.model, rest["at"], rest.smoothed)) == [("d", "k", 5, 4.0), ("d", "k", 90_000, 5.0), ("e", "m", 3, 1.0)]


def test_broken_files_are_listed(spark, tmp_path):
    """Files '<dataset>/<month>/<model>.json': one cut off, one empty object, one of wrong types, one that is fine."""
    bodies = {"good": {"ratio": 0.5, "batches": 3}, "bare": {}}
    for name, text in {**{k: json.dumps(v, indent=2) for k, v in bodies.items()}, "cut": '{"ratio": 0.', "typed": '{"ratio": "x"}'}.items():
        folder = tmp_path / "wikitext" / "2020-01"
        folder.mkdir(parents=True, exist_ok=True)
        (folder / f"{name}.json").write_text(text)
    good = {x.model: x.ratio for x in src.scan_results(spark, str(tmp_path), pretty=True).collect()}
    assert good == {"good": 0.5, "bare": None}
    bad = {(x.dataset, x.month, x.model): x.record for x in src.malformed_results(spark, str(tmp_path), pretty=True).collect()}
    assert bad == {("wikitext", "2020-01", "cut"): '{"ratio": 0.', ("wikitext", "2020-01", "typed"): '{"ratio": "x"}'}
