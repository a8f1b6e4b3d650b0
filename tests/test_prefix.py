from __future__ import annotations

import random

from pyspark.sql import functions as F

from tidemark.operators.prefix import first_rows, hash_bucket, ordinal_bucket, running_total
from tidemark.operators.skew import lookup_weighted


def rows(n=400, seed=1):
    rng = random.Random(seed)
    keys = ["hot"] * 6 + ["a", "b", "c"]
    ords = rng.sample(range(-2000, 2000), n)
    return [(rng.choice(keys), o, rng.randint(0, 9)) for o in ords]


def expected(data):
    out, sums = {}, {}
    for key, o, v in sorted(data, key=lambda r: (r[0], r[1])):
        out[(key, o)] = sums.get(key, 0)
        sums[key] = sums.get(key, 0) + v
    return out, sums


def test_running_total_over_many_buckets(spark):
    data = rows()
    df = spark.createDataFrame(data, "k string, o bigint, v int")
    got = running_total(df, ["k"], ["o"], "v", ordinal_bucket("o", 6), out="before", total="total").collect()
    want, sums = expected(data)
    assert {(r.k, r.o): r.before for r in got} == want
    assert all(r.total == sums[r.k] for r in got)


def test_limit_keeps_every_row_at_or_below_it(spark):
    data = rows()
    df = spark.createDataFrame(data, "k string, o bigint, v int")
    got = running_total(df, ["k"], ["o"], "v", ordinal_bucket("o", 4), limit=50).where("before <= 50").collect()
    want, _ = expected(data)
    assert {(r.k, r.o) for r in got} == {key for key, before in want.items() if before <= 50}


def test_first_rows_by_hash_bucket(spark):
    df = spark.range(300).select((F.col("id") % 3).alias("k"), F.md5(F.col("id").cast("string")).alias("h"))
    got = {(r.k, r.h): r["rank"] for r in first_rows(df, ["k"], ["h"], 20, hash_bucket("h", 1)).collect()}
    want = {}
    for k in range(3):
        hs = sorted(r.h for r in df.where(F.col("k") == k).collect())[:20]
        want.update({(k, h): i for i, h in enumerate(hs)})
    assert got == want


def test_weighted_lookup_with_hot_and_unknown_keys(spark):
    toks = ["the"] * 3000 + [f"w{i}" for i in range(1500)] + ["unknown", "s12", "kthe"]
    big = spark.createDataFrame([(i, t) for i, t in enumerate(toks)], "id bigint, tok string")
    stats = big.where("tok != 'unknown'").groupBy("tok").agg(F.count("*").alias("n"))
    stats = stats.select(F.col("tok").alias("t"), "n", (F.col("n") * 10).alias("c"))
    joined = lookup_weighted(big, stats, "tok", "t", "n", ["c"], ["id"])
    got = {r.id: r.c for r in joined.collect()}
    counts = {t: toks.count(t) for t in set(toks)}
    assert got == {i: None if t == "unknown" else counts[t] * 10 for i, t in enumerate(toks)}


def test_hot_rows_are_spread_over_the_shuffle(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        big = spark.range(20000).select("id", F.when(F.col("id") % 10 < 9, "the").otherwise(
            F.concat(F.lit("w"), F.col("id").cast("string"))).alias("tok"))
        stats = big.groupBy(F.col("tok").alias("t")).agg(F.count("*").alias("n")).withColumn("c", F.col("n"))
        joined = lookup_weighted(big, stats, "tok", "t", "n", ["c"], ["id"])
        sizes = [r["count"] for r in joined.groupBy(F.spark_partition_id().alias("p")).count().collect()]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert sum(sizes) == 20000
    assert max(sizes) < 0.4 * 20000
