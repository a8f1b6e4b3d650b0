from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import records

META = (
    "dataset string, month string, context_size int, stride int, num_chunks bigint, num_tokens bigint, "
    "num_chars bigint, num_bytes bigint"
)


def metadata(spark, context=2048):
    return spark.createDataFrame(
        [("d", "2020-01", context, None, 2, 100, 50, 80), ("d", "2020-02", context, None, 0, 0, 0, 0)], META
    )


def test_model_records(spark):
    bits = spark.createDataFrame([("d", "2020-01", 160.0)], "dataset string, month string, bits double")
    rows = {r.month: r for r in records.model_records(bits, metadata(spark), "owner/m").collect()}
    a, b = rows["2020-01"], rows["2020-02"]
    assert (a.model, a.compressed_size, a.ratio, a.bpb, a.bpt, a.bpc, a.batches) == ("m", 20.0, 0.25, 2.0, 1.6, 3.2, 2)
    assert (b.compressed_size, b.ratio, b.bpt, b.batches) == (None, None, None, 0)
    other = records.model_records(bits, metadata(spark, 512), "m").first()
    assert other.model == "m-512"


def test_baseline_and_coder_records(spark):
    sizes = spark.createDataFrame(
        [("d", "2020-01", "zlib", 100, 40)],
        "dataset string, month string, model string, stream_bytes bigint, compressed_size bigint",
    )
    row = records.baseline_records(sizes, metadata(spark)).first()
    assert (row.model, row.compressed_size, row.ratio, row.context_size, row.time_used) == ("zlib", 40.0, 0.5, None, None)
    bits = spark.createDataFrame([("d", "2020-01", 160.0)], "dataset string, month string, bits double")
    coder = spark.createDataFrame([("d", "2020-01", 21)], "dataset string, month string, n_bytes bigint")
    both = records.with_coder(records.model_records(bits, metadata(spark), "m"), coder, metadata(spark))
    row = both.where(F.col("month") == "2020-01").first()
    assert (row.compressed_size, row.ac_compressed_size, row.ac_bpb) == (20.0, 21.0, 2.1)


def test_unscored_months(spark):
    docs = spark.createDataFrame([("d", "2020-01", 1), ("d", "2020-02", 2)], "dataset string, month string, doc_ord bigint")
    done = spark.createDataFrame([("d", "2020-01", "m"), ("d", "2020-02", "other")], "dataset string, month string, model string")
    assert [r.month for r in records.unscored(docs, done, "m").collect()] == ["2020-02"]
