from __future__ import annotations

import contextlib
import io
import math
import re

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tidemark.functions import fixed, formats, prompts, scoring
from tidemark.operators import pmf, predictors
from tidemark.operators.chunks import fixed_chunks
from tidemark.operators.units import tokenize


# --- answers ----------------------------------------------------------------
def test_answer_scores(spark):
    data = [
        ("West Brom", ["from west brom.", "Stoke"], ["Yes", "Not sure"], 0.5, 0.5),
        ("", ["anything", "b"], ["Yes, no"], 1.0, 1.0),
        ("x", ["", "y"], ["maybe", ""], 0.0, None),
        ("x", ["X"], ["I know", "maybe"], 1.0, 0.0),
    ]
    df = spark.createDataFrame([d[:3] for d in data], "ref string, out array<string>, judges array<string>")
    got = df.select(
        scoring.substring_accuracy(F.col("out"), F.col("ref")), scoring.judge_accuracy(F.col("judges"))
    ).collect()
    assert [tuple(r) for r in got] == [d[3:] for d in data]


def test_whole_word_verdict(spark):
    df = spark.createDataFrame([("I know",), ("no.",), ("yes",)], "t string")
    got = [r[0] for r in df.select(scoring.verdict(F.col("t"), whole_words=True)).collect()]
    assert got == [None, False, True]


def test_edit_distance_uses_the_raw_length(spark):
    df = spark.createDataFrame(
        [(" ab ", ["AB", "abcd"]), ("", ["a"]), ("a", ["xyzuv"])], "ref string, out array<string>"
    )
    got = [r[0] for r in df.select(scoring.edit_distance_score(F.col("out"), F.col("ref"))).collect()]
    assert got == [(4 - 1.0) / 4, None, (1 - 5.0) / 1]


def test_metric_registry(spark):
    meta = spark.createDataFrame(
        [(100, 90, 50, 5, 16, None, 2.5), (0, 0, 0, 0, 16, 4, None)],
        "num_bytes bigint, num_chars bigint, num_tokens bigint, num_chunks bigint, context_size int, stride int, time_used double",
    ).withColumn("size", F.lit(25.0))
    extra = {"saved": lambda size: F.col("num_bytes") - size}
    a, b = meta.select(*scoring.metric_columns(F.col("size"), extra=extra)).collect()
    assert (a.bpb, a.ratio, a.bpt, a.saved, a.batches) == (2.0, 0.25, 4.0, 75.0, 5)
    assert (b.bpb, b.ratio, b.bpc) == (None, None, None)


# --- formats and prompts ----------------------------------------------------
@pytest.mark.parametrize(
    "digits,texts",
    [
        (4, {0.05: ".0500", 0.12344: ".1234", 0.99996: "1.0000", 1.0: "1.000", 9.87654: "9.877", 9.99996: "10.00", 12.5: "12.50", 99.9996: "100.0",
             123.44: "123.4", 1234.4: "1234", 0.0: ".0000", 7.1: "7.100"}),
        (3, {0.05: ".050", 0.12344: ".123", 0.99996: "1.000", 1.0: "1.00", 9.87654: "9.88", 9.99996: "10.0", 12.5: "12.5", 99.9996: "100",
             123.44: "123", 0.0: ".000", 7.1: "7.10"}),
    ],
)
def test_digits_of_numbers(spark, digits, texts):
    df = spark.createDataFrame([(x,) for x in texts], "x double")
    assert [r[0] for r in df.select(formats.fixed_digits(F.col("x"), digits)).collect()] == list(texts.values())


def test_prompt_holes_are_filled_once(spark):
    df = spark.createDataFrame([("{ref_answer} {x}", "A")], "q string, r string")
    model = F.lit("gpt-4")
    text = df.select(prompts.judge(model, F.col("q"), F.col("r"), F.lit("o"))).first()[0]
    assert text.startswith("The question is: {ref_answer} {x}. And its reference answer is A. ")
    assert '"question": "Who has Stoke City signed?"' in fixed.NEWS_QUESTION_PROMPT


def test_unknown_model_is_an_error(spark):
    with pytest.raises(PySparkException):
        spark.range(1).select(prompts.answer(F.lit("nobody"), F.lit("q"))).collect()


# --- probabilities ----------------------------------------------------------
def logits_frame(spark, rows, vocab, seed=0, zeros=False):
    rng = np.random.default_rng(seed)
    data = []
    for i in range(rows):
        values = rng.normal(size=vocab) * 4
        if zeros:
            values[: vocab // 2] = -2000.0
        data.append(("d", "m", i // 8, i % 8, [float(v) for v in values], int(rng.integers(vocab))))
    return spark.createDataFrame(
        data, "dataset string, month string, chunk_id bigint, off int, logits array<double>, sym int"
    )


@pytest.mark.parametrize("vocab,zeros", [(1, False), (2, False), (40, False), (40, True)])
def test_integer_cdf_is_strict_and_invertible(spark, vocab, zeros):
    rows = pmf.softmax(logits_frame(spark, 16, vocab, zeros=zeros))
    rows = rows.withColumn("cdf", pmf.quantize_cdf(pmf.pmf_to_cdf(F.col("pmf"))))
    for r in rows.collect():
        assert all(a < b for a, b in zip(r.cdf, r.cdf[1:]))
        assert r.cdf[0] == 0
        assert abs(sum(r.pmf) - 1) < 1e-9
    every = rows.select("chunk_id", "off", "cdf", F.explode(F.sequence(F.lit(0), F.lit(vocab - 1))).alias("s"))
    low, high = pmf.interval(F.col("cdf"), F.col("s"))
    points = every.select("chunk_id", "off", "s", F.explode(F.array(low, high - 1)).alias("point"))
    back = pmf.decode_points(rows.select("chunk_id", "off", "cdf"), points, ["chunk_id", "off"]).collect()
    assert len(back) == 32 * vocab and all(r.s == r.decoded for r in back)


def test_a_large_vocabulary_is_inverted_in_any_number_of_rows(spark, monkeypatch):
    """100,000 points on CDFs of 32,000 symbols, most of them in one context; a CDF goes to few rows."""
    monkeypatch.setattr(pmf, "POINTS", 1 << 14)
    vocab, many = 32_000, 90_000
    rng = np.random.default_rng(5)
    cdfs = [np.concatenate([[0], np.sort(rng.choice(np.arange(1, pmf.SCALE), vocab - 1, replace=False)), [pmf.SCALE]]) for _ in range(3)]
    tables = spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(cdfs)], "ctx int, cdf array<bigint>")
    drawn = [(0, int(x)) for x in rng.integers(0, pmf.SCALE, many)] + [(1 + i % 2, int(x)) for i, x in enumerate(rng.integers(0, pmf.SCALE, 10_000))]
    drawn += [(0, 0), (0, pmf.SCALE - 1), (9, 5)]
    points = spark.createDataFrame([(c, x, i) for i, (c, x) in enumerate(drawn)], "ctx int, point bigint, n long").repartition(4)
    got = pmf.decode_points(tables, points, ["ctx"])
    assert got.columns == ["ctx", "point", "n", "decoded"]
    rows = got.toPandas()
    assert sorted(rows.n) == [i for i, (c, _) in enumerate(drawn) if c != 9]
    for ctx, part in rows.groupby("ctx"):
        low = cdfs[ctx][part.decoded.to_numpy()]
        high = cdfs[ctx][part.decoded.to_numpy() + 1]
        assert (low <= part.point).all() and (part.point < high).all()


def exchanged(df):
    """Columns that the exchanges and windows of a plan take in."""
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain("formatted")
    parts = re.findall(r"\(\d+\) (Exchange|Window|Sort)\b.*?\nInput \[\d+\]: \[(.*?)\]", out.getvalue())
    return out.getvalue(), parts


def test_no_array_is_moved_for_the_next_symbol(spark):
    vocab = 32_000
    flat = spark.range(24).selectExpr(
        "'d' AS dataset", "'m' AS month", "id DIV 8 AS chunk_id", "int(id % 8) AS off",
        f"transform(sequence(1, {vocab}), x -> double(hash(x, id) % 7)) AS logits", f"int(pmod(hash(id), {vocab})) AS sym",
    )
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        stored = pmf.store_by_chunk(flat, 3)
        rows = pmf.softmax(pmf.predicted(stored))
        bits = rows.select("chunk_id", "off", pmf.self_information(rows).alias("bits"))
        plan, parts = exchanged(bits)
        assert "ShuffledHashJoin" in plan and all("logits" not in columns and "pmf" not in columns for _, columns in parts)
        got = {(r.chunk_id, r.off): r.bits for r in bits.collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    data = {(r.chunk_id, r.off): r for r in flat.collect()}
    assert got.keys() == {k for k in data if k[1] > 0}
    for (chunk, off), bit in got.items():
        x = np.array(data[chunk, off - 1].logits)
        want = np.log2(np.exp(x - x.max()).sum()) - (x[data[chunk, off].sym] - x.max()) / np.log(2)
        assert abs(bit - want) < 1e-9


def test_quantized_length_is_close_to_self_information(spark):
    rows = pmf.softmax(logits_frame(spark, 64, 30))
    rows = rows.withColumn("cdf", pmf.quantize_cdf(pmf.pmf_to_cdf(F.col("pmf"))))
    both = rows.select(
        F.sum(pmf.self_information(rows)).alias("exact"), F.sum(pmf.quantized_bits(F.col("cdf"), F.col("sym"))).alias("coded")
    ).first()
    assert abs(both.exact - both.coded) < 1e-3 * both.exact


def test_self_information_shifts_by_one_and_clamps(spark):
    df = spark.createDataFrame(
        [("d", "m", 0, 0, [0.5, 0.5], 1), ("d", "m", 0, 1, [0.25, 0.75], 0), ("d", "m", 0, 2, [1.0, 0.0], 1),
         ("d", "m", 1, 0, [1.0, 0.0], 1), ("d", "m", 1, 1, [1.0, 0.0], 1)],
        "dataset string, month string, chunk_id bigint, off int, pmf array<double>, sym int",
    )
    rows = pmf.predicted(df)
    got = {(r.chunk_id, r.off): r.bits for r in rows.withColumn("bits", pmf.self_information(rows)).collect()}
    assert got[(0, 1)] == 1.0
    assert abs(got[(0, 2)] - -math.log2(0.75)) < 1e-12
    assert abs(got[(1, 1)] - 32 * math.log2(10)) < 1e-6
    assert len(got) == 3


def test_inverse_map_must_be_unique():
    with pytest.raises(ValueError):
        pmf.symbol_index(None, [1, 1])


# --- models -----------------------------------------------------------------
def small_corpus(spark):
    texts = [("2022-01", "a b a c. " * 9), ("2022-02", "b b a"), ("2023-01", "a z z b. " * 7), ("2023-02", "")]
    df = spark.createDataFrame(
        [("d", m, i, t) for i, (m, t) in enumerate(texts)], "dataset string, month string, doc_ord bigint, text string"
    )
    return tokenize(df)


def test_unigram_by_hand(spark):
    docs = small_corpus(spark)
    got = {r.month: r for r in predictors.unigram_bits(docs, "2023-01").collect()}
    train = "a b a c .".split() * 9 + "b b a".split()
    size = len(train) + len(set(train)) + 1
    for month, toks in {"2022-02": "b b a".split(), "2023-01": "a z z b .".split() * 7}.items():
        bits = sum(-math.log2((train.count(t) + 1) / size) for t in toks)
        assert abs(got[month].bits - bits) < 1e-9
    assert (got["2023-02"].n_tokens, got["2023-02"].n_bytes) == (0, 0)
    assert got["2023-01"].n_bytes == 63


def test_unigram_bits_are_at_least_the_entropy(spark):
    docs = small_corpus(spark).where("month = '2022-01'")
    bits = predictors.unigram_bits(docs, "2023-01").first().bits
    toks = "a b a c .".split() * 9
    entropy = -sum(math.log2(toks.count(t) / len(toks)) for t in toks)
    assert bits >= entropy


def test_cache_model_by_hand(spark):
    docs = small_corpus(spark)
    vocab = predictors.vocabulary(docs, "2023-01")
    got = {r.month: r.bits for r in predictors.cache_bits(fixed_chunks(docs, 8), vocab, 8).collect()}
    train = "a b a c .".split() * 9 + "b b a".split()
    size = len(train) + len(set(train)) + 1
    toks, want = "a z z b .".split() * 7, 0.0
    for k in range((len(toks) + 7) // 8 - 1):
        window = toks[k * 8:k * 8 + 8]
        for off in range(1, 8):
            p = 0.5 * (train.count(window[off]) + 1) / size + 0.5 * window[:off].count(window[off]) / off
            want -= math.log2(p)
    assert abs(got["2023-01"] - want) < 1e-9


def test_external_scores_and_batch_function(spark):
    chunks = fixed_chunks(small_corpus(spark), 8)
    scores = spark.createDataFrame(
        [("d", "2022-01", 0, off, -2.0) for off in range(8)] + [("d", "2022-01", 1, 1, -1e9)],
        "dataset string, month string, chunk_id bigint, off int, log2_p double",
    )
    r = {x.month: x for x in predictors.external_bits(chunks, scores).collect()}["2022-01"]
    windows = (45 + 7) // 8 - 1
    assert (r.n_scored, r.n_missing) == (windows * 7, windows * 7 - 8)
    assert abs(r.bits - (14 + 32 * math.log2(10))) < 1e-6
    bits = predictors.batch_predictor_bits(chunks, lambda ws: np.array([len(w) for w in ws], dtype=float))
    assert {x.bits for x in bits.collect()} == {8.0}


def test_byte_entropy(spark):
    df = spark.createDataFrame([("d", "m", "abab"), ("d", "m", "éé"), ("d", "m", None), ("d", "n", "aaaa")],
                               "dataset string, month string, text string")
    got = {r.month: r for r in predictors.byte_entropy(predictors.byte_pair_counts(df)).collect()}
    assert (got["m"].n_bytes, got["m"].order0_bpb, got["n"].order0_bpb) == (8, 2.0, 0.0)
    assert got["n"].order1_bpb == 0.0


def test_byte_code_length(spark):
    df = spark.createDataFrame([("d", "m", "abab"), ("d", "m", "ac"), ("d", "n", "aaaa"), ("d", "n", None)], "dataset string, month string, text string")
    got = {r.month: r.compressed_size for r in predictors.byte_code_length(predictors.byte_pair_counts(df)).collect()}
    # After the start 'a' twice, after 'a' 'b' twice and 'c' once, after 'b' 'a' once.
    assert abs(got["m"] - (2 * np.log2(3 / 2) + np.log2(3)) / 8) < 1e-12 and got["n"] == 0.0


def test_cdf_of_a_large_vocabulary(spark):
    n = 32_000
    df = spark.range(8).select(F.expr(f"transform(sequence(1, {n}), x -> 1.0D / {n})").alias("pmf"))
    row = df.select(pmf.quantize_cdf(pmf.pmf_to_cdf(F.col("pmf"))).alias("cdf")).first()
    assert len(row.cdf) == n + 1 and row.cdf[0] == 0 and all(a < b for a, b in zip(row.cdf, row.cdf[1:]))
    uneven = spark.createDataFrame([(None,), ([0.5, 0.5],), ([],), ([0.25, 0.5, 0.5],), (None,), ([1.0],)], "pmf array<double>").coalesce(1)
    got = [r.cdf for r in uneven.select(pmf.pmf_to_cdf("pmf").alias("cdf")).collect()]
    assert got == [None, [0.0, 0.5, 1.0], [0.0], [0.0, 0.25, 0.75, 1.0], None, [0.0, 1.0]]


def test_byte_pairs_in_bounded_memory(spark):
    """A text is counted in slices, so what a task holds doesn't grow with texts and batches."""
    import tracemalloc
    from collections import Counter

    import pyarrow as pa

    class Tasks:
        """Takes the place of a DataFrame and keeps the function that tasks run."""

        def mapInArrow(self, function, schema):
            self.function = function
            return self

        def __getattr__(self, name):
            return lambda *columns: self

    tasks = Tasks()
    predictors.byte_pair_counts(tasks)
    rng = np.random.default_rng(4)
    texts = [b"", b"a", None, bytes(rng.integers(0, 200, 24 << 20, np.uint8)), b"ab" * 5]
    batch = pa.record_batch([pa.array(["d"] * 5), pa.array(["m"] * 5), pa.array(texts, pa.binary())], names=["dataset", "month", "raw"])
    tracemalloc.start()
    found = list(tasks.function(iter([batch, batch])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 64 << 20
    got = Counter()
    for rows in found:
        for _, _, prev, byte, k in zip(*(c.to_pylist() for c in rows.columns)):
            got[prev, byte] += k
    want = Counter({(-1, 97): 4, (97, 98): 10, (98, 97): 8})
    data = np.frombuffer(texts[3], np.uint8).astype(np.int32)
    codes, counts = np.unique(data[:-1] * 256 + data[1:], return_counts=True)
    want.update({(int(c) // 256, int(c) % 256): 2 * int(k) for c, k in zip(codes, counts)})
    want[-1, int(data[0])] += 2
    assert got == want


def test_pairs_are_moved_once(spark, monkeypatch):
    """Pairs are counted inside the tasks and moved once, whatever their tokens hold."""
    from collections import Counter

    plans = []

    def written(df, purpose):
        with contextlib.redirect_stdout(io.StringIO()) as plan:
            df.explain()
        plans.append((purpose, plan.getvalue().count("Exchange ")))
        return df

    monkeypatch.setattr(predictors, "materialise", written)
    monkeypatch.setattr(predictors, "SLICE_TOKENS", 40)
    rows = [("d", f"m{i % 3}", i, [["f", "a", "b\nc", "", "e"][i * j % 5] for j in range(1 + i % 9)]) for i in range(60)]
    windows = spark.createDataFrame(rows, "dataset string, month string, chunk_id long, toks array<string>")
    got = {r.month: (r.n_scored, round(r.bits, 6)) for r in predictors.bigram_bits(windows, "m2").collect()}
    assert plans[0] == ("pairs", 1)
    seen = Counter((m, pair) for _, m, _, t in rows for pair in zip(t, t[1:]))
    train, prev, tok = Counter(), Counter(), Counter()
    for (m, (a, b)), k in seen.items():
        if m < "m2":
            train[a, b] += k
            prev[a] += k
            tok[b] += k
    size, want = sum(tok.values()) + len(tok) + 1, {}
    for (m, (a, b)), k in seen.items():
        p = 0.5 * (train[a, b] / prev[a] if prev[a] else 0) + 0.5 * (tok[b] + 1) / size
        n, bits = want.get(m, (0, 0.0))
        want[m] = n + k, bits - k * math.log2(max(p, fixed.PROBABILITY_FLOOR))
    assert got == {m: (n, round(bits, 6)) for m, (n, bits) in want.items()}
