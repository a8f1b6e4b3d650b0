from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tidemark.functions import text
from tidemark.operators import chunks as c
from tidemark.operators import units
from tidemark.sources import stages

CTX = 8
LENGTHS = [1, CTX - 1, CTX, CTX + 1, 3 * CTX, 3 * CTX + 5, 100]


def corpus(spark, lengths=LENGTHS, step=70000):
    """One month per stream length, cut into documents of uneven size in far-apart buckets."""
    data = []
    for n in lengths:
        toks, doc = [f"t{i}" for i in range(n)], 0
        while toks:
            size = 1 + (doc * 5) % 11
            data.append(("d", f"m{n}", doc * step, toks[:size]))
            toks, doc = toks[size:], doc + 1
        data.append(("d", f"m{n}", doc * step, []))
    df = spark.createDataFrame(data, "dataset string, month string, doc_ord bigint, toks array<string>")
    text = F.array_join("toks", " ")
    return df.withColumns({"n_toks": F.size("toks"), "n_chars": F.length(text), "n_bytes": F.octet_length(text)})


def collected(df):
    out = {}
    for r in df.collect():
        out.setdefault(int(r.month[1:]), {})[r.chunk_id] = list(r.toks)
    return out


def named(first, size=CTX):
    return [f"t{i}" for i in range(first, first + size)]


#: First tokens of the windows of each stream length.
FIXED = {1: [], 7: [], 8: [], 9: [0], 24: [0, 8], 29: [0, 8, 16], 100: [0, 8, 16, 24, 32, 40, 48, 56, 64, 72, 80, 88]}
FULL_TAIL = FIXED | {8: [0], 24: [0, 8, 16]}


def test_fixed_drops_the_last_window_even_when_full(spark):
    got = collected(c.fixed_chunks(corpus(spark), CTX))
    assert {n: [w for _, w in sorted(got.get(n, {}).items())] for n in LENGTHS} == {n: [named(i) for i in FIXED[n]] for n in LENGTHS}


def test_fixed_can_keep_a_full_tail(spark):
    got = collected(c.fixed_chunks(corpus(spark), CTX, keep_full_tail=True))
    assert {n: [w for _, w in sorted(got.get(n, {}).items())] for n in LENGTHS} == {n: [named(i) for i in FULL_TAIL[n]] for n in LENGTHS}


def test_bos_takes_the_place_of_one_token(spark):
    got = collected(c.fixed_chunks(corpus(spark), CTX, bos="<s>"))
    assert {n: [w for _, w in sorted(got.get(n, {}).items())] for n in LENGTHS} == {n: [["<s>", *named(i, CTX - 1)] for i in FIXED[n]] for n in LENGTHS}


def test_exact_bos_loses_no_token(spark):
    got = collected(c.fixed_chunks(corpus(spark, [30]), CTX, bos="<s>", bos_exact=True))[30]
    flat = [t for k in sorted(got) for t in got[k][1:]]
    assert flat == named(0, len(flat))
    assert all(len(v) == CTX for v in got.values())


@pytest.mark.parametrize(
    "stride,firsts",
    [(1, {8: 1, 9: 2, 24: 17, 29: 22, 100: 93}), (2, {8: 1, 9: 1, 24: 9, 29: 11, 100: 47}), (7, {8: 1, 9: 1, 24: 3, 29: 4, 100: 14})],
)
def test_sliding(spark, stride, firsts):
    """Windows of each stream length: so many, each `stride` after the one before."""
    got = collected(c.sliding_chunks(corpus(spark), CTX, stride))
    assert got == {n: {k: named(k * stride) for k in range(count)} for n, count in firsts.items()}


def test_sliding_needs_a_stride_below_the_context(spark):
    with pytest.raises(ValueError):
        c.sliding_chunks(corpus(spark, [9]), CTX, CTX)


@pytest.mark.parametrize(
    "stride,counts,cuts",
    [
        (None, [0, 0, 0, 1, 2, 3, 12], [0, 0, 0, 8, 16, 24, 96]), (1, [0, 0, 1, 2, 17, 22, 93], [0, 0, 8, 9, 24, 29, 100]),
        (2, [0, 0, 1, 1, 9, 11, 47], [0, 0, 8, 8, 24, 28, 100]), (7, [0, 0, 1, 1, 3, 4, 14], [0, 0, 8, 8, 22, 29, 99]),
    ],
)
def test_metadata_and_dropped_tail(spark, stride, counts, cuts):
    docs = corpus(spark)
    texts = docs.withColumn("text", F.array_join("toks", " "))
    rows = {int(r.month[1:]): r for r in c.text_metadata(docs, texts, CTX, stride, end_of=words_between_spaces).collect()}
    whole = {n: " ".join(" ".join(r.toks) for r in texts.where(F.col("month") == f"m{n}").orderBy("doc_ord").collect()) for n in LENGTHS}
    for n, count, cut in zip(LENGTHS, counts, cuts):
        at = whole[n].index(f"t{cut - 1}") + len(f"t{cut - 1}") if cut else 0
        lost = len(whole[n]) - at
        assert (rows[n].n_stream, rows[n].num_chunks, rows[n].num_tokens) == (n, count, count * CTX)
        assert (rows[n].dropped_chars, rows[n].dropped_bytes, rows[n].num_chars) == (lost, lost, at)


def words_between_spaces(text, k):
    return F.length(F.array_join(F.slice(F.split(text, " "), F.lit(1), k), " "))


TEXTS = ["  Éa b,\t", None, "", "İstanbul Kelvin 漢字 99x", " \n ", "end. Ünd so ", "z"]


@pytest.mark.parametrize("context", [2, 3, 4, 5, 7, 30])
def test_tail_is_source_text(spark, context):
    """Against a walk over the joined text, token by token."""
    import re

    rows = [("d", "2020-01", i, t) for i, t in enumerate(TEXTS)] + [("d", "2020-02", 9, " ."), ("e", "2020-01", 1, "")]
    df = spark.createDataFrame(rows, "dataset string, month string, doc_ord bigint, text string").repartition(3)
    got = {(r.dataset, r.month): r for r in c.text_metadata(units.tokenize(df.fillna("")), df.fillna(""), context).collect()}
    for key, texts in {("d", "2020-01"): [t or "" for t in TEXTS], ("d", "2020-02"): [" ."], ("e", "2020-01"): [""]}.items():
        stream = " ".join(texts)
        ends = [m.end() for m in re.finditer(r"[a-zA-ZİK]+|[0-9]+|[^a-zA-ZİK0-9 \n\t]", stream)]
        cut = max(-(-len(ends) // context) - 1, 0) * context
        lost = stream[ends[cut - 1]:] if cut else stream
        row = got[key]
        assert (row.n_stream, row.dropped_chars, row.dropped_bytes) == (len(ends), len(lost), len(lost.encode()))
        assert (row.num_chars, row.num_bytes) == (len(stream) - len(lost), len(stream.encode()) - len(lost.encode()))


def test_no_stream_at_all(spark):
    empty = corpus(spark, [0])
    assert c.fixed_chunks(empty, CTX).count() == 0
    assert c.sliding_chunks(empty, CTX, 2).count() == 0
    meta = c.text_metadata(empty, empty.withColumn("text", F.lit("")), CTX).first()
    assert (meta.num_chunks, meta.num_tokens, meta.dropped_bytes) == (0, 0, 0)


@pytest.mark.parametrize("batch", [1, 2])
def test_stride_scoring_counts(spark, batch):
    stride = 3
    rows = c.explode_chunks(c.sliding_chunks(corpus(spark, [40]), CTX, stride))
    got = rows.where(c.scored(F.col("off"), F.col("chunk_id"), CTX, stride, batch)).count()
    windows = (40 - CTX) // stride + 1
    assert got == batch * (CTX - 1) + (windows - batch) * (stride - 1)


def test_byte_metadata(spark):
    sizes = spark.createDataFrame(
        [("d", "a", 5000), ("d", "a", 5000), ("d", "b", 10), ("d", "c", 4096)],
        "dataset string, month string, n_bytes bigint",
    )
    fixed = {r.month: r for r in c.byte_metadata(sizes, budget=8192).collect()}
    assert [(fixed[m].n_stream, fixed[m].num_chunks, fixed[m].bytes_dropped) for m in "abc"] == [
        (8192, 3, 2048), (10, 0, 10), (4096, 1, 2048)
    ]
    slid = {r.month: r for r in c.byte_metadata(sizes, stride=512, budget=8192).collect()}
    assert [(slid[m].num_chunks, slid[m].num_bytes, slid[m].bytes_dropped) for m in "abc"] == [
        (13, 13 * 2048, 0), (0, 0, 10), (5, 5 * 2048, 0)
    ]


def test_windows_follow_the_units_of_a_document(spark):
    """One document of many units: windows hold the tokens in unit order."""
    rows = [("d", "2020-01", 0, i, f"a{i}x b{i}y") for i in reversed(range(200))]
    df = spark.createDataFrame(rows, "dataset string, month string, doc_ord long, unit_ord int, unit string").repartition(5)
    toks = units.tokenize(df, "unit", lambda c: F.split(c, " "))
    got = c.fixed_chunks(toks, 4).orderBy("chunk_id").collect()
    assert [r.toks for r in got[:2]] == [["a0x", "b0y", "a1x", "b1y"], ["a2x", "b2y", "a3x", "b3y"]]
    assert len(got) == 99
    sliding = c.sliding_chunks(toks, 4, 2).orderBy("chunk_id").collect()
    assert sliding[1].toks == ["a1x", "b1y", "a2x", "b2y"]


def test_tokens_are_found_again_by_what_they_were_made_from(spark, tmp_path):
    path = str(tmp_path / "tokens")
    one = spark.createDataFrame([("d", "2020-01", 0, "aa bb"), ("d", "2020-01", 1, None)], "dataset string, month string, doc_ord long, text string")
    other = one.withColumn("text", F.lit("something else"))
    calls = []

    def toks(df, tokenizer=None, version=""):
        before = len(list((tmp_path / "tokens").glob("*/_SUCCESS"))) if calls else 0
        calls.append(1)
        found = units.token_cache(df, path, tokenizer or text.words, version).where("doc_ord = 0").first().toks
        return found, len(list((tmp_path / "tokens").glob("*/_SUCCESS"))) - before

    assert toks(one) == (["aa", "bb"], 2)  # the tokens and the manifest
    assert toks(one.repartition(2)) == (["aa", "bb"], 0)
    assert toks(other) == (["something", "else"], 1)
    assert toks(one, lambda c: F.split(c, "a")) == (["", "", " bb"], 1)
    assert toks(one, version="2") == (["aa", "bb"], 1)
    assert toks(one) == (["aa", "bb"], 0)


def test_an_unfinished_table_is_not_found(spark, tmp_path):
    df = spark.range(5)
    key = stages.content_key(df)
    df.limit(2).write.parquet(str(tmp_path / "t" / key))  # left by a run that was cut off
    assert stages.materialise(df, "numbers", str(tmp_path / "t")).count() == 5
    assert key != stages.content_key(df.withColumn("id", F.col("id") + 1)) != stages.content_key(spark.range(6))


def plan_lines(df) -> list[str]:
    return df._jdf.queryExecution().optimizedPlan().toString().splitlines()


def first_line(lines: list[str], node: str, after: int = -1) -> int:
    return next(i for i, line in enumerate(lines) if i > after and node in line)


@pytest.mark.parametrize("step,cut", [(4, lambda d: c.fixed_chunks(d, 4)), (2, lambda d: c.sliding_chunks(d, 4, 2))])
def test_tokens_are_moved_once(spark, step, cut):
    """Windows are cut after the exchange, so a token that several windows hold is moved once; any token may be given."""
    toks = ["a", "x\ny", None, "", "b c", "\n", "é", "", "d", "e", "f", None, "g"]
    rows = [("d", "m", 0, [], 0), ("d", "m", 1, toks, 13), ("d", "m", 2, [""], 1), ("d", "m", 3, [None], 1), ("d", "m", 9, toks * 9, 117)]
    docs = spark.createDataFrame(rows, "dataset string, month string, doc_ord long, toks array<string>, n_toks int")
    windows = cut(docs)
    stream = [t for r in rows for t in r[3]]
    count = (len(stream) - 1) // 4 if step == 4 else (len(stream) - 4) // 2 + 1
    assert {r.chunk_id: r.toks for r in windows.collect()} == {i: stream[i * step : i * step + 4] for i in range(count)}
    lines = plan_lines(windows)
    assert first_line(lines, "Generate") < first_line(lines, "Aggregate")


def test_positions_are_counted_before_the_vocabulary(spark):
    """What is joined with the vocabulary are counts, not positions."""
    from tidemark.operators import predictors

    docs = spark.createDataFrame([("d", "m", 0, list("abcabcab"), 8)], "dataset string, month string, doc_ord long, toks array<string>, n_toks int")
    bits = predictors.cache_bits(c.fixed_chunks(docs, 4), predictors.vocabulary(docs, "z"), 4)
    lines = plan_lines(bits)
    join = first_line(lines, "Join LeftOuter")
    assert first_line(lines, "Aggregate", join) < first_line(lines, "Join LeftOuter", join)
