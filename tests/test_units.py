from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from tidemark.functions import text
from tidemark.operators import units
from tidemark.operators.evaluate import evaluate
from tidemark.operators.predictors import unigram_bits
from tidemark.operators.sampling import byte_slices, patches
from tidemark.sources import binary, corpus


def docs(spark, texts, month="2020-01", step=70000):
    return spark.createDataFrame(
        [("d", month, i * step, t) for i, t in enumerate(texts)],
        "dataset string, month string, doc_ord bigint, text string",
    )


def one(spark, column, value):
    return spark.createDataFrame([(value,)], "t string").select(column(F.col("t"))).first()[0]


def test_sentences(spark):
    assert one(spark, text.sentences, "One. Two!  Three?\nFour 3.5 ") == ["One.", "Two!", "Three?", "Four 3.5 "]
    assert one(spark, text.sentences, "") == []


def test_words_match_the_pattern(spark):
    sample = "Ab12 çé--x\tÉ 9z"
    assert one(spark, text.words, sample) == re.findall(text.WORD_PATTERN, sample.lower())


def test_lines(spark):
    for sample in ["a\r\nb\rc\n", "a\n\nb", "", "x\x85y z"]:
        assert one(spark, text.split_lines, sample) == sample.splitlines()
    assert one(spark, text.filled_lines, "a\n \t\nb\n") == ["a", "b"]


def test_sections(spark):
    sample = "intro § A  one\n<cit.> § B§.§ C §  § D<ref>"
    assert one(spark, text.sections, sample) == ["A one ", "B§.§ C ", "D"]
    assert one(spark, text.sections, "  ") is None
    assert one(spark, text.sections, "no mark") == ["no mark"]
    assert one(spark, text.sections, "a§.§.§ x§\n\ny §z§ \t") == ["§.§.§ x", " y §z"]
    assert one(spark, lambda c: text.first_sections(c, 2), "§ a § b § c") == ["a ", "b "]
    assert one(spark, lambda c: text.first_sections(c, 2), "§ §  ") == []


def test_bytes(spark):
    assert one(spark, text.byte_values, "aé") == list("aé".encode())
    assert one(spark, text.byte_tokens, "a") == [97 + text.FIRST_BYTE_ID]
    some = spark.createDataFrame([("x",), (None,), ("",), ("é\0",)], "t string").coalesce(1)
    assert [r[0] for r in some.select(text.byte_values(F.col("t"))).collect()] == [[120], None, [], [195, 169, 0]]
    table = [10 * (b * 3 % 256) for b in range(256)]
    back = some.select(F.transform(text.byte_tokens(F.col("t"), table), lambda i: text.byte_of_token(i, table)))
    assert [r[0] for r in back.collect()] == [[120], None, [], [195, 169, 0]]
    assert spark.range(1).select(text.byte_of_token(F.lit(7), table)).first()[0] is None
    rows = [(b, i) for b, i in enumerate(table)]
    assert text.read_byte_table(spark.createDataFrame(rows + rows[:3], "byte int, id int")) == table
    for wrong in (rows[1:], rows + [(5, 1)], rows[1:] + [(0, table[9])], rows[1:] + [(0, None)]):
        with pytest.raises(ValueError):
            text.read_byte_table(spark.createDataFrame(wrong, "byte int, id int"))
    assert spark.range(1).select(text.byte_token_name(F.lit(10))).first()[0] == "<0x0A>"


def test_cut_text(spark):
    assert one(spark, lambda c: text.cut_text(c, 2), "ab cd ef") == ["ab", "cd"]
    assert one(spark, lambda c: text.cut_text(c, 2), "x" * 19 + " y") == ["x" * 19]
    assert one(spark, lambda c: text.cut_text(c, 2), "x" * 30) == ["x" * 20]


@pytest.mark.parametrize("budget", [0, 3, 4, 9, 1000])
def test_budget_stops_at_the_first_unit_that_does_not_fit(spark, budget):
    texts = ["aaa", "é", "bbbbb", "c", "", "dd"]
    kept, used = [], 0
    for t in texts:
        used += len(t.encode())
        if used > budget:
            break
        kept.append(t)
    rows = units.byte_budget(units.whole_units(docs(spark, texts)), budget)
    assert [r.unit for r in rows.orderBy("doc_ord").collect()] == kept
    stream = units.build_stream(units.whole_units(docs(spark, texts)), budget).collect()
    assert [r.stream for r in stream] == ([" ".join(kept)] if kept else [])
    tight = units.build_stream(units.whole_units(docs(spark, texts)), budget, spaced=False).collect()
    assert [r.stream for r in tight] == (["".join(kept)] if kept else [])


def test_budget_with_ordinals_that_repeat_or_are_null(spark):
    rows = [("d", "2020-01", i, t) for i, t in [(None, "xxx"), (0, "aa"), (0, "aa"), (70000, "b"), (140000, "c")]]
    whole = units.whole_units(spark.createDataFrame(rows, "dataset string, month string, doc_ord bigint, text string"))
    kept = units.byte_budget(whole, 8).orderBy("start").collect()
    assert [(r.unit, r.start, r.place) for r in kept] == [("aa", 3, 1), ("aa", 5, 2), ("b", 7, 3)]


@pytest.mark.parametrize("recipe, again", [("wiki", 11), ("news", 0)])
def test_texts_behind_the_budget_are_cut_once(spark, monkeypatch, recipe, again):
    cuts = spark.sparkContext.accumulator(0)

    @F.udf("array<string>")
    def cut(whole):
        cuts.add(1)
        return whole.split()

    monkeypatch.setitem(units.RECIPES, recipe, lambda rows: units.explode_units(rows, cut("text")))
    sample = docs(spark, ["aaaa bbbbbb"] * 200, step=1)
    bits = lambda windows: unigram_bits(windows.withColumn("n_bytes", F.lit(0))).select("dataset", "month", "bits")
    record = evaluate(sample, recipe, bits, "owner/m", 4, budget=100)
    assert cuts.value <= 200 + again
    assert [(r.batches, r.original_size) for r in record.collect()] == [(4, 95)]


@pytest.mark.parametrize("texts", [["", "", "a", "", "", "b", "", ""], ["", "", ""], ["a"], [""]])
def test_empty_units_leave_their_spaces(spark, texts):
    row = units.build_stream(units.whole_units(docs(spark, texts))).first()
    assert (row.stream, row.n_units) == (" ".join(texts), len(texts))


def test_recipes(spark):
    long = "\n".join(f"line {i}" for i in range(600))
    sample = docs(spark, ["A. B. C.", long, "§ x § y § z"])
    code = units.RECIPES["code"](sample).collect()
    assert sorted(r.doc_ord for r in code) == [0, 1, 2]
    assert max(r.unit.count("\n") for r in code) == 499
    assert next(r.unit for r in code if r.unit.startswith("line")) in long
    assert units.RECIPES["arxiv"](sample).where("unit = 'z'").count() == 0
    assert units.RECIPES["math"](sample).count() == 3
    assert units.RECIPES["wiki"](sample).where("unit = 'C.'").count() == 1
    assert units.RECIPES["news"](sample).count() == units.RECIPES["wiki"](sample).count()


def test_seeded_order_is_a_repeatable_permutation(spark):
    rows = units.seeded_order(docs(spark, ["x"] * 50)).collect()
    assert sorted(r["rank"] for r in rows) == list(range(50))
    by_hash = sorted(rows, key=lambda r: r.shuffle_key)
    assert [r["rank"] for r in by_hash] == list(range(50))
    assert [r.doc_ord for r in by_hash] != sorted(r.doc_ord for r in rows)


def test_byte_slices(spark):
    rec = spark.createDataFrame([("d", "m", 1, bytearray(range(100))), ("d", "m", 2, bytearray(b"short"))],
                                "dataset string, month string, doc_ord bigint, audio binary")
    got = byte_slices(rec, size=10, per_record=5).collect()
    long = [r for r in got if r.doc_ord == 1]
    assert len(long) == 5
    assert all(bytes(r.audio) == bytes(range(r.start, r.start + 10)) for r in long)
    assert [bytes(r.audio) for r in got if r.doc_ord == 2] == [b"short"]


def test_patches_stay_inside_the_image(spark):
    shapes = [(4, 6), (2, 6), (4, 3), (1, 1), (3, 5)]
    data = [("d", "m", i, w, [float(v) for v in range(h * w)]) for i, (h, w) in enumerate(shapes)]
    df = spark.createDataFrame(
        [*data, ("d", "m", 9, 3, None)],
        "dataset string, month string, doc_ord bigint, width int, pixels array<float>",
    )
    got = {r.doc_ord: r for r in patches(df, 3, 5).collect()}
    assert 9 not in got
    for i, (h, w) in enumerate(shapes):
        r, ph, pw = got[i], min(h, 3), min(w, 5)
        want = [float((r.top + y) * w + r.left + x) for y in range(ph) for x in range(pw)]
        assert r.patch == want


def test_corpus_table_prunes_months(spark, tmp_path):
    both = docs(spark, ["a", "b"]).unionByName(docs(spark, ["c"], month="2020-02"))
    corpus.write_corpus(both, str(tmp_path / "c"))
    back = corpus.read_corpus(spark, str(tmp_path / "c"), "d", "2020-02", "2020-02")
    assert [r.text for r in back.collect()] == ["c"]
    plan = back._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(" in plan and "2020-02" in plan


def test_binary_files(spark, tmp_path):
    for month, name, body in [("2020-01", "a.bin", b"12345"), ("2020-02", "b.bin", b"xy"), ("2020-02", "c.txt", b"z")]:
        folder = tmp_path / "audio" / month
        folder.mkdir(parents=True, exist_ok=True)
        (folder / name).write_bytes(body)
    got = {(r.dataset, r.month, r.name): bytes(r.content) for r in binary.read_binary(spark, str(tmp_path), "*.bin").collect()}
    assert got == {("audio", "2020-01", "a.bin"): b"12345", ("audio", "2020-02", "b.bin"): b"xy"}
    rec = spark.createDataFrame([("d", "m", 70000, bytearray(b"cdef")), ("d", "m", 1, bytearray(b"ab"))],
                                "dataset string, month string, doc_ord bigint, audio binary")
    assert bytes(binary.byte_stream(rec, "audio", 4).first().stream) == b"abcd"
