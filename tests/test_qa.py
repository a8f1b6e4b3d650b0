from __future__ import annotations

import json
import random

import pytest
from pyspark.sql import functions as F

from tidemark.functions import prompts
from tidemark.operators import qa
from tidemark.operators.prefix import ordinal_bucket


@pytest.mark.parametrize("n", [1, 3, 50])
def test_until_n_successes(spark, n):
    rng = random.Random(n)
    data = [("m", i * 9000, rng.random() < 0.4) for i in range(60)]
    kept, found = [], 0
    for _, i, ok in data:
        kept.append(i)
        found += ok
        if found >= n:
            break
    df = spark.createDataFrame(data, "month string, o bigint, ok boolean").orderBy(F.rand(1))
    got = qa.until_n_successes(df, ["month"], ["o"], F.col("ok"), n, ordinal_bucket("o"))
    assert sorted(r.o for r in got.collect()) == kept


def test_parse(spark):
    good = json.dumps([{"question": "q", "answer": "a"}, {"answer": "b"}])
    df = spark.createDataFrame([(good,), ("not json",), ("[{",), ("__import__('os')",)], "t string")
    got = [r[0] for r in df.select(qa.parse_qa(F.col("t"))).collect()]
    assert [(x.question, x.answer) for x in got[0]] == [("q", "a"), (None, "b")]
    assert got[1] is None and got[3] is None


def test_dates_and_requestion(spark):
    df = spark.createDataFrame([("Who?", "2017-01-09"), ("Which: who?", "2020-12-31")], "q string, d string")
    dated = df.select(qa.dated(F.col("q"), F.col("d")).alias("q"))
    assert [r.q for r in dated.collect()] == ["Jan 2017: Who?", "Dec 2020: Which: who?"]
    assert [r[0] for r in dated.select(qa.requestion(F.col("q"))).collect()] == ["In Jan 2017, Who?", None]


def lines(n, words=1):
    return "\n".join(" ".join(f"w{i}" for _ in range(words)) for i in range(n))


def files(spark, *texts):
    return spark.createDataFrame(
        [("d", "m", i, t) for i, t in enumerate(texts)], "dataset string, month string, doc_ord bigint, text string"
    )


def test_completion_example(spark):
    target = " ".join(f"x{i}" for i in range(8))
    body = "\n".join(["a b c"] * 130)
    tail = "\n".join([target] * 40 + ["short"] * 5)
    got = qa.completion_examples(files(spark, body + "\n" + tail, lines(50)), n=5).collect()
    rows = [r for r in got if r.doc_ord == 0]
    assert not [r for r in got if r.doc_ord == 1]
    for r in rows:
        assert r.last_line == target
        assert r.prompting_tokens == "x 0 x"
        assert r.left_tokens == "1 x 2 x 3 x 4 x 5 x 6 x 7"


def test_a_block_without_a_long_line_gives_nothing(spark):
    assert qa.completion_examples(files(spark, lines(200)), n=5).count() == 0


@pytest.mark.parametrize("budget,want", [(100, "a b c\nd e\nf"), (3, "d e\nf"), (2, "f"), (0, "a b c\nd e\nf")])
def test_suffix_budget_keeps_all_when_nothing_fits(spark, budget, want):
    df = spark.createDataFrame([(["a b c", "d e", "f"], [3, 2, 1])], "context array<string>, sizes array<int>")
    assert qa.suffix_budget(df, budget).first().code == want


def test_suffix_of_an_empty_context(spark):
    df = spark.createDataFrame([([], [])], "context array<string>, sizes array<int>")
    assert qa.suffix_budget(df).first().code == ""


def test_scores_cut_at_the_marker(spark):
    df = spark.createDataFrame(
        [("m", "ref", ["has ref\nQuestion: more", "none"], ["yes", "no"])],
        "month string, ref_answer string, out array<string>, judges array<string>",
    )
    row = qa.score_answers(df).first()
    assert (row.accuracy, row.llm_acc, row.judged) == (0.5, 0.5, ["has ref", "none"])
    month = qa.monthly_accuracy(qa.score_answers(df)).first()
    assert (month.n_examples, month.accuracy) == (1, 0.5)


def test_batch_requests_are_numbered_per_month(spark):
    df = spark.createDataFrame(
        [("2020-01", 5, "q5", "r", ["a", "b"]), ("2020-01", 70000, "q7", "r", ["c\nQuestion"]), ("2020-02", 1, "q1", "r", ["d"])],
        "month string, id bigint, question string, ref_answer string, out array<string>",
    )
    rows = qa.batch_requests(df, ["id"], ordinal_bucket("id")).orderBy("custom_id").collect()
    assert [r.custom_id for r in rows] == ["2020-01-0-0", "2020-01-0-1", "2020-01-1-0", "2020-02-0-0"]
    assert 'Student answer: "c".' in rows[2].body.messages[0].content
    assert rows[0].body.max_tokens == 8


def test_completion_scores(spark):
    df = spark.createDataFrame([("abcd", ["abcd\nrest", "abzz"], ["Yes", "maybe"])],
                               "left_tokens string, out array<string>, judges array<string>")
    row = qa.score_completions(df).first()
    assert (row.auto_acc, row.llm_acc, row.out) == (0.75, 1.0, ["abcd", "abzz"])


def test_judge_prompts_and_their_answers_meet_again(spark):
    df = spark.createDataFrame([(1, "q", "r", ["a\nQuestion x", "b"])], "id int, question string, ref_answer string, out array<string>")
    rows = qa.judge_prompts(
        df, ["id"], lambda o: prompts.judge(F.lit("gpt-4"), F.col("question"), F.col("ref_answer"), o)
    )
    texts = {r.o: r.prompt for r in rows.collect()}
    assert "Student answer: a You" in texts[0] and "Student answer: b You" in texts[1]
    judged = rows.select("id", "o", F.when(F.col("o") == 0, "Yes").otherwise("No").alias("judge")).orderBy(F.desc("o"))
    assert qa.collect_judges(judged, ["id"]).first().judges == ["Yes", "No"]


def test_code_judge_prompt(spark):
    text = spark.range(1).select(
        prompts.code_judge(F.lit("meta-llama/Meta-Llama-3-8B-Instruct"), F.lit(" x = 1\n"), F.lit("y "))
    ).first()[0]
    assert 'the reference code A. "x = 1"; and the student code B. "y".' in text


def test_knowledge_questions_have_no_date(spark):
    df = spark.createDataFrame(
        [("d", "m", 1, [("Who: he?", "he"), (None, "x")])],
        "dataset string, month string, doc_ord bigint, response array<struct<question:string,answer:string>>",
    )
    rows = qa.questions(qa.flatten_pairs(df, None), "meta-llama/Llama-2-7b-hf", with_date=False).collect()
    assert [(r.question, r.answer, r.prompt) for r in rows] == [("Who: he?", "he", "Question: Who: he?\nAnswer: ")]
