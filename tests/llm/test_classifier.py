"""The line field against brute force over all labellings, and the classifier on held-out rows."""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemark.llm import line_crf, quality_classifier
from tidemark.llm.language_id import held_out

TEXTS = ["a b\n\nA1 x.\n", None, "", "x", "\n", "Hi!! Hi!! Hi!!\nHi!! Hi!! Hi!!\n&&& é", "\n\n", "Ünder 12 3\nÜnder 12 3\r\n"]
GOOD = np.array([1, 0, 1, 1, 0, 0, 1, 0], bool)


def drawn(seed):
    lines = line_crf.describe(pa.array(TEXTS))
    weights = np.random.default_rng(seed).normal(size=line_crf.Weights.SIZE) * 0.4
    return lines, weights


def test_lines():
    lines = line_crf.describe(pa.array(TEXTS))
    assert np.diff(lines.first).tolist() == [(t or "").count("\n") + 1 for t in TEXTS]
    assert lines.chars.tolist() == [len(x) for t in TEXTS for x in (t or "").split("\n")]
    copied = [x.strip() != "" and x.split() in [y.split() for y in (t or "").split("\n")[:i]] for t in TEXTS for i, x in enumerate((t or "").split("\n"))]
    assert lines.codes[:, 11].tolist() == copied
    one = [line_crf.describe(pa.array([t], pa.string())).codes for t in TEXTS]  # a text's lines don't depend on its batch
    assert (np.concatenate(one) == lines.codes).all() and lines.codes.max() < line_crf.CODES
    assert len(line_crf.describe(pa.array([], pa.string())).codes) == 0


@pytest.mark.parametrize("seed", [1, 2])
def test_marginals_and_slope(seed):
    lines, weights = drawn(seed)
    model = line_crf.Weights(weights)
    scores = model.scores(lines.codes, lines.first)
    found, loss = line_crf.marginals(scores, lines.first, model.pairs), 0.0
    for d, (a, b) in enumerate(zip(lines.first, lines.first[1:])):
        total, good, own = 0.0, np.zeros(b - a), 0.0
        for labels in itertools.product((0, 1), repeat=b - a):
            e = np.exp(scores[a:b] @ labels + sum(model.pairs[x, y] for x, y in zip(labels, labels[1:])))
            total, good = total + e, good + e * np.array(labels)
            own += e if set(labels) == {int(GOOD[d])} else 0
        assert np.allclose(found[a:b], good / total)
        loss -= np.log(own / total) / (b - a)
    value, slope = line_crf.loss_and_slope(weights, lines.codes, lines.first, GOOD)
    assert np.isclose(value, loss)
    tiny = 1e-5 * np.eye(len(weights))
    near = [(line_crf.loss_and_slope(weights + t, lines.codes, lines.first, GOOD)[0] - line_crf.loss_and_slope(weights - t, lines.codes, lines.first, GOOD)[0]) / 2e-5 for t in tiny]
    assert np.allclose(slope, near, atol=1e-7)


def test_minimise():
    a = np.diag([1.0, 40.0, 7.0])
    x = line_crf.minimise(lambda v: (float((v - 3) @ a @ (v - 3)), 2 * a @ (v - 3)), np.zeros(3), 60)
    assert np.allclose(x, 3, atol=1e-3)


def test_classifier_edges(spark):
    good = [(i, " ".join(f"some{(i * j) % 17} words" for j in range(30)) + ".\nAnd a line.") for i in range(60)]
    bad = [(100 + i, "BUY NOW!! $$$ " * 20 + "\n&&& %%%") for i in range(60)]
    odd = [(None, "fine words here"), (300, None), (301, ""), (302, "\n" * 500), (303, "long line " * 200_000), (1, "repeated id, other text"), (303, "x")]
    docs = spark.createDataFrame(good + bad + odd, "doc_id long, text string").withColumns({"good": F.lit("x"), "quality": F.lit(1), "_most": F.lit(2), "codes": F.lit(3)})
    labels = [(i, int(i < 100), 0) for i, _ in good + bad] + [(5, 0, 0), (6, None, 0), (7, 9, 0), (None, 1, 0), (8, 1, 1), (9_999, 1, 1)]
    labels = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumn("text", F.lit("other"))
    weights = quality_classifier.fit(docs, labels, docs_per_class=25)
    rows = quality_classifier.score(docs.repartition(3), weights).collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 for r in rows)
    found = {r.doc_id: r.score for r in rows}
    assert min(found[i] for i, _ in good if i != 1) > 0.5 > max(found[i] for i, _ in bad)
    assert found[300] == found[301]
    again = quality_classifier.fit(docs, labels, docs_per_class=25)
    assert np.allclose(weights, again)
    empty = docs.limit(0)
    assert quality_classifier.fit(docs, labels.limit(0)) is None and quality_classifier.fit(empty, labels) is None
    assert quality_classifier.score(empty, weights).collect() == []
    assert {r.score for r in quality_classifier.score(docs, None).collect()} == {0.5}
    sizes = quality_classifier.sample(docs, labels, 25).select(F.sum(F.length("good"))).first()[0]
    assert 45 <= sizes <= 50  # a label without a document may be among them


def test_one_class(spark):
    docs = spark.createDataFrame([(i, f"line {i}") for i in range(9)], "doc_id long, text string")
    labels = docs.select("doc_id", F.lit(1).alias("quality"))
    found = quality_classifier.score(docs, quality_classifier.fit(docs, labels)).collect()
    assert all(r.score > 0.5 for r in found)


def test_held_out(spark):
    sf_dir = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    found = quality_classifier.op11(spark, sf_dir)
    assert found.columns == ["doc_id", "held_out", "score", "predicted"]
    rows = found.where(held_out("doc_id")).join(labels, "doc_id").collect()
    assert all(r.held_out and r.predicted == (r.score >= 0.5) for r in rows)
    assert sum(r.predicted == r.quality for r in rows) >= 0.97 * len(rows) and len(rows) > 100
