"""Dedup operators against brute force on small tables, with nulls, ties, repeats, empty and long texts."""

from __future__ import annotations

import hashlib
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tidemark.llm import exact_dedup, jaccard_join, substring_dedup, suffix_dedup

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def prose(seed: int, n: int) -> str:
    out = []
    for _ in range(n):
        seed = (seed * 1103515245 + 12345) % 2**31
        out.append(WORDS[seed >> 16 & 15] + str(seed >> 8 & 7))
    return " ".join(out)


@pytest.fixture(scope="module")
def rows():
    shared = prose(5, 60)
    rows = [(i, prose(i, 40 + i)) for i in range(20)]
    rows += [(20, None), (21, ""), (22, " \n"), (23, "one"), (24, "one two"), (25, "One  TWO")]
    rows += [(30, rows[3][1]), (31, rows[3][1].replace(" ", "\n", 1)), (32, prose(77, 10) + " " + shared), (33, shared + " é " + prose(78, 10))]
    rows += [(34, "ab " * 400), (35, "ab " * 300 + "end"), (36, shared.upper()), (37, prose(99, 3000)), (38, prose(99, 2999) + " x")]
    return rows + [(40 + i, prose(5, 200 - i) + f" tail{i}") for i in range(12)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    # Columns whose names the operators use themselves.
    return frame.withColumns({c: F.lit("other") for c in ("bid", "hash", "kept", "digest", "label", "n_shingles", "length")})


def sha(b: bytes) -> str:
    return hashlib.sha256(b).hexdigest()


def test_bytes(docs, rows):
    first, want = {}, []
    for d, t in rows:
        b = (t or "").encode()
        for i in range(len(b) - 49):
            s = b[i : i + 50]
            first[s] = min(d, first.get(s, d))
    for d, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - 49):
            if first[b[i : i + 50]] < d:
                gone[i : i + 50] = b"\1" * 50
        spans = sum(x and not y for x, y in zip(gone, b"\0" + gone))
        want.append((d, len(b), sum(gone), spans, sha(bytes(x for x, g in zip(b, gone) if not g))))
    got = suffix_dedup.dedup_bytes(docs, batch_bytes=2000)
    got = got.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256)).collect()
    assert sorted(map(tuple, got)) == sorted(want)


@pytest.mark.parametrize("window", [20, 3])
def test_words(docs, rows, window):
    first, want = {}, []
    for d, t in sorted(rows):
        w = (t or "").encode().split()
        for i in range(len(w) - window + 1):
            first.setdefault(tuple(w[i : i + window]), (d, i))
    for d, t in rows:
        w = (t or "").encode().split()
        gone = bytearray(len(w))
        for i in range(len(w) - window + 1):
            if first[tuple(w[i : i + window])] != (d, i):
                gone[i : i + window] = b"\1" * window
        want.append((d, len(w), sum(gone), b" ".join(x for x, g in zip(w, gone) if not g).decode()))
    assert sorted(map(tuple, substring_dedup.dedup_substrings(docs, window, 2000).collect())) == sorted(want)


@pytest.mark.parametrize("run", [substring_dedup.op4, jaccard_join.op3])
def test_long_word_elsewhere(spark, tmp_path, run):
    """A word of over 64 bytes in a batch leaves the hashes of the batch's other words as they are in all batches."""
    same = " ".join(f"word{i}" for i in range(60))
    rows = [(i, same if i else f"{'x' * 200} y{i} {same}") for i in range(24)]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(24).write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r for r in run(spark, str(tmp_path)).collect()}
    if run is substring_dedup.op4:
        assert {d: r.n_removed for d, r in got.items()} == {d: 60 if d else 0 for d, _ in rows}
    else:
        assert {r.component_id for r in got.values()} == {0}


def test_words_of_rows_that_share_an_id(spark):
    """Earlier is a smaller doc_id, or an earlier start in the same row."""
    a, b = prose(1, 50), prose(2, 50)
    rows = [(5, a), (5, a), (5, f"{b} {b} {a}"), (9, f"{a} end"), (None, b), (None, b), (None, prose(3, 30)), (None, prose(3, 30))]
    got = substring_dedup.dedup_substrings(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id or 99, r.n_words, r.n_removed) for r in got) == [
        (5, 50, 0), (5, 50, 0), (5, 150, 50), (9, 51, 50), (99, 30, 0), (99, 30, 0), (99, 50, 50), (99, 50, 50)
    ]


@pytest.mark.parametrize("k,percent,block", [(5, 80, 4_096), (3, 90, 3)])
def test_jaccard(docs, rows, k, percent, block):
    sets = {}
    for d, t in rows:
        w = bytes(x + 32 if 65 <= x <= 90 else x for x in (t or "").encode()).split()
        sets[d] = {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()
    label = {d: d for d in sets}
    for d in sorted(sets):
        for e in sorted(sets):
            both = len(sets[d] & sets[e])
            if e < d and both and 100 * both >= percent * len(sets[d] | sets[e]) and label[d] != label[e]:
                low, high = sorted((label[d], label[e]))
                label = {x: low if y == high else y for x, y in label.items()}
    got = jaccard_join.near_duplicates(docs, k, percent, block).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted(map(tuple, got)) == sorted((d, len(sets[d]), label[d]) for d in sets)
    assert len(set(label.values())) < len(rows)


@pytest.mark.parametrize("percent", [80, 90])
def test_linked_sets_share_a_key(percent):
    import numpy as np

    rng = np.random.default_rng(percent)
    level = rng.integers(0, 9, jaccard_join._CELLS).astype(np.uint8)
    seen = 0
    for n in (1, 2, 3, 9, 40, 333):
        for _ in range(40):
            base = rng.integers(0, 2**63, n).astype(np.uint64)
            gone = int(rng.integers(0, n * (100 - percent) // 100 + 1))
            other = np.concatenate([base[gone:], rng.integers(0, 2**63, gone // 3).astype(np.uint64)])
            a, b = np.unique(base), np.unique(other)
            both = len(np.intersect1d(a, b))
            if 100 * both >= percent * (len(a) + len(b) - both):
                seen += 1
                assert np.intersect1d(*(jaccard_join.rare_keys(s, percent, level) for s in (a, b))).size
                assert np.intersect1d(*(jaccard_join.part_keys(s, percent) for s in (a, b))).size
    assert seen > 150


def test_passages_form_no_blocks_and_blocks_fit_tasks(spark):
    """A passage that all documents have connects none of them; a group of copies of all sizes is cut and whole."""
    rng = random.Random(11)
    passage = " ".join(f"p{i}" for i in range(60))
    rows = [(i, f"{passage} " + " ".join(f"{i}w{j}" for j in range(30 + i % 400))) for i in range(300)]
    chain = [f"c{j}" for j in range(60)]
    for i in range(300, 420):  # each is a near copy of the one before it, and the last is ten times as long as the first
        chain = chain[rng.randrange(2):] + [f"{i}c{j}" for j in range(1 + len(chain) // 25)]
        rows.append((i, " ".join(chain)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    found = jaccard_join.near_duplicates(docs, 5, 80, 24)
    assert {r.doc_id: r.component_id for r in found.collect()} == {i: i if i < 300 else 300 for i, _ in rows}
    level = jaccard_join.commonness(docs, 5)
    sets = list(jaccard_join.shingle_sets(pa.array([t for _, t in rows[:300]]), 5))
    common = set.intersection(*(set(s.tolist()) for s in sets))
    first = [set(jaccard_join.rare_keys(s, 80, level).tolist()) for s in sets]
    assert len(common) == 56 and sum(map(len, first)) == len(set().union(*first))


def test_tree_bounds_lose_no_link():
    import numpy as np

    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**63, 400).astype(np.uint64)
    sets = [np.unique(np.concatenate([base[: 300 + i], rng.integers(0, 2**63, i % 7).astype(np.uint64)])) for i in range(90)]
    found = jaccard_join.links(sets, None, np.arange(len(sets)), 90)
    label = list(range(len(sets)))
    for p, q in found:
        label = [label[p] if x == label[q] else x for x in label]
    near = [(i, j) for i in range(90) for j in range(i) if 190 * len(np.intersect1d(sets[i], sets[j])) >= 90 * (len(sets[i]) + len(sets[j]))]
    assert near and all(label[i] == label[j] for i, j in near)


@pytest.mark.parametrize("files,digest", [(None, exact_dedup.sha256), (1, exact_dedup.sha256), (1, lambda t: F.unhex(F.lpad(F.hex(F.crc32(t) % 5), 4, "0")))])
def test_exact(docs, rows, files, digest):
    """The last digest has five values only, so the full bytes must tell documents apart."""
    import re

    groups: dict[str, list[int]] = {}
    for d, t in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", t or ""), []).append(d)
    want = [(d, min(g), len(g), d == min(g), sha(t.encode())) for t, g in groups.items() for d in g]
    got = exact_dedup.dedup_exact(docs, digest, files).collect()
    assert sorted(map(tuple, got)) == sorted(want)


@pytest.mark.parametrize("digest", [exact_dedup.sha256, lambda t: F.unhex(F.lit("00"))])
def test_exact_keeps_one_row_of_a_group(spark, digest):
    rows = [(1, "a b"), (1, "a  b"), (2, "a b"), (None, "a b"), (None, "c"), (None, "c"), (None, "c"), (3, "d"), (3, "e")]
    got = exact_dedup.dedup_exact(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), digest, copies=True).collect()
    assert len(got) == len(rows)
    kept = [(r.doc_id, r.group_size) for r in got if r.kept]
    assert sorted(kept, key=str) == sorted([(1, 4), (None, 3), (3, 1), (3, 1)], key=str)
    assert sorted(r.copy for r in got) == [0] * 6 + [1] * 3 and not [r for r in got if r.copy and r.kept]


def test_pipeline_stages_judge_rows_not_ids(spark):
    good, other, near = (" ".join(f"{w}{i}" for i in range(90)) for w in "abc")
    rows = [(None, good, "h"), (None, good, "h"), (None, "short", "h"), (None, other, "h"), (7, near, "h"), (7, near + " end", "h"), (7, "too short", "h")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    for name, stage, want in (
        ("quality", corpus_pipeline.quality, sorted([good, good, other, near, near + " end"])),
        ("exact", corpus_pipeline.exact, sorted(["short", "too short", good, other, near, near + " end"])),
        ("near", corpus_pipeline.near, None),
    ):
        texts = sorted(r.text for r in stage(spark, docs, "").collect())
        if want is None:
            assert len(texts) == 5 and texts.count(good) == 1 and {"short", "too short", other} <= set(texts), name
        else:
            assert texts == want, name


def test_state_goes_on(spark, tmp_path):
    """Documents of a later run are compared with those of an earlier one."""
    src, out, state = (str(tmp_path / x) for x in ("src", "out", "state"))
    schema = "digest binary, doc_id long, locator long"
    for rows in ([(b"a", 5, 1), (b"b", 6, 2)], [(b"a", 3, 3), (b"a", 9, 4)]):
        spark.createDataFrame([(bytearray(d), i, at) for d, i, at in rows], schema).write.mode("append").parquet(src)
        exact_dedup.stream_first(spark.readStream.schema(schema).parquet(src), state, out)
    got = {bytes(r.digest): (r.keep_id, r.keep_at, r.n) for r in exact_dedup.latest(spark, out).collect()}
    assert got == {b"a": (3, 3, 3), b"b": (6, 2, 1)}


def test_nothing_null_and_repeated(spark):
    schema = "doc_id long, text string"
    none = spark.createDataFrame([], schema)
    odd = spark.createDataFrame([(None, "x y z " * 30), (1, "x y z " * 30), (1, "x y z " * 30)], schema)
    for run in (suffix_dedup.dedup_bytes, substring_dedup.dedup_substrings, jaccard_join.near_duplicates, exact_dedup.dedup_exact):
        assert run(none).collect() == []
        assert len(run(odd).collect()) == 3


def test_jaccard_keeps_rows_of_one_id_apart(spark):
    """The second text of doc_id 2 is near 1 and has a set of its own; it isn't compared as the first one's."""
    a, b = prose(1, 80), prose(2, 80)
    rows = [(1, a), (2, b), (2, a + " x"), (3, b + " y"), (4, prose(3, 80))]
    found = jaccard_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 3, 90)
    assert found.count() == len(rows)
    assert [r.component_id for r in found.where("doc_id = 4").collect()] == [4]
