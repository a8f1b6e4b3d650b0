"""Quality, secrets, packing, language, pages, pieces and the pipeline."""

from __future__ import annotations

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tidemark.llm import automata, html_extract, language_id, packing, quality_rules, secret_scan, sentencepiece_codec
from tidemark.llm.html_lines import blocks

P = pytest.importorskip("public_tokenizers")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.mark.parametrize(
    "text,want",
    [
        ("", (0, 0, 0, 0, 0, 0)),
        ("a b c", (3, 3, 0, 0, 0, 1)),
        ("a b c a b c", (6, 6, 0, 0, 6, 1)),
        ("a b c x a b c", (7, 7, 0, 0, 6, 1)),
        ("é#\n é#\né#\n\n", (3, 6, 3, 1, 0, 3)),
    ],
)
def test_measure(text, want):
    assert quality_rules.measure(text) == want


def test_quality_hosts(spark):
    good = " ".join(f"word{i}" for i in range(80))
    rows = [(i, good, "en", "fine.org", 1) for i in range(40)] + [(100 + i, "bad", "en", "spam.org", 1) for i in range(40)]
    rows += [(200, good, "en", "spam.org", 1), (201, good, None, None, None), (202, None, "en", "fine.org", 1)]
    got = {r.doc_id: r.kept for r in quality_rules.quality(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert all(got[i] for i in range(40)) and got[201]
    assert not got[200] and not got[202] and not got[100]
    assert quality_rules.quality(spark.createDataFrame([], SCHEMA)).collect() == []


def test_base_spans():
    text = 'x API-KEY=no api_key = "abcdef" Token:abc AKIA' + "A1" * 8 + " " + "0f" * 12 + "g"
    found = [(k, text[a:b]) for a, b, k, _ in secret_scan.base_spans(text)]
    assert found == [("assign", 'api_key = "abcdef'), ("access", "AKIA" + "A1" * 8), ("hex", "0f" * 12)]
    assert secret_scan.base_spans("toKen=abcdefgh") == []


def test_automaton_tells_formats_apart():
    rng = random.Random(3)
    keys = ["AKIA" + "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789") for _ in range(16)) for _ in range(300)]
    known = automata.infer(keys[:200])
    assert len(known.moves) < 30
    least = min(known.score(k) for k in keys[:200])
    assert all(known.score(k) > least - 0.5 for k in keys[200:])
    assert known.score("ordinarywordshere") < least - 2


def test_scan_adds_and_redacts(spark):
    rng = random.Random(4)
    hexes = ["".join(rng.choice("0123456789abcdef") for _ in range(32)) for _ in range(60)]
    rows = [(i, f"é key {h} end", "en", "s", 1) for i, h in enumerate(hexes)]
    rows += [(100 + i, f"see internationalisation{i % 10}things and 49{i:014d} too", "en", "s", 1) for i in range(60)]
    rows += [(500, f"lone {hexes[0][:20]} here", "en", "s", 1), (501, None, None, None, None), (502, "", "en", "s", 0)]
    docs = spark.createDataFrame(rows, SCHEMA)
    formats = secret_scan.learn(docs)
    got = {r.doc_id: [(s.start, s.end, s.kind) for s in r.spans] for r in secret_scan.scan(docs, formats).collect()}
    assert got[0] == [(6, 38, "hex")] and got[500] == [(5, 25, "like_hex")]
    assert got[501] == got[502] == [] and not any(got[100 + i] for i in range(60))
    clean = {r.doc_id: r for r in secret_scan.redact(docs, formats).collect()}
    assert clean[500].text == "lone [secret] here" and clean[500].n_chars == 18 and clean[501].text is None


def test_scan_finds_short_tokens_and_whole_keys(spark):
    rng = random.Random(6)
    codes = ["".join(rng.choice("QXZ0123456789") for _ in range(10)) for _ in range(420)]
    rows = [(i, f"token={c} follows ordinary sentences, nothing{chr(97 + i % 26)} hidden herein", "en", "s", 1) for i, c in enumerate(codes[:400])]
    rows += [(1000 + i, f"plain {c} here", "en", "s", 1) for i, c in enumerate(codes[400:])]
    docs = spark.createDataFrame(rows, SCHEMA)
    formats = secret_scan.learn(docs.where("doc_id < 1000"))
    got = {r.doc_id: [(s.start, s.end, s.kind) for s in r.spans] for r in secret_scan.scan(docs, formats).collect()}
    assert sum(got[1000 + i] == [(6, 16, "like_assign")] for i in range(20)) >= 18
    assert all([k for *_, k in got[i]] == ["assign"] for i in range(400))
    keys = [f"K{rng.randint(10, 99)}-" + "".join(rng.choice("0123456789abcdef") for _ in range(24)) + f"-Z{rng.randint(0, 9)}" for _ in range(420)]
    rows = [(i, f"token={c} and ordinary sentences", "en", "s", 1) for i, c in enumerate(keys[:400])]
    formats = secret_scan.learn(spark.createDataFrame(rows, SCHEMA))
    docs = spark.createDataFrame([(i, f"plain {c} here", "en", "s", 1) for i, c in enumerate(keys[400:])], SCHEMA)
    clean = [r.text for r in secret_scan.redact(docs, formats).collect()]
    assert clean.count("plain [secret] here") >= 18


def test_packing_plan():
    rng = random.Random(5)
    for _ in range(30):
        hist = {rng.randint(1, 100): rng.randint(1, 20) for _ in range(12)}
        plan = packing.bin_completion(dict(hist), 100)
        used: dict[int, int] = {}
        for pattern, times in plan:
            assert sum(k * n for k, n in pattern) <= 100
            for k, n in pattern:
                used[k] = used.get(k, 0) + n * times
        assert used == hist
        assert packing.lower_bound(hist, 100) <= sum(n for _, n in plan) <= sum(n for _, n in packing.best_fit(hist, 100))


def test_pack(spark):
    import numpy as np
    from tokenizers import Tokenizer

    path = P.path("word_bpe_49k.json")
    texts = ["Hello, World. it's 1,000 naïve É", None, "", "word " * 5000, "<|endoftext|> Σας", "a"] + ["b c d " * i for i in range(40)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("rank", F.lit(1))
    got = packing.pack(docs, path, with_ids=True, group_rows=5).collect()
    t = Tokenizer.from_file(path)
    whole: dict[int, list] = {}
    for r in sorted(got, key=lambda r: (r.doc_id, r.piece)):
        assert r.start == len(whole.setdefault(r.doc_id, []))
        whole[r.doc_id] += np.frombuffer(r.ids, "<u4").tolist()
    assert whole == {i: t.encode(x or "", add_special_tokens=False).ids + [0] for i, x in enumerate(texts)}
    bins: dict[int, list] = {}
    for r in got:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in bins.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(bins) == -(-sum(map(len, whole.values())) // 2048)
    assert packing.pack(docs.limit(0), path).collect() == []


def _backoff(model, word):
    """Score of one word, straight from the rule."""

    def gram(g):
        table = model.grams[len(g)]
        if g in table.at:
            return table.logs[table.at[g]], 1
        if len(g) == 1:
            return np.zeros(len(model.langs)), 0
        (a, m), (b, n) = gram(g[:-1]), gram(g[1:])
        return a + b, m + n

    if word in model.words.at:
        return model.words.logs[model.words.at[word]]
    padded = f"<{word}>"
    found = [gram(padded[i : i + 5]) for i in range(max(1, len(padded) - 4))]
    return sum(v for v, _ in found) / max(1, sum(n for _, n in found))


def test_language(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = language_id.fit(docs.where(~language_id.held_out("doc_id")).select("doc_id", "text", "lang"))
    held = docs.where(language_id.held_out("doc_id"))
    got = {r.doc_id: r.lang_pred for r in language_id.predict(held, model).collect()}
    want = {r.doc_id: r.lang for r in held.collect()}
    assert sum(got[d] == want[d] for d in want) >= 0.95 * len(want)
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "12 !"), (4, "½ ²"), (None, "été")], "doc_id long, text string")
    rows = {r.doc_id: r for r in language_id.predict(odd, model).collect()}
    assert all(rows[i].lang_pred == "und" and rows[i].score == 0 for i in (1, 2, 3, 4)) and rows[None].lang_pred in model.langs
    scorer = language_id.Scorer(model)
    unseen = ["xqzwv", "thereof" * 4, "ß", "łłłłłłłł", model.langs[0]]
    for word, scored in zip(unseen, scorer.words.get(unseen)):
        assert np.allclose(scored, _backoff(model, word))
    clash = docs.where("doc_id < 60").withColumns({"n": F.lit(1), "unit": F.lit("x"), "langs": F.lit(2)})
    twice = language_id.fit(clash.union(clash))
    assert twice.langs == language_id.fit(clash).langs
    assert language_id.predict(clash.union(clash), twice).count() == 2 * clash.count()
    empty = language_id.fit(docs.limit(0).select("doc_id", "text", "lang"))
    assert {r.lang_pred for r in language_id.predict(odd, empty).collect()} == {"und"}


@pytest.mark.parametrize(
    "page,want",
    [
        ("<p>a<br>b</p><p>c &amp; d", ["a b", "c & d"]),
        ('<div class="ad">x</div><p>hi <b>bold</b>ly</p>', ["hi boldly"]),
        ("<article><header><h1>T</h1></header><p>one<div class='comments'><p>no</p></div><p>two</article><footer>f", ["T", "one", "two"]),
        ('<script>var t="</p>";</script>a < b &lt;i&gt;<!-- c -->', ["a < b <i>"]),
        ("<article>one<form><p>f</p><input></form>two</article>", ["one", "two"]),
    ],
)
def test_blocks(page, want):
    found = blocks(page)
    main = [b.text for b in found if b.in_main and not b.outside]
    assert (main or [b.text for b in found if not b.outside]) == want


def test_pages_lose_shared_lines(spark):
    def page(body):
        return f"<div>Top line</div><div>{body}</div><div>more of {body}</div><div>Bottom</div>"

    rows = [(1, "http://h.org/a/1", page("one")), (2, "http://h.org/a/2", page("two")), (3, "http://alone.org/x", page("three"))]
    rows += [(4, None, None), (5, "http://h.org/b", ""), (6, "http://c.org/1", page("same")), (7, "http://c.org/2", page("same"))]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("page", F.lit("x")).withColumn("gone", F.lit("x"))
    got = {r.page_id: r.text for r in html_extract.extract(pages).collect()}
    assert got[1] == "one\nmore of one" and got[2] == "two\nmore of two"
    assert got[3].startswith("Top line\nthree") and got[4] == got[5] == ""
    assert got[6] == got[7] == "Top line\nsame\nmore of same\nBottom"
    assert html_extract.extract(pages.limit(0)).collect() == []


def test_all_lines_are_compared_and_markup_checks(spark):
    def marked(own):
        return f"<div>Top</div><nav>{own} menu</nav><article><p>{own}</p><p>said by both</p></article><div>Bottom</div>"

    rows = [(7, "http://m.org/1", marked("seven")), (8, "http://m.org/2", marked("eight"))]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in html_extract.extract(pages).collect()}
    assert got[7] == "seven\nsaid by both" and got[8] == "eight\nsaid by both"
    held = html_extract.lines(pages.withColumn("page", F.col("page_id")))
    assert {len(r.lines) for r in held.collect()} == {5}  # menu, article and the rest alike


def test_pages_lose_a_large_template_and_skip_copies(spark):
    def page(*own):
        menu = [f"<div>Menu {i}</div>" for i in range(20)]
        return "".join([*menu[:12], *(f"<p>{o}</p>" for o in own), *menu[12:]])

    rows = [(1, "http://h.org/a/10", page("one", "two", "three")), (2, "http://h.org/a/20", page("four", "five", "six"))]
    rows += [(i, f"http://copy.org/a/1{i}", page("same")) for i in (3, 4, 5)] + [(6, "http://copy.org/b/1", page("other"))]
    rows += [(7, "http://copy.org/a/19", "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in html_extract.extract(pages).collect()}
    assert got[1] == "one\ntwo\nthree" and got[2] == "four\nfive\nsix"
    assert got[3] == got[4] == got[5] == "same" and got[6] == "other" and got[7] == ""


def test_common_is_longest():
    import numpy as np

    rng = np.random.default_rng(2)
    for _ in range(50):
        a, b = rng.integers(0, 5, 12), rng.integers(0, 5, 10)
        best = np.zeros((13, 11), int)
        for i in range(12):
            for j in range(10):
                best[i + 1, j + 1] = best[i, j] + 1 if a[i] == b[j] else max(best[i, j + 1], best[i + 1, j])
        assert len(html_extract.common(a, b)) == best[12, 10]


def test_pieces_round_trip_and_best(spark):
    path = P.path("piece_bpe_32k.model")
    texts = ["Hello  world", None, "", " \n▁x▁ ▁", "日本語 \U0001f600\0 end ", "naïve " * 300]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("ids", F.lit("x"))
    back = {r.doc_id: r.text for r in sentencepiece_codec.decode(sentencepiece_codec.encode(docs, path), path).collect()}
    assert back == {i: t or "" for i, t in enumerate(texts)}
    codec = sentencepiece_codec.Codec.load(path)
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    score = {p: model.get_score(i) for i, p in codec.text.items()}
    rng = random.Random(9)
    letters = "abcdeinorst" * 4 + "ABéßñ,.!#0189▁" + "͸\n\t漢😀"
    drawn = ["".join(rng.choice(letters) for _ in range(rng.randrange(1, 25))) for _ in range(1_000)]
    for word in ("▁international", "▁thonti,", "zzzqx", "▁▁▁a", "▁͸b", *drawn):
        best = [0.0] + [-1e18] * len(word)
        for end in range(1, len(word) + 1):
            best[end] = best[end - 1] + sentencepiece_codec.BYTE_SCORE * len(word[end - 1].encode())
            for at in range(end):
                if word[at:end] in score:
                    best[end] = max(best[end], best[at] + score[word[at:end]])
        got = codec.best_path(word)
        total = sum(score[codec.text[i]] if i in codec.text else sentencepiece_codec.BYTE_SCORE for i in got)
        assert abs(total - best[-1]) < 1e-3 * max(1, abs(total))
        assert codec.decode(got) == word.replace("▁", " ")
    every = ["▁international", "", "▁͸b", *drawn, "a" * 200, *("▁" + w.replace("͸", "") for w in drawn)]
    assert [np.frombuffer(x, "<u4").tolist() for x in codec.best_paths(every)] == [codec.best_path(w) for w in every]
    assert codec.best_paths([]) == []


def test_pipeline(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    kept = {i for i, t in texts.items() if (m := quality_rules.measure(t or ""))[0] >= 50 and 100 * m[4] <= 50 * m[0]}
    first: dict[str, int] = {}
    for i in sorted(kept):
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", texts[i]), i)
    kept = sorted(first.values())
    shingles = {i: (lambda w: set(zip(*(w[j:] for j in range(5)))))(texts[i].encode().lower().split()) for i in kept}
    label = {i: i for i in kept}
    for a in kept:
        for b in kept:
            if b < a and label[a] != label[b] and 180 * len(shingles[a] & shingles[b]) >= 80 * (len(shingles[a]) + len(shingles[b])):
                low, high = sorted((label[a], label[b]))
                label = {x: low if y == high else y for x, y in label.items()}
    got = {r.doc_id for r in corpus_pipeline.run(spark, sf_dir).select("doc_id").distinct().collect()}
    assert got == set(label.values())
