"""Language ID by words first, then by shorter and shorter character n-grams.

A known word is scored by its log frequency in each language.  A word that no language has is scored by its 5-grams;
a 5-gram that is unknown falls back to the 4-grams in it, and so on down to single characters.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.store import written

LETTERS = re.compile(r"[^\W\d_]+")
ORDERS = (5, 4, 3, 2, 1)
UNKNOWN = "und"
#: Bytes of scores that a task keeps for words, and for the n-grams of each order.
KEPT_BYTES = 16 << 20


@dataclass
class Table:
    """Unit -> row of log2 probabilities, one column per language."""

    at: dict[str, int]
    logs: np.ndarray

    def rows(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Which of `units` are known, and the rows of those."""
        found = np.fromiter((self.at.get(u, -1) for u in units), np.int64, len(units))
        return found >= 0, self.logs[found[found >= 0]]


@dataclass
class LanguageModel:
    langs: list[str]
    words: Table
    grams: dict[int, Table]


class _Kept:
    """Rows worked out by `fill`, found again by key; emptied when they would pass KEPT_BYTES."""

    def __init__(self, width: int, fill: Callable[[list[str]], np.ndarray]):
        self.fill, self.limit = fill, max(1_000, min(300_000, KEPT_BYTES // (8 * width + 8)))
        self.at: dict[str, int] = {}
        self.table = np.zeros((1_024, width))

    def get(self, keys: list[str]) -> np.ndarray:
        at = self.at
        try:
            return self.table[[at[k] for k in keys]]
        except KeyError:
            missing = [k for k in dict.fromkeys(keys) if k not in at]
        if len(at) + len(missing) > self.limit:
            at.clear()
            missing = list(dict.fromkeys(keys))
        values, n = self.fill(missing), len(at)
        if n + len(missing) > len(self.table):
            larger = np.zeros((2 * (n + len(missing)), self.table.shape[1]))
            larger[:n] = self.table[:n]
            self.table = larger
        self.table[n : n + len(missing)] = values
        at.update(zip(missing, range(n, n + len(missing))))
        return self.table[[at[k] for k in keys]]


class Scorer:
    """Scores of words in each language; n-grams carry a last column, how many known n-grams their score adds up."""

    def __init__(self, model: LanguageModel):
        self.model, self.width = model, len(model.langs)
        self.words = _Kept(self.width, self._words)
        self.grams = {k: _Kept(self.width + 1, lambda units, k=k: self._grams(units, k)) for k in ORDERS}

    def _grams(self, units: list[str], k: int) -> np.ndarray:
        known, logs = self.model.grams[k].rows(units)
        out = np.zeros((len(units), self.width + 1))
        out[known, :-1], out[known, -1] = logs, 1
        rest = [units[i] for i in np.flatnonzero(~known)]
        if rest and k > 1:
            halves = self.grams[k - 1].get([u[:-1] for u in rest] + [u[1:] for u in rest])
            out[~known] = halves[: len(rest)] + halves[len(rest) :]
        return out

    def _words(self, words: list[str]) -> np.ndarray:
        known, logs = self.model.words.rows(words)
        out = np.zeros((len(words), self.width))
        out[known] = logs
        rest = [(i, f"<{words[i]}>") for i in np.flatnonzero(~known)]
        for k in ORDERS:
            mine = [(i, p) for i, p in rest if min(len(p), ORDERS[0]) == k]
            if mine:
                windows = np.array([len(p) - k + 1 for _, p in mine])
                scores = self.grams[k].get([p[j : j + k] for _, p in mine for j in range(len(p) - k + 1)])
                total = np.add.reduceat(scores, np.cumsum(windows) - windows)
                out[[i for i, _ in mine]] = total[:, :-1] / np.maximum(total[:, -1:], 1)
        return out


def _table(counts: DataFrame, width: int, keep: int) -> Table:
    """Smoothed log2 frequencies of the `keep` units that are most frequent in any language."""
    columns = [f"n{i}" for i in range(width)]
    totals = counts.agg(*(F.sum(c).alias(c) for c in columns)).first()
    top = counts.orderBy(F.greatest(*columns, F.lit(0)).desc(), "unit").limit(keep).select("unit", *columns).collect()
    base = np.log2(np.array([totals[c] or 0 for c in columns], float) + len(top) + 1)
    found = np.array([r[1:] for r in top], float).reshape(len(top), width)
    return Table({r[0]: i for i, r in enumerate(top)}, np.log2(found + 0.5) - base)


def fit(labelled: DataFrame, docs_per_lang: int = 2_000, keep_words: int = 100_000, keep_grams: int = 100_000) -> LanguageModel:
    """Learn from (doc_id, text, lang), lang not null; other columns are ignored.

    Of each language, about `docs_per_lang` documents are taken, by a hash of doc_id (all, if there are fewer); of all
    units the most frequent `keep_words` words and `keep_grams` n-grams.  Both bounds are what the model may take.
    """
    labelled = labelled.select("doc_id", "text", "lang")  # other columns may have any name
    sizes = labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    langs = sorted(r["lang"] for r in sizes.collect())
    if not langs:
        nothing = Table({}, np.zeros((0, 0)))
        return LanguageModel([], nothing, {k: nothing for k in ORDERS})
    share = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / float(1 << 30)
    sample = labelled.join(F.broadcast(sizes), "lang").where(share * F.col("n") < docs_per_lang).select("lang", "text")

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: dict[tuple[str, str], int] = {}
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
                for w in LETTERS.findall((text or "").lower()):
                    found[lang, w] = found.get((lang, w), 0) + 1
            keys = list(found)
            yield pa.RecordBatch.from_arrays(
                [pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.string()), pa.array(list(found.values()), pa.int64())],
                ["lang", "unit", "n"],
            )

    counted = sample.mapInArrow(split, "lang string, unit string, n long")
    columns = [f"n{i}" for i in range(len(langs))]
    words = written(
        counted.groupBy("unit").agg(*(F.sum(F.when(F.col("lang") == v, F.col("n")).otherwise(0)).alias(c) for v, c in zip(langs, columns))),
        "words",
    )
    padded = F.concat(F.lit("<"), "unit", F.lit(">"))

    def parts(k: int) -> F.Column:
        starts = F.sequence(F.lit(1), F.greatest(F.length(padded) - k + 1, F.lit(1)))
        return F.transform(starts, lambda i: F.substring(padded, i, F.lit(k)))

    # A padded word shorter than k would be counted again as a piece of its own length.
    every = F.concat(*(F.when(F.length(padded) >= k, parts(k)).otherwise(F.array().cast("array<string>")) for k in ORDERS))
    grams = written(
        words.select(F.explode_outer(every).alias("unit"), *columns).groupBy("unit").agg(*(F.sum(c).alias(c) for c in columns)), "grams"
    )
    per_order = {k: _table(grams.where(F.length("unit") == k), len(langs), keep_grams // len(ORDERS)) for k in ORDERS}
    return LanguageModel(langs, _table(words, len(langs), keep_words), per_order)


def predict(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """doc_id, lang_pred, score; one row per row of `docs`; only the text is looked at.

    docs: doc_id, text; other columns are ignored.  score is the winner's share of the posterior, tempered by the
    square root of the number of words, since words of a text aren't independent.  Null text, text without letters,
    and any text when nothing was learned: `und`, 0.  Ties go to the first language by name.
    """
    everywhere = docs.sparkSession.sparkContext.broadcast(model)  # bounded by keep_words and keep_grams

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = everywhere.value
        scorer = Scorer(known)
        for batch in batches:
            langs, scores = [], []
            for text in batch.column("text").to_pylist():
                words = LETTERS.findall((text or "").lower())
                if not known.langs or not any(any(map(str.isalpha, w)) for w in words):  # the pattern lets a lone ² through
                    langs.append(UNKNOWN)
                    scores.append(0.0)
                    continue
                total = scorer.words.get(words).sum(axis=0)
                best = int(np.argmax(total))
                langs.append(known.langs[best])
                scores.append(float(1 / np.exp2((total - total[best]) / math.sqrt(len(words))).sum()))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "lang_pred", "score"]
            )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, lang_pred string, score double")


def held_out(doc_id) -> F.Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 3 == 1, F.lit(False))


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labelled = docs.where("text IS NOT NULL AND lang IS NOT NULL AND doc_id IS NOT NULL").where(~held_out("doc_id"))
    found = predict(docs, fit(labelled.select("doc_id", "text", "lang")))
    return found.select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score")
