"""SentencePiece encoding and decoding: an Aho-Corasick automaton over the pieces drives one Viterbi pass.

The automaton reports, at each position, every piece that ends there (it follows its output links); each relaxes the
best score at its end from the best score at its start.  In a vocabulary whose pieces hold the space mark only at
their front, no piece spans a new word, so the best path of a text is that of its words, and each distinct word is
searched once per worker.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterable, Iterator
from itertools import chain, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.arrays import slices
from tidemark.llm.wordcache import WordCache

MARK = "▁"
BYTE_SCORE = -1e11  # per byte of a character that no path of pieces covers; below any score of a piece
#: Longest word, in characters, that is searched together with others.
_TOGETHER = 64
#: Words that are searched together; the arrays for that take some 2 kB a word.  Bytes of text that are worked on at a time.
_WORDS = 8_192
_SLICE = 1 << 20
_READY: dict[str, tuple["Codec", WordCache]] = {}


class Codec:
    """Pieces with scores, and 256 byte pieces for what they don't cover.  decode(encode(text)) == text for any text."""

    def __init__(self, pieces: Iterable[tuple[int, str, float]], byte_ids: list[int]):
        import ahocorasick

        self.text = {i: p for i, p, _ in pieces}
        self.byte_ids = byte_ids
        self.raw = [b""] * (1 + max([*self.text, *byte_ids]))
        for i, p in self.text.items():
            self.raw[i] = p.replace(MARK, " ").encode()
        for b, i in enumerate(byte_ids):
            self.raw[i] = bytes([b])
        self.alone = frozenset(p for p in self.text.values() if len(p) == 1)
        self.length, self.score = np.zeros(len(self.raw), np.int64), np.zeros(len(self.raw))
        self.automaton = ahocorasick.Automaton()
        for i, p, s in pieces:
            self.length[i], self.score[i] = len(p), s
            self.automaton.add_word(p, i)
        self.automaton.make_automaton()
        self.lengths, self.scores = self.length.tolist(), self.score.tolist()
        # A run of spaces with what follows up to the next one.  A literal mark stands alone, and so does a line end that no
        # piece has in it: its bytes cut the best path there.
        cut = MARK if any("\n" in p for p in self.text.values()) else MARK + "\n"
        self.runs = re.compile(f" *[^ {cut}]+|[{cut}]| +")
        self.gap = next(chr(c) for c in range(0x110000) if not any(chr(c) in p for p in self.text.values()))
        if any(MARK in p.lstrip(MARK) for p in self.text.values()):
            raise ValueError("a piece spans two words")

    @classmethod
    def load(cls, path: str) -> "Codec":
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(model.get_piece_size())
        plain = [i for i in ids if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        byte_ids = [model.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        return cls([(i, model.id_to_piece(i), model.get_score(i)) for i in plain], byte_ids)

    def best_path(self, word: str) -> list[int]:
        """Ids of the best segmentation of one marked word; the first relaxation wins ties.

        Matches come in the order of their ends.  A character that is a piece needs no bytes, so each position has a
        path before the next one's matches; for other characters their bytes are relaxed first, and any piece wins.
        """
        best = [0.0]
        put = best.append
        back: list[tuple[int, int]] = [(0, 0)]
        if self.alone.issuperset(word):
            at = 0
            lengths, scores = self.lengths, self.scores
            for last, i in self.automaton.iter(word):
                length = lengths[i]
                cost = best[last + 1 - length] + scores[i]
                if last == at:
                    put(cost)
                    back.append((length, i))
                    at += 1
                elif cost > best[at]:
                    best[at], back[at] = cost, (length, i)
        else:
            matches: list[list[int]] = [[] for _ in word]
            for last, i in self.automaton.iter(word):
                matches[last].append(i)
            for end, found in enumerate(matches, 1):
                put(best[end - 1] + BYTE_SCORE * len(word[end - 1].encode()))
                back.append((1, -1))
                for i in found:
                    length = self.lengths[i]
                    cost = best[end - length] + self.scores[i]
                    if cost > best[end]:
                        best[end], back[end] = cost, (length, i)
        out, at = [], len(word)
        while at:
            length, i = back[at]
            if i < 0:
                out += [self.byte_ids[b] for b in reversed(word[at - 1].encode())]
            else:
                out.append(i)
            at -= length
        return out[::-1]

    def best_paths(self, words: list[str]) -> list[bytes]:
        """Ids of `best_path` of every word, as little-endian uint32: one pass of the automaton over all of them.

        Words of one batch relax their positions together, the first ones of all words, then the second ones.  Long words
        and those with characters that are no piece go one by one.
        """
        out: list[bytes] = [b""] * len(words)
        many = []
        for k, w in enumerate(words):
            if 0 < len(w) <= _TOGETHER and self.alone.issuperset(w):
                many.append(k)
            elif w:
                out[k] = np.array(self.best_path(w), "<u4").tobytes()
        if not many:
            return out
        size = np.fromiter((len(words[k]) for k in many), np.int64, len(many)) + 1
        start = np.cumsum(size) - size  # the place before a word; places 1, 2 ... of it follow, and no piece goes over the gap
        matches = self.automaton.iter(self.gap.join([words[k] for k in many]))
        found = np.fromiter(chain.from_iterable(matches), np.int64).reshape(-1, 2)
        end, piece = found[:, 0] + 1, found[:, 1]
        step = end - np.repeat(start, size)[end - 1]
        order = np.argsort(step, kind="stable")
        end, piece = end[order], piece[order]
        length, score = self.length[piece], self.score[piece]
        best, back = np.zeros(int(size.sum())), np.zeros(int(size.sum()), np.int64)
        bounds = np.searchsorted(step[order], np.arange(1, int(size.max()) + 1))
        for a, b in zip(bounds.tolist(), bounds[1:].tolist()):
            at, cost = end[a:b], best[end[a:b] - length[a:b]] + score[a:b]
            head = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
            top = np.maximum.reduceat(cost, head)
            group = np.repeat(np.arange(len(head)), np.diff(np.append(head, len(at))))
            won = np.flatnonzero(cost == top[group])[::-1]  # backwards, so that the first of equals is written last
            best[at[head]] = top
            back[at[won]] = piece[a + won]
        taken = np.zeros(len(back), bool)
        now, left = start + size - 1, start
        while len(now):
            taken[now] = True
            now = now - self.length[back[now]]
            now, left = now[now > left], left[now > left]
        ids = back[taken].astype("<u4").tobytes()
        cuts = np.concatenate([[0], np.cumsum(np.add.reduceat(taken, start, dtype=np.int64))]) * 4
        for k, a, b in zip(many, cuts.tolist(), cuts[1:].tolist()):
            out[k] = ids[a:b]
        return out

    def decode(self, ids: Iterable[int]) -> str:
        return b"".join(map(self.raw.__getitem__, ids)).decode()


def _ready(path: str) -> tuple[Codec, WordCache]:
    if path not in _READY:
        codec = Codec.load(path)
        mark = np.array([codec.byte_ids[b] for b in MARK.encode()], "<u4").tobytes()

        def ids(missing: list[str]) -> Iterator[bytes]:
            for at in range(0, len(missing), _WORDS):
                part = missing[at : at + _WORDS]
                found = codec.best_paths([w.replace(" ", MARK) for w in part])
                yield from (mark if w == MARK else f for w, f in zip(part, found))  # in bytes, so that it doesn't come back as a space

        _READY[path] = codec, WordCache(ids, 200_000)
    return _READY[path]


def encode(docs: DataFrame, model: str) -> DataFrame:
    """doc_id, ids (little-endian uint32); one row per row of `docs`.

    docs: doc_id, text; other columns are ignored.  Null or empty text has no ids.  No normalisation and no dummy space
    in front, so decoding gives the text back exactly.  `model` is the path of a SentencePiece vocabulary with byte
    pieces.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec, cache = _ready(model)
        for whole in batches:
            for batch in slices(whole, "text", _SLICE):
                runs = [codec.runs.findall(t or "") for t in batch.column("text").to_pylist()]
                found = iter(cache.get(list(chain.from_iterable(runs))))
                ids = [b"".join(islice(found, len(r))) for r in runs]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(ids, pa.binary())], ["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, ids binary")


def decode(encoded: DataFrame, model: str) -> DataFrame:
    """doc_id, text from doc_id, ids; null ids give an empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec, _ = _ready(model)
        for batch in batches:
            texts = [codec.decode(np.frombuffer(b or b"", "<u4").tolist()) for b in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_ids, ids_crc32, decoded_sha256: every text encoded, and decoded again from its ids."""
    import public_tokenizers

    model = public_tokenizers.path("piece_bpe_32k.model")
    encoded = encode(spark.read.parquet(f"{sf_dir}/documents.parquet"), model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec, _ = _ready(model)
        for whole in batches:
            for batch in slices(whole, "ids", _SLICE):
                raw = batch.column("ids").to_pylist()
                texts = [codec.decode(np.frombuffer(b, "<u4").tolist()) for b in raw]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id"), pa.array([len(b) // 4 for b in raw], pa.int64()),
                        pa.array([zlib.crc32(b) for b in raw], pa.int64()), pa.array(texts, pa.string()),
                    ],
                    ["doc_id", "n_ids", "ids_crc32", "text"],
                )

    back = encoded.mapInArrow(run, "doc_id long, n_ids long, ids_crc32 long, text string")
    return back.select("doc_id", "n_ids", "ids_crc32", F.sha2("text", 256).alias("decoded_sha256"))
