"""Secret scans by grammar inference.

Strings that the base patterns find are labelled credentials.  For each kind a probabilistic automaton is inferred
from up to `per_kind` of them, and one more from ordinary tokens.  Every token of every text that is as long as a kind's
shortest example, or 16 characters, is then scored: it is a secret when a kind's automaton finds it about as likely as
that kind's own credentials and clearly likelier than the ordinary automaton does.  Base spans always stay, and tokens
that reach beyond one are scored too.  A kind with fewer than 10 distinct examples has no automaton.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.automata import Automaton, infer
from tidemark.llm.store import written

KINDS = ("assign", "access", "hex")
# The base patterns.
ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
_HINT = re.compile(r"assw(?:or)?d|ecret|oken|pi_?key", re.I | re.A)
SHORTEST, LONG = 6, 16  # the least value of a base pattern; from here on a token is scored whatever the examples' lengths
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=.-]{6,}")
CACHED = 100_000  # verdicts on tokens that a worker holds
Span = tuple[int, int, str, str]  # start, end, kind, value


def base_spans(text: str) -> list[Span]:
    out = []
    if _HINT.search(text):
        out += [(m.start(), m.end(), "assign", m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [(m.start(), m.end(), "access", m[0]) for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    out += [(m.start(), m.end(), "hex", m[0]) for m in HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


@dataclass
class Formats:
    """Automata by kind with the least score and length of each kind, and the automaton of ordinary tokens."""

    kinds: dict[str, tuple[Automaton, float, int]]
    ordinary: Automaton | None
    margin: float

    @property
    def shortest(self) -> int:
        return min((n for _, _, n in self.kinds.values()), default=LONG)

    def kind_of(self, token: str) -> str | None:
        best = None
        for kind, (automaton, least, length) in self.kinds.items():
            if len(token) < length:
                continue
            s = automaton.score(token)
            if s >= least and (best is None or s > best[0]):
                best = (s, kind)
        if best is None or self.ordinary and best[0] < self.ordinary.score(token) + self.margin:
            return None
        return best[1]


def examples(docs: DataFrame) -> DataFrame:
    """kind, value of every base match, and tokens outside of them as kind `ordinary`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: set[tuple[str, str]] = set()
            for text in batch.column("text").to_pylist():
                text = text or ""
                spans = base_spans(text)
                found.update((s[2], s[3]) for s in spans)
                found.update(("ordinary", text[a:b]) for a, b in candidates(text, spans, SHORTEST, False))
            rows = sorted(found)
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.string()) for i in (0, 1)], ["kind", "value"])

    return docs.select("text").mapInArrow(run, "kind string, value string")


def candidates(text: str, spans: list[Span], shortest: int, touching: bool = True) -> list[tuple[int, int]]:
    """Tokens of `shortest` characters or more that aren't inside a base span, without the punctuation that ends a sentence.

    Without `touching`, only those that no base span touches.
    """
    out, k = [], 0
    for m in CANDIDATE.finditer(text):
        a, b = m.span()
        while b > a and text[b - 1] in ".-=/":
            b -= 1
        while k < len(spans) and spans[k][1] <= a:
            k += 1
        if b - a >= shortest and not any(s[0] <= a and b <= s[1] if touching else s[0] < b and a < s[1] for s in spans[k:]):
            out.append((a, b))
    return out


def learn(docs: DataFrame, per_kind: int = 1_000, margin: float = 1.0) -> Formats:
    """Infer the automata.  At most `per_kind` distinct values of a kind, the first by hash, come to the driver."""
    found = written(examples(docs), "examples").distinct()
    values = {
        kind: [r["value"] for r in found.where(F.col("kind") == kind).orderBy(F.xxhash64("value"), "value").limit(per_kind).collect()]
        for kind in (*KINDS, "ordinary")
    }
    kinds = {}
    for kind in KINDS:
        if len(values[kind]) >= 10:  # fewer say nothing about a format
            automaton = infer(values[kind])
            scores = sorted(automaton.score(v) for v in values[kind])
            kinds[kind] = (automaton, scores[len(scores) // 50] - 0.1, min(LONG, *map(len, values[kind])))
    return Formats(kinds, infer(values["ordinary"]) if values["ordinary"] else None, margin)


def scan(docs: DataFrame, formats: Formats) -> DataFrame:
    """doc_id, text, spans: array of (start, end, kind) in code points, by start; one row per row of `docs`.

    docs: doc_id, text; other columns are ignored.  Null or empty text has no spans (and is empty).  Kinds that the
    method adds are called like_<kind>.
    """
    everywhere = docs.sparkSession.sparkContext.broadcast(formats)  # at most 4 * per_kind strings went into it

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = everywhere.value
        kind_of = lru_cache(CACHED)(known.kind_of)
        kind_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string())]))
        for batch in batches:
            out = []
            for text in batch.column("text").to_pylist():
                text = text or ""
                base = base_spans(text)
                spans = [(s[0], KINDS.index(s[2]), s[1], s[2]) for s in base]
                for a, b in candidates(text, base, known.shortest):
                    kind = kind_of(text[a:b])
                    if kind:
                        spans.append((a, 3 + KINDS.index(kind), b, f"like_{kind}"))
                out.append([{"start": a, "end": b, "kind": kind} for a, _, b, kind in sorted(spans)])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("text").fill_null(""), pa.array(out, kind_type)], ["doc_id", "text", "spans"]
            )

    schema = "doc_id long, text string, spans array<struct<start:long,end:long,kind:string>>"
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema)


def redact(docs: DataFrame, formats: Formats, mark: str = "[secret]") -> DataFrame:
    """`docs` with all its columns, each found span of the text replaced by `mark`; texts without spans are unchanged."""
    everywhere = docs.sparkSession.sparkContext.broadcast(formats)

    @F.pandas_udf("string")
    def clean(texts):
        known = everywhere.value
        kind_of = lru_cache(CACHED)(known.kind_of)

        def one(text):
            if not text:
                return text
            base = base_spans(text)
            cut = [(s[0], s[1]) for s in base] + [c for c in candidates(text, base, known.shortest) if kind_of(text[c[0] : c[1]])]
            out, at = [], 0
            for a, b in sorted(cut):
                if a >= at:
                    out += [text[at:a], mark]
                at = max(at, b)
            return "".join([*out, text[at:]])

        return texts.map(one)

    cleaned = docs.withColumn("text", clean("text"))
    if "n_chars" in docs.columns:
        cleaned = cleaned.withColumn("n_chars", F.coalesce(F.length("text").cast(docs.schema["n_chars"].dataType), "n_chars"))
    return cleaned


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = scan(docs, learn(docs))

    def joined(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def of(*kinds):
        return F.filter("spans", lambda s: s["kind"].isin(*kinds))

    base = of(*KINDS)
    count = [F.size(of(k)).cast("long").alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *count, F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
