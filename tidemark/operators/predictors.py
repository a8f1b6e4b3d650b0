"""What supplies p: counted models, a cache model, outside scores, any batch function.

The counted models never build a full distribution.  Only the probability of observed
tokens is needed, and equal observations are counted before they meet the model.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions import fixed
from tidemark.operators.chunks import explode_chunks, first_scored
from tidemark.operators.pmf import code_length
from tidemark.operators.skew import hot_stats, lookup_weighted
from tidemark.sources.stages import materialise

KEYS = ["dataset", "month"]


# --- unigram ----------------------------------------------------------------
def token_counts(docs: DataFrame) -> DataFrame:
    """Occurrences `k` per (token, dataset, month), and the text bytes of the documents.

    The bytes travel with the first token of each document, so text is read once.  A
    document without tokens gives a NULL token that carries its bytes.
    """
    rows = docs.select(*KEYS, F.col("n_bytes").alias("_size"), F.posexplode_outer("toks").alias("_pos", "tok"))
    return rows.groupBy("tok", *KEYS).agg(
        F.count("tok").alias("k"),
        F.sum(F.when(F.coalesce("_pos", F.lit(0)) == 0, F.col("_size")).otherwise(F.lit(0))).alias("n_bytes"),
    )


def unigram_bits(docs: DataFrame, cutoff: str = fixed.TEST_YEAR_START) -> DataFrame:
    """Bits per month under an add-one unigram model trained on months before `cutoff`.

    p(token) = (c + 1) / (N + V + 1).  The denominator is the same everywhere, so it
    is added once per month, after aggregation.  The window over a token sees one row
    per (dataset, month), however common the token is.
    """
    counts = token_counts(docs)
    train = F.when(F.col("month") < cutoff, F.col("k")).otherwise(F.lit(0))
    of_token = W.partitionBy("tok")
    seen = counts.withColumns({
        "c": F.sum(train).over(of_token),
        "_one": F.row_number().over(of_token.orderBy(*KEYS)) == 1,
    })
    monthly = seen.groupBy(*KEYS).agg(
        F.sum("k").alias("n_tokens"),
        F.sum("n_bytes").alias("n_bytes"),
        F.sum(F.col("k") * F.log2(F.col("c") + 1)).alias("_log"),
        F.sum((F.col("_one") & (F.col("c") > 0)).cast("bigint")).alias("_types"),
        F.sum(train).alias("_train"),
    )
    # From here on there is one row per (dataset, month), a calendar, not data.
    everything = W.partitionBy(F.lit(0))
    size = F.sum("_train").over(everything) + F.sum("_types").over(everything) + 1
    bits = F.col("n_tokens") * F.log2(size) - F.col("_log")
    return monthly.select(*KEYS, "n_tokens", "n_bytes", bits.alias("bits"))


def vocabulary(docs: DataFrame, cutoff: str = fixed.TEST_YEAR_START) -> DataFrame:
    """Train a unigram model: per token `n` occurrences in all months and `c` in the training months.

    The model is a written table, one row per distinct token.
    """
    rows = docs.select("month", F.explode_outer("toks").alias("tok")).where(F.col("tok").isNotNull())
    counts = rows.groupBy("tok").agg(
        F.count("*").alias("n"), F.sum((F.col("month") < cutoff).cast("bigint")).alias("c")
    )
    return materialise(counts, "vocabulary")


def _unigram_size(vocab: DataFrame) -> Column:
    return vocab.agg(F.sum("c") + F.sum((F.col("c") > 0).cast("bigint")) + 1).scalar()


# --- bigram -----------------------------------------------------------------
SLICE_TOKENS = 500_000


def _slice_pairs(part: pa.RecordBatch) -> pa.RecordBatch:
    """Distinct neighbours (prev, tok) in the windows of a batch, with their counts by dataset and month."""
    flat = part.column("toks").flatten().dictionary_encode(null_encoding="encode")
    code, kinds = flat.indices.to_numpy(zero_copy_only=False).astype(np.int64), max(1, len(flat.dictionary))
    row = np.repeat(np.arange(part.num_rows), part.column("toks").value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
    inside = np.flatnonzero(row[1:] == row[:-1])
    first, second = (part.column(c).dictionary_encode(null_encoding="encode") for c in KEYS)
    months = max(1, len(second.dictionary))
    calendar = months * max(1, len(first.dictionary))
    key = first.indices.to_numpy(zero_copy_only=False).astype(np.int64) * months + second.indices.to_numpy(zero_copy_only=False)
    found, k = np.unique((code[inside] * kinds + code[inside + 1]) * calendar + key[row[inside]], return_counts=True)
    pair, key = found // calendar, found % calendar
    opens = np.flatnonzero(np.diff(pair, prepend=-1))
    of_month = pa.StructArray.from_arrays(
        [first.dictionary.take(pa.array(key // months)), second.dictionary.take(pa.array(key % months)), pa.array(k, pa.int64())],
        names=[*KEYS, "k"],
    )
    return pa.RecordBatch.from_arrays(
        [
            flat.dictionary.take(pa.array(pair[opens] // kinds)), flat.dictionary.take(pa.array(pair[opens] % kinds)),
            pa.ListArray.from_arrays(pa.array(np.append(opens, len(pair)), pa.int32()), of_month),
        ],
        names=["prev", "tok", "months"],
    )


def _pairs_of_slices(chunks: DataFrame) -> DataFrame:
    """Pairs counted in slices of bounded size: prev, tok, months (dataset, month, k)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch.column("toks").value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            slot = (np.cumsum(sizes) - sizes) // SLICE_TOKENS
            bounds = [*np.flatnonzero(np.diff(slot, prepend=-1)).tolist(), batch.num_rows]
            yield from (_slice_pairs(batch.slice(a, b - a)) for a, b in zip(bounds, bounds[1:]))

    return chunks.select(*KEYS, "toks").mapInArrow(
        count, "prev string, tok string, months array<struct<dataset: string, month: string, k: bigint>>"
    )


def bigram_bits(
    chunks: DataFrame, cutoff: str = fixed.TEST_YEAR_START, weight: float = 0.5,
) -> DataFrame:
    """Bits per month under weight * c(prev, tok)/c(prev) + (1-weight) * unigram.

    A pair never crosses a chunk.  Pairs are counted inside the tasks, moved once, and written as one row per pair with
    its months; the model is then joined to distinct pairs, not to positions or months.
    """
    train = F.when(F.col("month") < cutoff, F.col("k")).otherwise(F.lit(0))
    # Partitioned by the pair, so neither of the two groupings moves a row again.
    monthly = (
        _pairs_of_slices(chunks).repartition("prev", "tok").select("prev", "tok", F.inline("months"))
        .groupBy("prev", "tok", *KEYS).agg(F.sum("k").alias("k"))
    )
    pairs = monthly.groupBy("prev", "tok").agg(
        F.sum("k").alias("k"), F.sum(train).alias("c_pair"), F.collect_list(F.struct(*KEYS, "k")).alias("months")
    )
    pairs = materialise(pairs, "pairs")

    def stats(column: str) -> DataFrame:
        counts = pairs.groupBy(column).agg(F.sum("k").alias("n"), F.sum("c_pair").alias("c"))
        return materialise(counts, f"pairs-{column}")

    by_prev = stats("prev").select(F.col("prev").alias("_prev"), "n", F.col("c").alias("c_prev"))
    by_tok = stats("tok").select(F.col("tok").alias("_tok"), "n", "c")
    joined = lookup_weighted(pairs, by_prev, "prev", "_prev", "n", ["c_prev"], ["tok"])
    joined = lookup_weighted(joined, by_tok, "tok", "_tok", "n", ["c"], ["prev"])
    p = (
        F.lit(weight) * F.coalesce(F.try_divide("c_pair", "c_prev"), F.lit(0.0))
        + F.lit(1 - weight) * (F.col("c") + 1) / _unigram_size(by_tok)
    )
    of_months = joined.select(code_length(p).alias("_bits"), F.inline("months"))
    return of_months.groupBy(*KEYS).agg(F.sum("k").alias("n_scored"), F.sum(F.col("k") * F.col("_bits")).alias("bits"))


# --- in-window cache --------------------------------------------------------
def _earlier(windows: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """Window number, offset, count of earlier equal tokens, and token of every position."""
    flat = windows.flatten()
    sizes = windows.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    row = np.repeat(np.arange(len(sizes)), sizes)
    n = np.arange(len(row))
    off = n - (np.cumsum(sizes) - sizes)[row]
    code = flat.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
    # Equal tokens of a window become neighbours; the place in their run is the count.
    same = row * (code.max(initial=0) + 1) + code
    order = np.argsort(same, kind="stable")
    run = same[order]
    opens = np.concatenate(([True], run[1:] != run[:-1])) if len(run) else np.zeros(0, dtype=bool)
    earlier = np.empty(len(row), dtype=np.int64)
    earlier[order] = n - np.maximum.accumulate(np.where(opens, n, 0))
    return row, off, earlier, flat


def earlier_counts(chunks: DataFrame, context: int, stride: int | None = None, batch_size: int = 1) -> DataFrame:
    """Counted positions of each window with how often their token came before in it.

    A window has its tokens in one row, so this needs no shuffle and no sort of token
    rows.  It runs on Arrow batches, in slices of bounded size.
    """
    rows = chunks.select(
        *KEYS, "chunk_id", first_scored(F.col("chunk_id"), context, stride, batch_size).alias("first"), "toks"
    )
    step = max(1, SLICE_TOKENS // context)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                row, off, earlier, flat = _earlier(part.column("toks"))
                kept = np.flatnonzero(off >= part.column("first").to_numpy()[row])
                keys = part.select([*KEYS, "chunk_id"]).take(pa.array(row[kept]))
                yield pa.RecordBatch.from_arrays(
                    [*keys.columns, pa.array(off[kept].astype(np.int32)), flat.take(pa.array(kept)),
                     pa.array(earlier[kept])],
                    names=[*KEYS, "chunk_id", "off", "tok", "earlier"],
                )

    return rows.mapInArrow(
        count, "dataset string, month string, chunk_id bigint, off int, tok string, earlier bigint"
    )


def cache_bits(
    chunks: DataFrame, vocab: DataFrame, context: int, stride: int | None = None,
    batch_size: int = 1, weight: float = 0.5,
) -> DataFrame:
    """Bits per month when p mixes a unigram with the token's share of the window so far.

    Positions of hot tokens are served by a broadcast and summed where they are.  The others are counted per month,
    token and share before they meet the vocabulary, so most tokens that are new to their window are one row a month.
    """
    size = _unigram_size(vocab)

    def bits(c: Column, share: Column) -> Column:
        return code_length(F.lit(weight) * ((F.coalesce(c, F.lit(0)) + 1) / size) + share)

    hot = hot_stats(vocab, "n").select(F.col("tok").alias("_hot_key"), F.col("c").alias("_hot_c"))
    rows = earlier_counts(chunks, context, stride, batch_size).select(
        *KEYS, "tok", (F.lit(1 - weight) * F.col("earlier") / F.col("off")).alias("share")
    )
    served = rows.join(F.broadcast(hot), F.col("tok") == F.col("_hot_key"), "left")
    cold = F.col("_hot_key").isNull()
    counts = served.groupBy(
        *KEYS, F.when(cold, F.col("tok")).alias("_tok"), F.when(cold, F.col("share")).alias("share")
    ).agg(F.count("*").alias("k"), F.sum(F.when(~cold, bits(F.col("_hot_c"), F.col("share")))).alias("_bits"))
    joined = counts.join(vocab, F.col("_tok") == F.col("tok"), "left")
    of_row = F.when(F.col("share").isNull(), F.col("_bits")).otherwise(F.col("k") * bits(F.col("c"), F.col("share")))
    return joined.groupBy(*KEYS).agg(F.sum("k").alias("n_scored"), F.sum(of_row).alias("bits"))


# --- outside scores ---------------------------------------------------------
def external_bits(chunks: DataFrame, scores: DataFrame) -> DataFrame:
    """Bits per month from a table of log2 p per (dataset, month, chunk_id, off).

    A window position without a score is an error of the input: it adds no bits and is counted.
    """
    rows = explode_chunks(chunks).where(F.col("off") >= 1)
    joined = rows.join(scores, [*KEYS, "chunk_id", "off"], "left")
    return joined.groupBy(*KEYS).agg(
        F.count("*").alias("n_scored"),
        F.sum(F.col("log2_p").isNull().cast("bigint")).alias("n_missing"),
        F.sum(code_length(F.pow(F.lit(2.0), "log2_p"))).alias("bits"),
    )


def batch_predictor_bits(chunks: DataFrame, predict: Callable[[list[np.ndarray]], np.ndarray]) -> DataFrame:
    """Bits per window from any function of a batch of windows (arrays of tokens).

    `predict` returns one number of bits per window.  It is shipped once per Python
    worker and sees Arrow batches, never single rows.
    """

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            toks = batch.column("toks")
            flat = np.asarray(toks.flatten().to_pandas(), dtype=object)
            ends = np.cumsum(toks.value_lengths().to_numpy(zero_copy_only=False))
            windows = np.split(flat, ends[:-1]) if len(ends) else []
            bits = np.asarray(predict(windows), dtype=np.float64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("dataset"), batch.column("month"), batch.column("chunk_id"), pa.array(bits)],
                names=["dataset", "month", "chunk_id", "bits"],
            )

    return chunks.select(*KEYS, "chunk_id", "toks").mapInArrow(
        score, "dataset string, month string, chunk_id bigint, bits double"
    )


def window_entropy_bits(windows: list[np.ndarray]) -> np.ndarray:
    """Order-0 entropy of each window: a small stand-in for a real model."""
    bits = []
    for window in windows:
        _, counts = np.unique(window.astype(str), return_counts=True)
        bits.append(float(-(counts * np.log2(counts / counts.sum())).sum()))
    return np.asarray(bits)


# --- bytes ------------------------------------------------------------------
#: Bytes of text that are counted at once, and counted pairs that are held before they leave a task.
SLICE_BYTES = 1 << 20
HELD_PAIRS = 1 << 20


def _pair_codes(data: np.ndarray) -> Iterator[np.ndarray]:
    """previous byte * 256 + byte, 256 standing for the start of the text, in slices of bounded size."""
    for at in range(0, len(data), SLICE_BYTES):
        code = data[at : at + SLICE_BYTES].astype(np.int32)
        code[1:] += data[at : at + SLICE_BYTES - 1][: len(code) - 1].astype(np.int32) << 8
        code[0] += (int(data[at - 1]) if at else 256) << 8
        yield code


def byte_pair_counts(docs: DataFrame, column: str = "text") -> DataFrame:
    """Occurrences of (previous byte, byte) per month; prev is -1 at the start of a text.

    Histograms are made inside the task and added up over its batches, in memory that depends neither on the size of a
    batch nor on that of a text.
    """

    def rows(held: dict[tuple, tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        for (dataset, month), (code, k) in held.items():
            prev = code // 256
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([dataset] * len(code), pa.string()),
                    pa.array([month] * len(code), pa.string()),
                    pa.array(np.where(prev == 256, -1, prev), pa.int32()),
                    pa.array(code % 256, pa.int32()),
                    pa.array(k, pa.int64()),
                ],
                names=["dataset", "month", "prev", "byte", "k"],
            )

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, tuple[np.ndarray, np.ndarray]] = {}
        waiting: dict[tuple, list[np.ndarray]] = {}
        size = 0

        def add() -> None:
            for key, codes in waiting.items():
                hist = np.bincount(np.concatenate(codes), minlength=257 * 256)
                if key in held:
                    hist[held[key][0]] += held[key][1]
                code = np.flatnonzero(hist).astype(np.int32)
                held[key] = code, hist[code]
            waiting.clear()

        for batch in batches:
            keys = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())
            for key, raw in zip(keys, batch.column(2)):
                if not raw.is_valid:
                    continue
                for code in _pair_codes(np.frombuffer(raw.as_buffer(), dtype=np.uint8)):
                    waiting.setdefault(key, []).append(code)
                    size += len(code)
                    if size >= SLICE_BYTES:
                        add()
                        size = 0
                        if sum(len(code) for code, _ in held.values()) >= HELD_PAIRS:
                            yield from rows(held)
                            held.clear()
        add()
        yield from rows(held)

    raw = docs.select(*KEYS, F.col(column).cast("binary").alias("raw"))
    partial = raw.mapInArrow(count, "dataset string, month string, prev int, byte int, k bigint")
    return partial.groupBy(*KEYS, "prev", "byte").agg(F.sum("k").alias("k"))


def byte_code_length(pairs: DataFrame) -> DataFrame:
    """Bytes (`compressed_size`) that a month's texts take when each byte is coded by its share after the byte before."""
    of_prev = F.sum("k").over(W.partitionBy(*KEYS, "prev"))
    coded = pairs.withColumn("_prev", of_prev).groupBy(*KEYS)
    return coded.agg((-F.sum(F.col("k") * F.log2(F.col("k") / F.col("_prev"))) / 8).alias("compressed_size"))


def byte_entropy(pairs: DataFrame) -> DataFrame:
    """Order-0 and order-1 bits per byte of each month."""
    of_month, of_prev, of_byte = (W.partitionBy(*KEYS, *more) for more in ([], ["prev"], ["byte"]))
    shares = pairs.withColumns({
        "_all": F.sum("k").over(of_month),
        "_prev": F.sum("k").over(of_prev),
        "_byte": F.sum("k").over(of_byte),
    })
    return shares.groupBy(*KEYS).agg(
        F.sum("k").alias("n_bytes"),
        (-F.sum(F.col("k") * F.log2(F.col("_byte") / F.col("_all"))) / F.sum("k")).alias("order0_bpb"),
        (-F.sum(F.col("k") * F.log2(F.col("k") / F.col("_prev"))) / F.sum("k")).alias("order1_bpb"),
    )
