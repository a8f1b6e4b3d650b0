"""Token streams cut into fixed or overlapping windows.

Tokens are never numbered by a window over tokens.  Documents are placed by a running
total of their token counts, and each document is cut with `slice` into the pieces
that fall into each block of 16 windows.  A block is put together from its pieces and
cut into windows, so a token is moved once however many windows hold it, and no group
can grow with the data.  Tokens travel as one string per piece.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import fixed, text
from tidemark.operators.prefix import ordinal_bucket, running_total

KEYS = ["dataset", "month"]


def stream_order(docs: DataFrame) -> list[str]:
    """Documents, or their units in order when `docs` holds units."""
    return [c for c in ("doc_ord", "unit_ord") if c in docs.columns]


def place_tokens(docs: DataFrame) -> DataFrame:
    """Add `start`, the stream position of the first token of a document or unit, and the stream's `n_stream`."""
    return running_total(
        docs, KEYS, stream_order(docs), "n_toks", ordinal_bucket(), out="start", total="n_stream"
    ).where(F.col("n_toks") > 0)


# --- counts in closed form --------------------------------------------------
def fixed_count(n: Column, context: int, keep_full_tail: bool = False) -> Column:
    """The last window is dropped, even a full one, unless `keep_full_tail`."""
    full = F.floor(n / context)
    return (full if keep_full_tail else F.greatest(F.ceil(n / context) - 1, F.lit(0))).cast("bigint")


def sliding_count(n: Column, context: int, stride: int) -> Column:
    """Windows start at 0, stride, 2*stride ... until the first short one."""
    return F.when(n < context, F.lit(0)).otherwise(F.floor((n - context) / stride) + 1).cast("bigint")


def tail_start(n: Column, context: int, stride: int | None = None, keep_full_tail: bool = False) -> Column:
    """Position from which tokens count as dropped; 0 when there is no window at all."""
    if stride is None:
        return fixed_count(n, context, keep_full_tail) * context
    count = sliding_count(n, context, stride)
    return F.when(count == 0, F.lit(0)).otherwise((count - 1) * stride + context).cast("bigint")


# --- windows ----------------------------------------------------------------
#: Windows that are put together at once.
BLOCK_WINDOWS = 16
SEPARATOR = "\n"


def _packed(toks: Column) -> Column:
    """Tokens as one string; as they are if one is null or holds the separator.

    A null is written as a separator, so then there are more separators than gaps between tokens.
    """
    joined = F.array_join(toks, SEPARATOR, SEPARATOR)
    gaps = F.octet_length(joined) - F.octet_length(F.replace(joined, F.lit(SEPARATOR), F.lit("")))
    safe = gaps == F.size(toks) - 1
    return F.struct(F.when(safe, joined).alias("joined"), F.when(~safe, toks).alias("toks"))


def _unpacked(packed: Column) -> Column:
    return F.coalesce(packed["toks"], F.split(packed["joined"], SEPARATOR))


def _windows(docs: DataFrame, step: int, width: int, count: Callable[[Column], Column]) -> DataFrame:
    """Windows [i * step, i * step + width) of each stream, `count` of its length."""
    block = step * BLOCK_WINDOWS
    span = block - step + width
    packed = docs.select(*KEYS, *stream_order(docs), "n_toks", _packed(F.col("toks")).alias("packed"))
    placed = place_tokens(packed).withColumns({"n_chunks": count(F.col("n_stream")), "toks": _unpacked(F.col("packed"))})
    first, last = F.col("start"), F.col("start") + F.col("n_toks") - 1
    low = F.greatest(F.lit(0), F.floor((first - span) / block) + 1)
    high = F.least(F.floor(last / block), F.floor((F.col("n_chunks") - 1) / BLOCK_WINDOWS))
    spans = placed.where(low <= high).select(
        *KEYS, "start", "n_toks", "n_chunks", "toks", F.explode(F.sequence(low, high)).alias("block")
    )
    at = F.greatest(F.col("start"), F.col("block") * block)
    end = F.least(F.col("start") + F.col("n_toks"), F.col("block") * block + span)
    cut = F.slice("toks", (at - F.col("start") + 1).cast("int"), (end - at).cast("int"))
    pieces = spans.where(end > at).select(*KEYS, "block", "n_chunks", at.alias("at"), cut.alias("piece"))
    pieces = pieces.withColumn("piece", _packed(F.col("piece")))
    ordered = F.array_sort(F.collect_list(F.struct("at", "piece")))
    blocks = pieces.groupBy(*KEYS, "block").agg(ordered.alias("pieces"), F.max("n_chunks").alias("n_chunks"))
    whole = blocks.select(*KEYS, "block", "n_chunks", F.flatten(F.transform("pieces", lambda p: _unpacked(p["piece"]))).alias("whole"))
    opens = F.col("block") * BLOCK_WINDOWS
    closes = F.least(opens + BLOCK_WINDOWS, F.col("n_chunks")) - 1
    windows = whole.select(*KEYS, "block", "whole", F.explode(F.sequence(opens, closes)).alias("chunk_id"))
    begin = ((F.col("chunk_id") - opens) * step + 1).cast("int")
    return windows.select(*KEYS, "chunk_id", F.slice("whole", begin, F.lit(width)).alias("toks"))


def fixed_chunks(
    docs: DataFrame, context: int = fixed.CONTEXT_SIZE, bos: str | None = None,
    keep_full_tail: bool = False, bos_exact: bool = False,
) -> DataFrame:
    """Consecutive windows.  With `bos`, a window is the mark plus context-1 tokens.

    The token that the mark displaces is left out, so each window still covers
    `context` positions of the stream; `bos_exact` shortens the step to context-1
    instead and loses none.
    """
    step = context - 1 if bos is not None and bos_exact else context
    width = context if bos is None else context - 1
    chunks = _windows(docs, step, width, lambda n: fixed_count(n, step, keep_full_tail))
    if bos is not None:
        chunks = chunks.withColumn("toks", F.concat(F.array(F.lit(bos)), "toks"))
    return chunks


def sliding_chunks(docs: DataFrame, context: int = fixed.CONTEXT_SIZE, stride: int = fixed.STRIDE) -> DataFrame:
    """Overlapping full windows, `stride` apart."""
    if not 0 < stride < context:
        raise ValueError("stride must be positive and smaller than the context size")
    return _windows(docs, stride, context, lambda n: sliding_count(n, context, stride))


def explode_chunks(chunks: DataFrame, *extra: str) -> DataFrame:
    """One row per position of a window; windows are never empty."""
    return chunks.select(*KEYS, "chunk_id", *extra, F.posexplode_outer("toks").alias("off", "tok"))


def batch_of(chunk_id: Column, batch_size: int) -> Column:
    """Windows are numbered without gaps, so the batch is a plain division."""
    return F.floor(chunk_id / batch_size)


def first_scored(chunk_id: Column, context: int, stride: int | None = None, batch_size: int = 1) -> Column:
    """First offset of a window that is predicted and counted.

    The token at offset 0 has no context.  With stride the windows of the first batch
    count like that, later ones only their last stride-1 tokens.
    """
    if stride is None:
        return F.lit(1)
    return F.when(batch_of(chunk_id, batch_size) == 0, F.lit(1)).otherwise(F.lit(context - stride + 1))


def scored(off: Column, chunk_id: Column, context: int, stride: int | None = None, batch_size: int = 1) -> Column:
    return off >= first_scored(chunk_id, context, stride, batch_size)


# --- metadata ---------------------------------------------------------------
def dropped_tail(
    docs: DataFrame, texts: DataFrame, context: int = fixed.CONTEXT_SIZE, stride: int | None = None,
    spaced: bool = True, column: str = "text", end_of: Callable[[Column, Column], Column] = text.words_end,
) -> DataFrame:
    """Size of a month's source text, and of what is behind its last window.

    `docs` are tokenized documents or units and `texts` the same rows with their text in `column`.  The tail is source
    text: it begins where the last kept token ends and has the white space and joining spaces behind that.  Documents
    before and behind are counted by their sizes; text is read only for the one that the boundary falls into.
    `end_of` gives the characters up to the end of the k-th token and belongs to the tokenizer.
    """
    order = stream_order(docs)
    placed = running_total(
        docs, KEYS, order, "n_toks", ordinal_bucket(), out="start", total="n_stream"
    ).withColumn("_cut", tail_start(F.col("n_stream"), context, stride))
    behind = F.col("start") >= F.col("_cut")
    inside = ~behind & (F.col("start") + F.col("n_toks") >= F.col("_cut"))
    edge = placed.where(inside).select(*KEYS, *order, (F.col("_cut") - F.col("start")).cast("int").alias("_k"))
    end = end_of(F.col(column), F.col("_k"))
    kept = texts.select(*KEYS, *order, column).join(edge, [*KEYS, *order]).select(
        *KEYS, end.cast("bigint").alias("_chars_kept"), F.octet_length(F.substring(F.col(column), F.lit(1), end)).cast("bigint").alias("_bytes_kept")
    )
    sizes = {"chars": "n_chars", "bytes": "n_bytes"}
    sums = placed.groupBy(*KEYS).agg(
        F.max("n_stream").alias("n_stream"), F.max("_cut").alias("_cut"), F.count("*").alias("_docs"), F.count_if(behind).alias("_behind"),
        *(F.sum(c).alias(name) for name, c in sizes.items()),
        *(F.coalesce(F.sum(F.when(behind | inside, F.col(c))), F.lit(0)).alias(f"_{name}") for name, c in sizes.items()),
    )
    joins = F.lit(int(spaced))
    spaces, lost_spaces = joins * (F.col("_docs") - 1), joins * (F.col("_behind") - (F.col("_behind") == F.col("_docs")).cast("bigint"))
    return sums.join(kept, KEYS, "left").select(
        *KEYS, "n_stream", (F.col("n_stream") - F.col("_cut")).alias("dropped_tokens"),
        *((F.col(name) + spaces).alias(f"stream_{name}") for name in sizes),
        *((F.col(f"_{name}") + lost_spaces - F.coalesce(f"_{name}_kept", F.lit(0))).alias(f"dropped_{name}") for name in sizes),
    )


def text_metadata(
    docs: DataFrame, texts: DataFrame, context: int = fixed.CONTEXT_SIZE, stride: int | None = None, spaced: bool = True, **tail,
) -> DataFrame:
    """Counts per month that metrics divide by: windows, tokens, characters and bytes.

    Sizes are those of the source text without the dropped tail; see `dropped_tail` for the parameters.
    """
    n = F.col("n_stream")
    count = fixed_count(n, context) if stride is None else sliding_count(n, context, stride)
    return dropped_tail(docs, texts, context, stride, spaced, **tail).select(
        *KEYS,
        "n_stream",
        F.lit(context).alias("context_size"),
        F.lit(stride).cast("int").alias("stride"),
        count.alias("num_chunks"),
        (count * context).alias("num_tokens"),
        *((F.col(f"stream_{c}") - F.col(f"dropped_{c}")).alias(f"num_{c}") for c in ("chars", "bytes")),
        "dropped_chars",
        "dropped_bytes",
    )


def byte_metadata(
    sizes: DataFrame, context: int = fixed.CONTEXT_SIZE, stride: int | None = None,
    budget: int = fixed.BYTE_BUDGET,
) -> DataFrame:
    """Counts per month of a byte stream; `sizes` has one n_bytes per record.

    num_bytes is windows x context also when they overlap.
    """
    per_key = sizes.groupBy(*KEYS).agg(F.least(F.sum("n_bytes"), F.lit(budget)).alias("n_stream"))
    n = F.col("n_stream")
    count = fixed_count(n, context) if stride is None else sliding_count(n, context, stride)
    return per_key.select(
        *KEYS,
        "n_stream",
        F.lit(context).alias("context_size"),
        F.lit(stride).cast("int").alias("stride"),
        count.alias("num_chunks"),
        (count * context).alias("num_bytes"),
        (n - tail_start(n, context, stride)).alias("bytes_dropped"),
    )
