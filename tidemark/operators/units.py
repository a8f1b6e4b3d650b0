"""Documents -> ordered units (sentences, sections, lines ...) -> budgeted stream."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import fixed, text
from tidemark.operators.prefix import first_rows, hash_bucket, ordinal_bucket, running_total
from tidemark.sources.stages import content_key, materialise

KEYS = ["dataset", "month"]
ORDER = ["doc_ord", "unit_ord"]


def explode_units(docs: DataFrame, units: Column) -> DataFrame:
    """One row per unit; documents without units vanish.

    The outer form is on purpose: for the inner one the optimizer adds a filter that
    splits every text a second time.
    """
    kept = [c for c in docs.columns if c not in ("text", "units")]
    rows = docs.select(*kept, F.posexplode_outer(units).alias("unit_ord", "unit"))
    return rows.where(F.col("unit_ord").isNotNull())


def sentence_units(docs: DataFrame, per_document: int | None = None) -> DataFrame:
    units = text.sentences(F.col("text"))
    return explode_units(docs, units if per_document is None else F.slice(units, 1, per_document))


def section_units(docs: DataFrame, per_document: int = fixed.ARXIV_SECTIONS) -> DataFrame:
    return explode_units(docs, text.first_sections(F.col("text"), per_document))


def whole_units(docs: DataFrame) -> DataFrame:
    return explode_units(docs, F.array("text"))


def code_units(
    docs: DataFrame, max_lines: int = fixed.CODE_LINES, seed: int = fixed.SHUFFLE_SEED,
) -> DataFrame:
    """Files in seeded order; a long file gives one run of `max_lines` lines."""
    lines = docs.withColumn("_lines", text.split_lines(F.col("text")))
    run = line_run(F.col("_lines"), F.col("doc_ord"), max_lines, seed)
    cut = lines.withColumn("text", F.array_join(run, "\n")).drop("_lines")
    ranked = seeded_order(cut, seed).withColumn("doc_ord", F.col("rank")).drop("rank", "shuffle_key")
    return whole_units(ranked)


def line_run(lines: Column, key: Column, size: int, seed: int) -> Column:
    """A repeatable run of `size` lines when there are more, else all of them."""
    start = text.seeded_start(key, seed, F.size(lines) - size)
    return F.when(F.size(lines) > size, F.slice(lines, start + 1, F.lit(size))).otherwise(lines)


def first_documents(docs: DataFrame, n: int) -> DataFrame:
    return first_rows(docs, KEYS, ["doc_ord"], n, ordinal_bucket()).drop("rank")


def seeded_order(docs: DataFrame, seed: int = fixed.SHUFFLE_SEED) -> DataFrame:
    """`rank` of each document in a repeatable random order of its month."""
    hashed = docs.withColumn("shuffle_key", text.seeded_hash(F.col("doc_ord"), seed))
    return running_total(
        hashed, KEYS, ["shuffle_key", "doc_ord"], F.lit(1), hash_bucket("shuffle_key"), out="rank"
    )


# Recipe registry: name -> function from documents to units.  Add entries freely.
RECIPES: dict[str, Callable[[DataFrame], DataFrame]] = {
    "news": lambda docs: sentence_units(first_documents(docs, fixed.NEWS_ARTICLES)),
    "wiki": lambda docs: sentence_units(docs, fixed.WIKI_SENTENCES),
    "code": code_units,
    "arxiv": section_units,
    "math": lambda docs: whole_units(first_documents(docs, fixed.MATH_QUESTIONS)),
}


def byte_budget(
    units: DataFrame, budget: int = fixed.TEXT_BUDGET, cut: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """Units of each month up to the first one that would exceed the byte budget.

    Sizes do not include the joining spaces.  The running size never falls, so the
    filter keeps exactly the units before the first that does not fit.  `place` counts
    the units of the month from 0.

    All units are measured once.  What is moved of that is one number per document; the units of a month's documents
    up to the last one that begins within the budget are then written and placed.  With `cut`, `units` are documents
    and `cut` makes the units of each by itself; then only those documents are cut a second time.
    """

    def sized(rows: DataFrame) -> DataFrame:
        return (rows if cut is None else cut(rows)).withColumn("n_bytes", F.octet_length("unit"))

    sizes = materialise(sized(units).groupBy(*KEYS, "doc_ord").agg(F.sum("n_bytes").alias("_bytes")), "sizes")
    begins = running_total(sizes, KEYS, ["doc_ord"], "_bytes", ordinal_bucket(), out="_begin", limit=budget)
    # One row per (dataset, month), a calendar, not data.
    last = begins.where(F.col("_begin") <= budget).groupBy(*(F.col(c).alias(f"_{c}") for c in KEYS)).agg(F.max("doc_ord").alias("_last"))
    # Units without an ordinal get no place, but their bytes count as those of the month's first ones.
    near = F.col("doc_ord").isNull() | (F.col("doc_ord") <= F.col("_last"))
    rows = units.join(F.broadcast(last), [*(F.col(c) == F.col(f"_{c}") for c in KEYS), near], "left_semi")
    placed = running_total(
        materialise(sized(rows), "near"), KEYS, ORDER, "n_bytes", ordinal_bucket(), out="start", limit=budget, index="place"
    )
    return placed.where(F.col("start") + F.col("n_bytes") <= budget)


def build_stream(units: DataFrame, budget: int = fixed.TEXT_BUDGET, spaced: bool = True) -> DataFrame:
    """The joined text of each month.

    Only units with text are collected, each at least one byte of the budget, so the
    budget bounds the group.  Empty units leave their joining space, which follows
    from the places of their neighbours.
    """
    kept = byte_budget(units, budget)
    filled = F.when(F.col("n_bytes") > 0, F.struct("place", "unit"))
    months = kept.groupBy(*KEYS).agg(
        F.count("*").alias("n_units"), F.array_sort(F.collect_list(filled)).alias("parts")
    )
    if not spaced:
        return months.select(
            *KEYS, F.array_join(F.transform("parts", lambda p: p["unit"]), "").alias("stream"), "n_units"
        )
    checked = F.when(F.col("n_units") <= 2 * budget, F.col("n_units")).otherwise(
        F.raise_error(F.concat(F.lit("too many empty units in "), *KEYS))
    )

    def gap(last: Column, first: Column) -> Column:
        return F.repeat(F.lit(" "), (last - first).cast("int"))

    def with_gap(part: Column, i: Column) -> Column:
        before = F.when(i > 0, F.element_at("parts", F.greatest(i, F.lit(1)))["place"]).otherwise(F.lit(0))
        return F.concat(gap(part["place"], before), part["unit"])

    last = F.coalesce(F.try_element_at("parts", F.lit(-1))["place"], F.lit(0))
    stream = F.concat(F.array_join(F.transform("parts", with_gap), ""), gap(F.col("n_units") - 1, last))
    return months.withColumn("n_units", checked).select(*KEYS, stream.alias("stream"), "n_units")


def tokenize(
    docs: DataFrame, column: str = "text", tokenizer: Callable[[Column], Column] = text.words,
) -> DataFrame:
    """Tokens per document, in order, with the sizes of the text they stand for.

    `tokenizer` takes the text column and gives its array of strings; a pandas UDF will do.
    """
    kept = [c for c in docs.columns if c != column]
    return docs.select(
        *kept,
        F.length(column).alias("n_chars"),
        F.octet_length(column).alias("n_bytes"),
        tokenizer(F.col(column)).alias("toks"),
    ).withColumn("n_toks", F.size("toks"))


def token_cache(
    docs: DataFrame, path: str | None = None, tokenizer: Callable[[Column], Column] = text.words, version: str = "",
) -> DataFrame:
    """Tokenize once into a written table, for work that goes over the tokens more than once.

    With `path`, tokens are kept there by what they were made from: the rows of `docs`, the tokenizer's expression and
    `version`, which tells apart user functions of one name.  Other documents or another tokenizer get tokens of their own.
    """
    toks = tokenize(docs, tokenizer=tokenizer)
    key = None if path is None else content_key(docs, str(tokenizer(F.col("text"))), version)
    return materialise(toks, "tokens", path, key)
