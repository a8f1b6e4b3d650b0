"""The whole way from a monthly corpus to a model's records: recipe, byte budget, tokens, windows, bits, metrics."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame

from tidemark.functions import fixed, text
from tidemark.operators.chunks import fixed_chunks, sliding_chunks, text_metadata
from tidemark.operators.records import model_records
from tidemark.operators.units import RECIPES, byte_budget, tokenize
from tidemark.sources.stages import materialise

#: Recipes whose units follow each other without a space.
UNSPACED = {"code"}
#: Recipes that cut each document by itself and leave its `doc_ord`.  Units of others are written before the budget reads
#: them twice, so that texts are moved once.
BY_DOCUMENT = {"wiki", "arxiv"}


def evaluate(
    corpus: DataFrame, recipe: str, bits: Callable[[DataFrame], DataFrame], model: str, context: int = fixed.CONTEXT_SIZE,
    stride: int | None = None, budget: int = fixed.TEXT_BUDGET, tokenizer: Callable[[Column], Column] = text.words,
    end_of: Callable[[Column, Column], Column] = text.words_end,
) -> DataFrame:
    """A record per (dataset, month) of `corpus` (dataset, month, doc_ord, text).

    `recipe` names how documents become units; `bits` takes the windows (dataset, month, chunk_id, toks) and gives
    `bits` per month.  `tokenizer` and `end_of` belong together, see `dropped_tail`.  Units within the budget and their
    tokens are written once each; windows and counts read these.
    """
    cut = RECIPES[recipe]
    kept = byte_budget(corpus, budget, cut) if recipe in BY_DOCUMENT else byte_budget(materialise(cut(corpus), "cut"), budget)
    units = materialise(kept.select("dataset", "month", "doc_ord", "unit_ord", "unit"), "units")
    tokens = materialise(tokenize(units, "unit", tokenizer), "tokens")
    windows = fixed_chunks(tokens, context) if stride is None else sliding_chunks(tokens, context, stride)
    counts = text_metadata(
        tokens, units, context, stride, spaced=recipe not in UNSPACED, column="unit", end_of=end_of
    )
    return model_records(bits(windows), counts, model)
