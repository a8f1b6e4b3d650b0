"""Text expressions: units, tokens and cuts.  All stay in the JVM but for bytes, which Arrow has as they are."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Letters, or digits, or any other single character that is not white space.
WORD_PATTERN = r"[a-z]+|[0-9]+|[^a-z0-9\s]"
BLANKS = " \t\n\r\x0b\x0c"
LINE_END = "\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]"
SENTENCE_MARK = "\x1e"
SECTION_SIGN = "§"
# Byte tokens <0x00>..<0xFF> follow the three special ids of a byte-fallback vocabulary.
FIRST_BYTE_ID = 3


# The only letter that gets longer in lower case; without it a character's place is the same in both.
LONG_CAPITAL = "\u0130"


def lowered(text: Column) -> Column:
    """Lower case, character by character."""
    return F.lower(F.replace(text, F.lit(LONG_CAPITAL), F.lit("I")))


def words(text: Column) -> Column:
    # Possessive quantifiers match the same tokens without keeping states to go back to.
    return F.regexp_extract_all(lowered(text), F.lit(WORD_PATTERN.replace("]+", "]++")), F.lit(0))


def words_end(text: Column, k: Column) -> Column:
    """Characters of the source text up to the end of its k-th word."""
    gaps = F.slice(F.split(lowered(text), WORD_PATTERN), F.lit(1), k)
    spans = F.zip_with(gaps, F.slice(words(text), F.lit(1), k), lambda gap, word: F.length(gap) + F.length(word))
    return F.aggregate(spans, F.lit(0), lambda total, n: total + n)


def sentences(text: Column) -> Column:
    """Cut after '.', '!' or '?' that is followed by white space; no empty sentences."""
    marked = F.regexp_replace(text, r"([.!?])\s+", "$1" + SENTENCE_MARK)
    return F.filter(F.split(marked, SENTENCE_MARK), lambda s: s != "")


def strip(text: Column) -> Column:
    """Drop white space at both ends."""
    return F.btrim(text, F.lit(BLANKS))


def split_lines(text: Column) -> Column:
    """Lines by any line end; a final line end opens no further line."""
    lines = F.split(text, LINE_END)
    return F.when(F.element_at(lines, -1) == "", F.slice(lines, 1, F.size(lines) - 1)).otherwise(lines)


def filled_lines(text: Column) -> Column:
    return F.filter(F.split(text, "\n"), lambda line: strip(line) != "")


def sections(text: Column) -> Column:
    """Sections of a paper marked by a section sign, cleaned; NULL when there is none."""
    cleaned = first_sections(text)
    return F.when(F.size(cleaned) > 0, cleaned)


def first_sections(text: Column, n: int | None = None) -> Column:
    """The first `n` sections, or all of them, as an array that may be empty; only these are cleaned."""
    body = F.substr(text, F.greatest(F.instr(text, SECTION_SIGN), F.lit(1)))
    # The sign comes first in the pattern, so that the regex engine looks back only where there is one.
    parts = F.split(body, rf"{SECTION_SIGN}(?<!{SECTION_SIGN}\.{SECTION_SIGN})\s")
    filled = F.filter(parts, lambda part: part.rlike(r"\S"))
    return F.transform(filled if n is None else F.slice(filled, 1, n), _tidy_section)


def _tidy_section(part: Column) -> Column:
    bare = F.replace(F.replace(part, F.lit("<cit.>"), F.lit("")), F.lit("<ref>"), F.lit(""))
    return F.regexp_replace(bare, r"\s+", " ")


@F.arrow_udf(T.ArrayType(T.IntegerType()))
def _byte_values(raw: pa.Array) -> pa.Array:
    """The bytes of a batch are there already, one after the other; only their type changes."""
    raw = raw.cast(pa.large_binary())
    _, bounds, data = raw.buffers()
    at = np.frombuffer(bounds, np.int64)[raw.offset : raw.offset + len(raw) + 1]
    values = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    offsets = pa.array((at - at[0]).astype(np.int32), mask=np.append(raw.is_null().to_numpy(zero_copy_only=False), False))
    return pa.ListArray.from_arrays(offsets, pa.array(values.astype(np.int32)))


def byte_values(text: Column) -> Column:
    """UTF-8 bytes of a string as array<int>."""
    return _byte_values(F.encode(text, "UTF-8"))


def byte_table(ids: Iterable[int]) -> list[int]:
    """Ids of the bytes 0 to 255 in order, checked: the inverse is defined only if no two bytes share an id."""
    table = list(ids)
    if len(table) != 256:
        raise ValueError(f"a byte table has 256 ids, not {len(table)}")
    if len(set(table)) != 256:
        raise ValueError("two bytes share an id, the inverse map is not defined")
    return table


def read_byte_table(rows: DataFrame) -> list[int]:
    """The table from rows (byte, id); a byte that is missing, null or given twice is an error."""
    found = rows.select("byte", "id").where("byte BETWEEN 0 AND 255").groupBy("byte").agg(F.collect_set("id").alias("ids")).collect()
    one = {r["byte"]: r["ids"][0] for r in found if len(r["ids"]) == 1}
    if len(one) != 256:
        raise ValueError(f"{256 - len(one)} bytes have no single id")
    return byte_table(one[b] for b in range(256))


#: The table of a byte-fallback vocabulary.
FALLBACK_TABLE = [b + FIRST_BYTE_ID for b in range(256)]


def byte_tokens(text: Column, table: list[int] = FALLBACK_TABLE) -> Column:
    """Ids of the bytes of a string."""
    lookup = F.array(*[F.lit(i) for i in byte_table(table)])
    return F.transform(byte_values(text), lambda b: F.element_at(lookup, b + 1))


def byte_of_token(token: Column, table: list[int] = FALLBACK_TABLE) -> Column:
    """Byte of an id, NULL where no byte has it."""
    back = F.create_map(*[F.lit(x) for b, i in enumerate(byte_table(table)) for x in (i, b)])
    return F.try_element_at(back, token)


def byte_token_name(value: Column) -> Column:
    return F.format_string("<0x%02X>", value)


def seeded_hash(key: Column, seed: int) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")))


def seeded_start(key: Column, seed: int, span: Column) -> Column:
    """A repeatable start in [0, span), or 0 when there is no room."""
    head = F.conv(F.substring(seeded_hash(key, seed), 1, 8), 16, 10).cast("bigint")
    return F.when(span > 1, F.pmod(head, F.greatest(span, F.lit(1)))).otherwise(F.lit(0)).cast("int")


def before(text: Column, marker: str) -> Column:
    return F.substring_index(text, marker, 1)


def cut_text(text: Column, max_tokens: int) -> Column:
    """First ten characters per allowed token, then the first tokens of that."""
    return F.slice(words(F.substring(text, 1, max_tokens * 10)), 1, max_tokens)
