"""HTML extraction by differencing pages with nearest URLs.

Pages of a host are put in order of their URL paths, and each is paired with the neighbour whose path agrees longest.
All text lines of the two are aligned by their longest common subsequence; lines that both have are taken for the
host's template and deleted.  Markup checks the rest: lines of a marked main part come back, since neighbours share
sentences too, and lines that markup names as menus, adverts and the like go even where no partner has them.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.html_lines import blocks
from tidemark.llm.store import written


def lines(pages: DataFrame) -> DataFrame:
    """page, url, hashes of all text lines."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes = [[xxhash.xxh3_64_intdigest(b.text) - (1 << 63) for b in blocks(h or "")] for h in batch.column("html").to_pylist()]
            columns = [batch.column("page"), batch.column("url"), pa.array(hashes, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, ["page", "url", "lines"])

    return pages.select("page", "url", "html").mapInArrow(run, "page long, url string, lines array<long>")


def checked(page: str, gone: set[int]) -> list[str]:
    """Lines of the article: those that differencing left, checked by the markup around each."""
    found = blocks(page)
    marked = any(b.in_main for b in found)
    return [b.text for i, b in enumerate(found) if not b.outside and (b.in_main if marked else i not in gone)]


def common(a: np.ndarray, b: np.ndarray) -> list[int]:
    """Places in `a` of a longest common subsequence with `b`, by the longest rising run of matching places."""
    where: dict[int, list[int]] = {}
    for j, x in enumerate(b.tolist()):
        where.setdefault(x, []).append(j)
    tails: list[int] = []  # least last place in b of a rising run of each length
    nodes: list[tuple[int, tuple | None]] = []
    for i, x in enumerate(a.tolist()):
        for j in reversed(where.get(x, ())):
            k = bisect_left(tails, j)
            node = (i, nodes[k - 1] if k else None)
            if k == len(tails):
                tails.append(j)
                nodes.append(node)
            else:
                tails[k], nodes[k] = j, node
    out, node = [], nodes[-1] if nodes else None
    while node:
        out.append(node[0])
        node = node[1]
    return out[::-1]


def nearest(pages: DataFrame) -> DataFrame:
    """page, partner: pages of the same host with close paths; a page whose host has no other content has no row.

    pages: page, url, content; a page is never paired with one of equal `content`, a copy says nothing about a template.

    Paths are compared in small groups that share a beginning: first within directory and all but the last two
    characters of the name, then pages that were alone there within the directory, then within the host's first part of
    the path, then within the host.  So no window holds a whole large host, unless all its pages are copies of one.
    """
    host = F.lower(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))
    path = F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    place = pages.select("page", "content", host.alias("host"), F.regexp_replace(path, "/+$", "").alias("path")).where("host <> ''")
    folder = F.regexp_extract("path", r"^(.*)/[^/]*$", 1)
    keys = [
        F.expr("substring(path, 1, greatest(length(path) - 2, 0))"), folder, F.regexp_extract("path", r"^(/[^/]*)", 1), F.lit(""),
    ]
    left, out = place, None
    for level, key in enumerate(keys):
        group = Window.partitionBy("host", "key").orderBy("path", "page")
        back = Window.partitionBy("host", "key").orderBy(F.desc("path"), F.desc("page"))
        near = left.withColumn("key", key)
        for name, order in (("lag", group), ("lead", back)):
            # The neighbour of a run of copies, carried along the run.
            near = near.withColumn(name, F.lag(F.struct("page", "path", "content")).over(order))
            near = near.withColumn(name, F.when(F.col(f"{name}.content") != F.col("content"), F.col(name)))
            near = near.withColumn(name, F.last(name, ignorenulls=True).over(order))
        near = near.select("page", "content", "host", "path", *(F.col(f"{n}.{c}").alias(f"{n}_{c}") for n in ("lag", "lead") for c in ("page", "path")))

        def agree(other):
            """Number of characters, up to 64, that both paths begin with."""
            parts = F.transform(F.sequence(F.lit(1), F.lit(64)), lambda n: (F.substring("path", F.lit(1), n) == F.substring(F.col(other), F.lit(1), n)).cast("int"))
            return F.when(F.col(other).isNull(), -1).otherwise(F.aggregate(parts, F.lit(0), lambda s, x: s + x))

        near = near.withColumn("partner", F.when(agree("lag_path") >= agree("lead_path"), F.coalesce("lag_page", "lead_page")).otherwise(F.col("lead_page")))
        near = written(near.select("page", "content", "host", "path", "partner"), f"near-{level}")
        paired = near.where("partner IS NOT NULL").select("page", "partner")
        out = paired if out is None else out.union(paired)
        left = near.where("partner IS NULL").select("page", "content", "host", "path")
    return out


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text; one row per row of `pages`.

    pages: page_id, url, html; other columns are ignored.  Null or empty html gives an empty text.  All lines that the
    nearest page with other lines shares are deleted.  If the markup has a main part, that is the article all the same,
    without parts in it that are named otherwise.  A page without a URL, or on a host that has no page but copies of it,
    keeps what the markup doesn't name otherwise.  Rows that repeat a page_id are paired by their URLs.
    """
    row = F.xxhash64("page_id", "url", "html")
    keyed = pages.select("page_id", "url", "html", row.alias("page"))
    held = written(lines(keyed).dropDuplicates(["page"]), "lines")
    filled = held.where(F.size("lines") > 0)  # a page without text shares nothing
    pairs = nearest(filled.select("page", "url", F.xxhash64("lines").alias("content")))
    both = pairs.join(held.select("page", "lines"), "page").join(held.select(F.col("page").alias("partner"), F.col("lines").alias("other")), "partner")

    def diff(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = zip(batch.column("lines").to_pylist(), batch.column("other").to_pylist())
            gone = [common(np.array(a, np.int64), np.array(b, np.int64)) for a, b in both]
            yield pa.RecordBatch.from_arrays([batch.column("page"), pa.array(gone, pa.list_(pa.int32()))], ["page", "gone"])

    template = both.select("page", "lines", "other").mapInArrow(diff, "page long, gone array<int>").where(F.size("gone") > 0)

    def article(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for page, gone in zip(batch.column("html").to_pylist(), batch.column("gone").to_pylist()):
                texts.append("\n".join(checked(page or "", set(gone or ()))))
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string())], ["page_id", "url", "text"])

    joined = keyed.join(template, "page", "left").select(F.col("page_id").cast("long"), "url", "html", "gone")
    return joined.mapInArrow(article, "page_id long, url string, text string")


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return done.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
