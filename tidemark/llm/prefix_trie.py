"""Prefix trie of conversations by blocks of turns.

A conversation is cut into blocks of a few turns, and each block gets a digest over the digest before it and its turns.
Conversations are grouped by these block digests first.  Turn boundaries are worked out on distinct blocks only, and
only where several blocks follow the same prefix do they have to be grouped again: a lone block's nodes all have the
members of the block.  Turns travel as digests with a length; texts aren't shuffled.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.llm.store import written
from tidemark.operators.skew import lookup_weighted

ROOT = "0" * 32
BLOCK = 4
#: conv_ids that are hashed as one piece of text.
_PACK = 1 << 14
_TURNS = "array<struct<digest:string,chars:bigint>>"
_BLOCKS = "conv_id long, block int, up string, key string, digests string, chars array<long>, last boolean"
_NODES = "node string, up string, depth long, chars long, n_convs long, conv_id long"


def _digest(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()[:32]


def digested(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, digest (of role and text) and chars of each turn; null role or text is empty."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    whole = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)
    return conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long"), "turn", F.substring(F.sha2(whole, 256), 1, 32).alias("digest"),
        F.length(text).cast("long").alias("chars"),
    )


def shared_heads(turns: DataFrame) -> DataFrame:
    """conv_id, skip, head: the first h turns of conversation c - c % 100 take the place of c's own; h = crc32(c) % 6.

    Five turns of every hundredth conversation are all that is kept of it, so no head is large.
    """
    order = [F.asc_nulls_first("turn"), "digest"]
    place = F.row_number().over(W.partitionBy("conv_id").orderBy(*order))
    first = turns.where(F.col("conv_id") % 100 == 0).withColumn("at", place).where("at <= 5")
    ordered = F.array_sort(F.collect_list(F.struct("at", "digest", "chars")))
    first = first.groupBy(F.col("conv_id").alias("from")).agg(ordered.alias("taken"))
    convs = turns.select("conv_id").distinct().select(
        "conv_id", (F.col("conv_id") - F.col("conv_id") % 100).alias("from"),
        (F.crc32(F.col("conv_id").cast("string")) % 6).cast("int").alias("skip"),
    )
    head = F.transform(F.slice("taken", F.lit(1), F.col("skip")), lambda t: F.struct(t["digest"].alias("digest"), t["chars"].alias("chars")))
    return convs.join(first, "from", "left").select("conv_id", "skip", F.coalesce(head, F.array().cast(_TURNS)).alias("head"))


def blocks(turns: DataFrame, heads: DataFrame, size: int) -> DataFrame:
    """Blocks of every conversation with their chain of digests; one without turns has a block -1 at the root.

    Turns come sorted and are read as a stream, so a conversation of any length needs no memory.
    """
    start = heads.select("conv_id", F.lit(None).cast(turns.schema["turn"].dataType).alias("turn"), F.lit(None).cast("string").alias("digest"),
                         F.lit(0).cast("long").alias("chars"), "skip", "head")
    own = turns.select("conv_id", "turn", "digest", "chars", F.lit(None).cast("int").alias("skip"), F.lit(None).cast(_TURNS).alias("head"))
    rows = start.unionByName(own).repartition("conv_id").sortWithinPartitions(
        "conv_id", F.col("skip").isNull(), F.asc_nulls_first("turn"), "digest"
    )

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        conv, skip, number, up, held, waiting = None, 0, 0, ROOT, [], None

        def close(last: bool) -> None:
            """Put out the block before the one at hand; which is the last is known only now."""
            nonlocal waiting, number, up, held
            if waiting:
                out.append((*waiting, last and not held))
                waiting = None
            if held and (last or len(held) == size):
                digests = "".join(d for d, _ in held)
                key = _digest(up, digests)
                waiting = (conv, number, up, key, digests, [c for _, c in held])
                number, up, held = number + 1, key, []
                if last:
                    out.append((*waiting, True))
                    waiting = None
            elif last and number == 0:
                out.append((conv, -1, ROOT, ROOT, "", [], True))

        def sent() -> pa.RecordBatch:
            types = [pa.int64(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.list_(pa.int64()), pa.bool_()]
            names = [c.split()[0] for c in _BLOCKS.split(", ")]
            batch = pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(types)], names)
            out.clear()
            return batch

        for batch in batches:
            columns = (batch.column(c).to_pylist() for c in ("conv_id", "digest", "chars", "skip", "head"))
            for c, digest, chars, n, head in zip(*columns):
                if n is not None:
                    if conv is not None:
                        close(True)
                    conv, skip, number, up, held = c, n, 0, ROOT, []
                    added = [(t["digest"], t["chars"]) for t in head]
                elif skip:
                    skip -= 1
                    continue
                else:
                    added = [(digest, chars)]
                for turn in added:
                    held.append(turn)
                    if len(held) == size:
                        close(False)
            yield sent()
        if conv is not None:
            close(True)
        yield sent()

    return written(rows.select("conv_id", "digest", "chars", "skip", "head").mapInArrow(cut, _BLOCKS), "blocks")


def _boundaries(distinct: DataFrame, size: int) -> DataFrame:
    """A row for each turn of each distinct block: the node after it and the node before."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for up, block, digests, chars, n, conv in zip(*(batch.column(c).to_pylist() for c in ("up", "block", "digests", "chars", "n_convs", "conv_id"))):
                above = up
                for j, c in enumerate(chars, 1):
                    node = _digest(up, digests[: 32 * j])
                    out.append((node, above, block * size + j, c, n, conv))
                    above = node
            columns = list(zip(*out)) if out else [[]] * 6
            types = [pa.string(), pa.string(), *[pa.int64()] * 4]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], [c.split()[0] for c in _NODES.split(", ")])

    return distinct.select("up", "block", "digests", "chars", "n_convs", "conv_id").mapInArrow(run, _NODES)


def nodes(cut: DataFrame, size: int) -> DataFrame:
    """node, up (null: root), depth, chars, n_convs, conv_id (the smallest member)."""
    members = [F.count(F.lit(1)).alias("n_convs"), F.min("conv_id").alias("conv_id")]
    distinct = written(cut.where("block >= 0").groupBy("key", "up", "block", "digests", "chars").agg(*members), "distinct")
    follow = distinct.groupBy("up").agg(F.count(F.lit(1)).alias("n"), F.min("key").alias("key")).where("n = 1")
    lone = distinct.join(follow.select("key"), "key", "left_semi")
    forked = distinct.join(follow.select("key"), "key", "left_anti")
    refined = _boundaries(forked, size).groupBy("node", "up", "depth", "chars").agg(
        F.sum("n_convs").alias("n_convs"), F.min("conv_id").alias("conv_id")
    )
    all_convs = cut.where("last").agg(*members).where("n_convs > 0")
    none = F.lit(None).cast("string")
    root = all_convs.select(
        F.lit(ROOT).alias("node"), none.alias("up"), *(F.lit(0).cast("long").alias(c) for c in ("depth", "chars")), "n_convs", "conv_id"
    )
    return written(_boundaries(lone, size).unionByName(refined).unionByName(root), "nodes")


def subtree_sums(table: DataFrame, columns: list[str]) -> DataFrame:
    """Sums of `columns` over each node and all below it; table: node, up, depth and the columns.

    Reach doubles each round: a node adds what the nodes `reach` below it have summed up, and looks up the ancestor of its
    ancestor.  An ancestor that very many nodes share is broadcast by `lookup_weighted`, fewer than 1,024 of them.
    """
    now = written(table.select("node", F.col("up").alias("far"), *columns), "sums")
    reach, deepest = 1, table.agg(F.max("depth")).first()[0] or 0
    while reach <= deepest:
        live, done = now.where("far IS NOT NULL"), now.where("far IS NULL")
        below = live.groupBy(F.col("far").alias("node")).agg(F.count(F.lit(1)).alias("_n"), *(F.sum(c).alias(f"_{c}") for c in columns))
        below = written(below, "below")
        further = below.select("node", "_n").join(now.select("node", F.col("far").alias("further")), "node")
        moved = lookup_weighted(live, further.withColumnRenamed("node", "_node"), "far", "_node", "_n", ["further"], ["node"])
        moved = moved.drop("far").withColumnRenamed("further", "far").unionByName(done)
        added = [(F.col(c) + F.coalesce(f"_{c}", F.lit(0))).alias(c) for c in columns]
        now = written(moved.join(below, "node", "left").select("node", "far", *added), "sums")
        reach *= 2
    return now.drop("far")


def ends(cut: DataFrame) -> DataFrame:
    """node, ends_sha256: hash of the conv_ids that end at the node, ascending.

    Ids are sorted over all tasks and joined into pieces there; only the pieces of a node meet, in order, and are hashed
    as a stream, so a node at which very many conversations end needs no memory.
    """
    rows = cut.where("last").select(F.col("key").alias("node"), "conv_id")
    rows = rows.repartitionByRange("node", "conv_id").sortWithinPartitions("node", "conv_id")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, ids = None, []

        def piece() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"node": [node], "first": pa.array(ids[:1], pa.int64()), "text": [",".join(map(str, ids))]})

        for batch in batches:
            pieces = []
            for n, c in zip(batch.column("node").to_pylist(), batch.column("conv_id").to_pylist()):
                if ids and (n != node or len(ids) == _PACK):
                    pieces.append(piece())
                    ids = []
                node = n
                ids.append(c)
            if pieces:
                yield pa.Table.from_batches(pieces).combine_chunks().to_batches()[0]
        if ids:
            yield piece()

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, state = None, hashlib.sha256()
        for batch in batches:
            found = []
            for n, text in zip(batch.column("node").to_pylist(), batch.column("text").to_pylist()):
                if n == node:
                    state.update(b",")
                else:
                    if node is not None:
                        found.append((node, state.hexdigest()))
                    node, state = n, hashlib.sha256()
                state.update(text.encode())
            yield pa.RecordBatch.from_pydict({c: pa.array([f[i] for f in found], pa.string()) for i, c in enumerate(("node", "ends_sha256"))})
        if node is not None:
            yield pa.RecordBatch.from_pydict({"node": [node], "ends_sha256": [state.hexdigest()]})

    pieces = rows.mapInArrow(pack, "node string, first long, text string")
    ordered = pieces.repartition("node").sortWithinPartitions("node", "first").select("node", "text")
    return ordered.mapInArrow(digest, "node string, ends_sha256 string")


def conversation_trie(conversations: DataFrame, heads=None, block: int = BLOCK) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256; one row per node.

    conversations: conv_id, turn, role, text; other columns are ignored.  A conversation's turns are ordered by turn, null
    first, and equal ones by a digest of role and text; rows that repeat a turn are turns of their own.  Null role or
    text is empty.  Rows without conv_id belong to no conversation.  `heads` makes from the digested turns a table of
    conv_id, skip, head: turns that take the place of the first `skip`; each conversation has a row there, and one that is
    left without turns ends at the root.  No conversation at all: no node.  `block` turns are one block; it changes no
    result.
    """
    turns = written(digested(conversations), "turns")
    if heads is None:
        none = F.array().cast(_TURNS)
        begin = turns.select("conv_id").distinct().select("conv_id", F.lit(0).alias("skip"), none.alias("head"))
    else:
        begin = heads(turns)
    cut = blocks(turns, begin, block)
    table = nodes(cut, block)
    children = written(table.where("up IS NOT NULL").groupBy(F.col("up").alias("node")).agg(F.count(F.lit(1)).alias("n_children")), "children")
    table = written(table.join(children, "node", "left").fillna(0, ["n_children"]), "nodes")
    weights = table.select(
        "node", "up", "depth", (F.col("n_children") == 0).cast("long").alias("n_leaves"),
        ((F.col("n_convs") - 1) * F.col("chars")).alias("saved_tokens"),
    )
    sums = subtree_sums(weights, ["n_leaves", "saved_tokens"])
    parents = table.where("n_children > 0").select(F.col("node").alias("_node"), F.col("conv_id").alias("parent_conv_id"), "n_children")
    below = lookup_weighted(table.where("up IS NOT NULL"), parents, "up", "_node", "n_children", ["parent_conv_id"], ["node"])
    top = table.where("up IS NULL").withColumn("parent_conv_id", F.lit(None).cast("long"))
    whole = below.unionByName(top).join(sums, "node").join(ends(cut), "node", "left")
    empty = hashlib.sha256(b"").hexdigest()
    return whole.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.lit(empty)).alias("ends_sha256"),
    )


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"), shared_heads)


#: crc32 bit by bit over the decimal digits; paths are lists of turns.
OP12_SQL = """WITH t AS (SELECT conv_id AS c, coalesce(role, '') AS r, coalesce(text, '') AS x,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST,
        sha256(strlen(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, ''))[1:32]) AS p
  FROM conversations WHERE conv_id IS NOT NULL),
ids AS (SELECT c, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(c::VARCHAR, ''), lambda s: ascii(s)::BIGINT)),
    lambda crc, b: list_reduce(list_prepend(xor(crc, b), range(8)),
      lambda v, i: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384::BIGINT) ELSE v >> 1 END)), 4294967295::BIGINT) % 6 AS h
  FROM (SELECT DISTINCT c FROM t)),
head AS (SELECT ids.c, t.p, t.r, t.x FROM ids JOIN t ON t.c = ids.c - ids.c % 100 AND t.p <= ids.h),
every AS (SELECT c, 0 AS own, p, r, x FROM head UNION ALL SELECT t.c, 1, t.p, t.r, t.x FROM t JOIN ids USING (c) WHERE t.p > ids.h),
convs AS (SELECT c, coalesce(list({'r': r, 'x': x} ORDER BY own, p) FILTER (r IS NOT NULL), []) AS l
          FROM ids LEFT JOIN every USING (c) GROUP BY c),
steps AS (SELECT c, l, unnest(range(0, len(l) + 1)) AS d FROM convs),
node AS (SELECT l[1:d] AS path, d AS depth, min(c) AS conv_id, count(*) AS n_convs,
    sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (len(l) = d), '')) AS ends_sha256
  FROM steps GROUP BY l[1:d], d),
kids AS (SELECT path[1:depth - 1] AS path, count(*) AS n FROM node WHERE depth > 0 GROUP BY 1),
own AS (SELECT node.*, coalesce(n, 0) AS n_children,
    CASE WHEN depth = 0 THEN 0 ELSE (n_convs - 1) * length(path[depth].x) END AS saved FROM node LEFT JOIN kids USING (path)),
reach AS (SELECT path, saved, n_children, unnest(range(0, depth + 1)) AS k FROM own),
sums AS (SELECT path[1:k] AS path, sum((n_children = 0)::BIGINT) AS leaves, sum(saved) AS saved FROM reach GROUP BY 1)
SELECT o.conv_id, o.depth, up.conv_id AS parent_conv_id, o.n_convs, o.n_children, leaves::BIGINT AS n_leaves,
    sums.saved::BIGINT AS saved_tokens, o.ends_sha256
FROM own o JOIN sums USING (path) LEFT JOIN node up ON o.depth > 0 AND up.path = o.path[1:o.depth - 1]"""
