"""The prefix trie against a brute-force one, and its SQL with odd rows."""

from __future__ import annotations

import hashlib
import random
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from tidemark.llm import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string"


def brute(rows, rebuilt=True):
    turns: dict[int, list] = {}
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            digest = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()[:32]
            turns.setdefault(c, []).append((turn is not None, turn or 0, digest, role, text))
    own = {c: [t[3:] for t in sorted(ts)] for c, ts in turns.items()}
    convs = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 6 if rebuilt else 0
        base = int(c / 100) * 100  # towards zero, like %
        convs[c] = own.get(base, [])[:h] + own[c][h:]
    members: dict[tuple, list[int]] = {}
    for c, ts in convs.items():
        for d in range(len(ts) + 1):
            members.setdefault(tuple(ts[:d]), []).append(c)
    children: dict[tuple, int] = {}
    for path in members:
        if path:
            children[path[:-1]] = children.get(path[:-1], 0) + 1
    leaves, saved = dict.fromkeys(members, 0), dict.fromkeys(members, 0)
    for path, m in members.items():
        for d in range(len(path) + 1):
            leaves[path[:d]] += path not in children
            saved[path[:d]] += (len(m) - 1) * len(path[-1][1]) if path else 0
    out = []
    for path, m in members.items():
        ids = ",".join(str(c) for c in sorted(m) if len(convs[c]) == len(path))
        up = min(members[path[:-1]]) if path else None
        out.append((min(m), len(path), up, len(m), children.get(path, 0), leaves[path], saved[path], hashlib.sha256(ids.encode()).hexdigest()))
    return sorted(out, key=str)


def drawn(n, length, seed, texts="ab"):
    rng = random.Random(seed)
    rows = []
    for c in range(n):
        for turn in range(rng.randrange(1, length)):
            rows.append((c * 7 - 300, turn, "user" if turn % 2 == 0 else "bot", rng.choice(texts) * rng.randrange(1, 3) if turn < 3 else "é" + str(turn)))
    rng.shuffle(rows)
    return rows


ODD = [(1, None, "u", "x"), (1, 0, None, None), (1, 0, "", ""), (1, 0, "b", "a"), (1, 0, "b", "a"), (None, 0, "u", "lost"), (100, 0, "u", "base"),
       (100, 1, "b", "y" * 5_000), (101, 0, "u", "own"), (102, 5, "u", "own"), (150, None, None, None), (-5, 1, "u", "x"), (-105, 1, "u", "x")]


@pytest.mark.parametrize("rows", [drawn(90, 7, 1), drawn(400, 3, 2), drawn(30, 40, 3, "a"), ODD, ODD * 2 + drawn(20, 9, 5), [], [(None, 1, "u", "x")]])
def test_rebuilt(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA).withColumns({"node": F.lit("n"), "key": F.lit(1), "head": F.lit(2), "_n": F.lit(3)})
    got = prefix_trie.conversation_trie(df.repartition(3), prefix_trie.shared_heads)
    assert got.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    want = brute(rows)
    assert sorted(map(tuple, got.collect()), key=str) == want
    con = duckdb.connect()
    con.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    if rows:
        con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", rows)
    assert sorted(con.execute(prefix_trie.OP12_SQL).fetchall(), key=str) == want


@pytest.mark.parametrize("block", [1, 3])
def test_plain_trie_for_any_block(spark, block, monkeypatch):
    monkeypatch.setattr(prefix_trie, "_PACK", 3)
    rows = drawn(60, 12, 7) + [(5_000 + i, 0, "user", "the same first turn") for i in range(70)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    assert sorted(map(tuple, prefix_trie.conversation_trie(df, block=block).collect()), key=str) == brute(rows, rebuilt=False)
