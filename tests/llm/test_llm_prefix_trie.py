"""The prefix trie against a dictionary of all prefixes, through one and through many partitions."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from llm import prefix_trie as P
from llm.queries import ORACLE, QUERIES, crossed_conversations


def brute(convs):
    """Rows of all nodes of ``{conv_id: [(role, text), ...]}``."""
    member, kids = {}, {}
    for c, t in convs.items():
        for d in range(len(t) + 1):
            member.setdefault(tuple(t[:d]), []).append(c)
    for k in member:
        if k:
            kids.setdefault(k[:-1], []).append(k)
    leaves, saved = {}, {}
    for k in sorted(member, key=len, reverse=True):
        own = (len(member[k]) - 1) * len(k[-1][1].encode()) if k else 0
        leaves[k] = sum(leaves[x] for x in kids.get(k, [])) or 1
        saved[k] = own + sum(saved[x] for x in kids.get(k, []))
    out = []
    for k, m in member.items():
        ends = sorted(c for c in m if len(convs[c]) == len(k))
        out.append((min(m), len(k), min(member[k[:-1]]) if k else None, len(m), len(kids.get(k, [])), leaves[k], saved[k],
                    hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()))
    return sorted(out, key=str)


def random_conversations(seed, n=400):
    rng = random.Random(seed)
    out, known = {}, []
    for i in range(n):
        t = list(rng.choice(known))[:rng.randint(0, 30)] if known and rng.random() < 0.7 else []
        for _ in range(rng.choice((0, 0, 1, 2, 5, 40))):
            t.append((rng.choice(("user", "assistant", "")), rng.choice(("", "a", "bc", "é 水", f"text {rng.randrange(50)}"))))
        known.append(t)
        out[i * 7 - 500] = t
    out.update({10_000 + i: known[-1] for i in range(300)})  # one conversation many times
    out.update({20_000 + i: [("user", "hello")] * i for i in range(60)})  # each one a prefix of the next
    return out


def rows(spark, convs, **sizes):
    turns = [(c, i if i else None, r or None, t or None) for c, x in convs.items() for i, (r, t) in enumerate(x)]
    df = spark.createDataFrame(turns, "conv_id long, place long, role string, text string").repartition(5)
    df = df.select("conv_id", "place", P.turn_digest(F.col("role"), F.col("text")).alias("digest"), F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("size"))
    found = P.paths(df, spark.createDataFrame([(c,) for c in [*convs, None]], "conv_id long"))
    nodes = P.prefix_trie(found, **sizes).join(P.ended_digests(found, block=16), "ended", "left")
    cols = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens"]
    return sorted((tuple(r) for r in nodes.select(*cols, F.coalesce("digest", F.sha2(F.lit(""), 256))).collect()), key=str)


@pytest.mark.parametrize("sizes", [{}, {"rows": 30, "fan": 8}, {"rows": 1, "fan": 4}, {"turns": 100, "fan": 2 ** 20}])
def test_equals_brute_force(spark, sizes):
    convs = random_conversations(len(sizes) + sum(sizes.values()), 60 if sizes.get("rows") == 1 else 400)
    assert rows(spark, convs, **sizes) == brute(convs)


def test_edge_rows(spark):
    schema = "conv_id long, turn long, role string, text string, n long, path string, depth string, place string"
    data = [(None, 0, "user", "lost"), (1, None, None, None), (1, 0, "user", "x" * 70_000), (1, 0, "user", "x" * 70_000), (2, None, "", ""), (2, 1, "user", "tie"),
            (2, 1, "tool", "tie"), (-5, 3, "user", "below zero"), (0, 0, "user", "base")]
    df = spark.createDataFrame([r + (1, "p", "d", "q") for r in data], schema)
    found = crossed_conversations(df)
    assert {r.conv_id for r in found.collect()} == {1, 2, -5, 0}
    nodes = P.prefix_trie(found).collect()
    root = [r for r in nodes if r.depth == 0]
    assert len(root) == 1 and (root[0].n_convs, root[0].parent_conv_id, root[0].conv_id) == (4, None, -5)
    assert P.prefix_trie(crossed_conversations(df.limit(0))).collect() == []


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    import zlib

    own = {}
    for r in spark.read.parquet(f"{sf}/conversations.parquet").orderBy("conv_id", "turn").collect():
        own.setdefault(r.conv_id, []).append((r.role or "", r.text or ""))
    convs = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 9
        convs[c] = own.get(c - c % 5, [])[:h] + own[c][h:]
    cols = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    got = QUERIES["op12_prefix_trie"](spark, sf)
    assert sorted((tuple(r) for r in got.select(*cols).collect()), key=str) == brute(convs) and "op12_prefix_trie" in ORACLE
