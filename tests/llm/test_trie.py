"""Operator 12 and running sums."""

import collections
import hashlib
import itertools
import random
import zlib

import pytest
from pyspark.sql import functions as F

from quire.llm.running import running_sums
from quire.llm.trie import OP12_SQL, numbered_turns, op12_trie, prefix_trie, rebuilt_turns, trie_of
from tests.llm import brute
from tests.oracle import connect, same

SCHEMA = "conv_id long, turn long, role string, text string"


def in_order(rows):
    """{conv_id: [(role, text)]} by turn, null first, ties by role and text."""
    found = collections.defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            found[conv].append((turn is not None, turn or 0, role or "", text or ""))
    return {c: [r[2:] for r in sorted(t)] for c, t in found.items()}


def rebuilt(convs):
    out = {}
    for c, turns in convs.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - int(c / 20) * 20
        out[c] = convs.get(c - base, [])[:h] + turns[h:]
    return out


def nodes_of(convs):
    """The nodes by plain recursion over sets of members."""
    out = []

    def visit(prefix, members, parent):
        depth, low = len(prefix), min(members)
        ends = sorted(c for c in members if len(convs[c]) == depth)
        groups = collections.defaultdict(list)
        for c in members:
            if len(convs[c]) > depth:
                groups[convs[c][depth]].append(c)
        leaves, saved = 0, (len(members) - 1) * len(brute.words(prefix[-1][1])) if prefix else 0
        for turn, some in groups.items():
            more = visit([*prefix, turn], some, low)
            leaves, saved = leaves + more[0], saved + more[1]
        leaves = leaves or 1
        digest = hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()
        out.append((low, depth, parent, len(members), len(groups), leaves, saved, digest))
        return leaves, saved

    if convs:
        visit([], list(convs), None)
    return sorted(out, key=str)


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.fixture(scope="module")
def turns():
    rng = random.Random(5)
    rows = []
    for c in itertools.chain(range(0, 130, 2), (-20, -7, 1001, 1003)):
        texts = ["hello there", "a b c", "", None, "x"][: rng.randint(0, 5)] if rng.random() < 0.6 else [f"t{rng.randrange(3)} w" for _ in range(rng.randint(1, 6))]
        rows += [(c, k, ("user", "assistant")[k % 2], t) for k, t in enumerate(texts)]
    rows += [(500 + c, k, "user", f"deep {k}") for c in range(12) for k in range(c + 1)]  # each hangs on the one before
    rows += [(700, k, "user", f"deep {k}") for k in range(60)]  # long
    rows += [(c, 0, "user", "same") for c in range(800, 860)]  # many that end in one node
    rows += [(40, None, None, "null turn"), (None, 1, "user", "no id"), (41, 3, "user", "tie b"), (41, 3, "user", "tie a"), (41, 3, "user", "tie a")]
    return rows


def test_nodes_match_recursion(spark, turns):
    df = spark.createDataFrame(turns, SCHEMA)
    assert rows_of(prefix_trie(df)) == nodes_of(in_order(turns))
    assert rows_of(trie_of(*rebuilt_turns(df))) == nodes_of(rebuilt(in_order(turns)))


def test_edges(spark):
    rows = [(3, 1, None, None), (3, 2, "", ""), (1, 1, "user", "w " * 40_000), (1, 2, "a", "b")]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("conv", F.lit("x")).withColumn("depth", F.lit(9))
    assert rows_of(prefix_trie(df)) == nodes_of(in_order(rows))
    assert prefix_trie(df.limit(0)).count() == 0
    assert rows_of(trie_of(*rebuilt_turns(spark.createDataFrame([(20, 0, "user", "a")], SCHEMA)))) == nodes_of({20: [("user", "a")]})


def test_order_of_turns(spark):
    rows = [(1, 2, "b", "x"), (1, None, "z", "y"), (1, 2, "a", "y" * 300 + "b"), (1, 2, "a", "y" * 300 + "a")]
    df = spark.createDataFrame(rows, SCHEMA)
    hashes = {r.h: r.text[-1] for r in df.select(F.xxhash64(F.lit(1), "role", "text").alias("h"), "text").collect()}
    assert [hashes[r.h1] for r in sorted(numbered_turns(df).collect(), key=lambda r: r.place)] == ["y", "a", "b", "x"]


def test_running_sums_of_large_keys(spark):
    rows = [(k, at, k * 100 + at) for k, n in ((1, 3000), (2, 1), (3, 40), (4, 1500)) for at in range(n)]
    random.Random(1).shuffle(rows)
    got = running_sums(spark.createDataFrame(rows, "k long, at long, v long").repartition(7), "k", ["at"], ["v"], ["at"], "t").collect()
    for key in (1, 2, 3, 4):
        mine = sorted((at, v) for k, at, v in rows if k == key)
        assert sorted((r.at, r.v) for r in got if r.k == key) == list(zip((at for at, _ in mine), itertools.accumulate(v for _, v in mine)))
    big = spark.createDataFrame([(1, k, (1 << 62) + k) for k in range(50)], "k long, at long, v long")  # wraps around
    want = list(itertools.accumulate((1 << 62) + k for k in range(50)))
    assert [r.v % (1 << 64) for r in sorted(running_sums(big, "k", ["at"], ["v"], ["at"], "t").collect())] == [w % (1 << 64) for w in want]


def test_query_matches_sql(spark, sf):
    same(op12_trie(spark, sf), OP12_SQL, connect(sf))


def test_query_matches_recursion(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert rows_of(op12_trie(spark, sf)) == nodes_of(rebuilt(in_order(rows)))
