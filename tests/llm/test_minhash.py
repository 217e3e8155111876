"""Operator 11."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quire.llm.jaccard import Threshold
from quire.llm.minhash import MinMax, near_duplicates, op11_minhash
from quire.llm.shingles import mix
from tests.llm import brute

LIMIT = Threshold(17, 20)


def linked_components(docs):
    """{index: (set size, least index of its component)} by comparing all pairs."""
    sets = [brute.shingles(t, 3) for t in docs]
    low = list(range(len(docs)))

    def find(x):
        while low[x] != x:
            x = low[x]
        return x

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and 100 * len(a & b) >= 85 * len(a | b):
                x, y = sorted((find(i), find(j)))
                low[y] = x
    return {i: (len(sets[i]), find(i)) for i in range(len(docs))}


def edited(rng, base, edits):
    words = base.split()
    for _ in range(edits):
        words[rng.randrange(len(words))] = f"e{rng.randrange(10**6)}"
    return " ".join(words)


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(11)
    text = lambda n: " ".join(f"w{rng.randrange(2000)}" for _ in range(n))
    base, other, short, passage = text(90), text(70), text(11), text(50)
    docs = [text(rng.randint(1, 90)) for _ in range(40)]
    docs += [edited(rng, base, rng.randint(0, 4)) for _ in range(90)]  # crowded, on both sides of the threshold
    docs += [edited(rng, other, 3) for _ in range(50)]  # a family of which most pairs are no links
    docs += [edited(rng, short, 1) for _ in range(12)] + [f"{passage} {text(12)}" for _ in range(45)]
    docs += [base.upper(), base.replace(" ", "\t\n"), base, base, None, "", " \t", "one two", "ONE\ntwo", "three words here", "\u00c4 b c d e"]
    return docs


def table(spark, docs):
    return spark.createDataFrame([(k, t) for k, t in enumerate(docs)], "doc_id long, text string")


def test_components_match_all_pairs(spark, corpus):
    want = linked_components(corpus)
    got = {r.doc_id: r for r in near_duplicates(table(spark, corpus)).collect()}
    assert {k: (r.n_shingles, r.component_id) for k, r in got.items()} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got.values())


def test_values_agree_as_often_as_sets_are_alike():
    rng = np.random.default_rng(3)
    scheme = MinMax(hashes=400)
    both, a, b = (mix(rng.integers(0, 1 << 63, n, dtype=np.uint64)) for n in (600, 100, 100))
    sets = [np.sort(np.concatenate([both, x])) for x in (a, b)]
    one, two = scheme.sign(sets)
    assert abs((one == two).mean() - 0.75) < 0.05
    least, greatest = (one == two)[:400].mean(), (one == two)[400:].mean()
    assert abs(least - 0.75) < 0.08 and abs(greatest - 0.75) < 0.08
    assert (scheme.short(np.array([one, two]))[0] == scheme.short(np.array([one, two]))[1]).mean() >= (one == two).mean()


def test_chance_to_miss_is_as_stated():
    scheme = MinMax()
    assert scheme.bands == 32 and (1 - 0.85**scheme.rows) ** scheme.bands < 7.3e-9
    assert scheme.least_agreeing(LIMIT) == 108


def test_edges(spark):
    rows = [(3, "a b c d"), (3, "a b c d"), (None, "A b\nc d"), (1, None), (2, ""), (5, "x " * 50_000 + "y z"), (None, "lone one")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("cls", F.lit("c")).withColumn("component_id", F.lit(0))
    got = sorted((tuple(r) for r in near_duplicates(docs).collect()), key=str)
    assert got == sorted(
        [(3, 2, 3, 3, True)] * 2 + [(None, 2, 3, 3, False), (1, 0, 1, 1, True), (2, 0, 1, 2, True), (5, 3, 1, 5, True), (None, 1, 1, None, True)], key=str
    )
    assert near_duplicates(docs.limit(0)).count() == 0


def test_query(spark, sf):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    ids = sorted(docs)
    want = linked_components([docs[i] for i in ids])
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in op11_minhash(spark, sf).collect()}
    assert got == {ids[k]: (n, ids[c]) for k, (n, c) in want.items()}
