"""Operator 13."""

import collections
import math
import random
import re

import pyarrow as pa
from pyspark.sql import functions as F

from quire.llm.lexical import OP13_SQL, op13_lexical, ranked_search, term_counts
from tests.llm import brute
from tests.oracle import connect, same

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall((text or "").translate(brute.LOWER))


def ranking(docs, items, k=20):
    """All scores, without any index: {(item_id, rank): (doc_id, score)}."""
    tfs = [collections.Counter(terms(t)) for _, t in docs]
    sizes = [sum(c.values()) for c in tfs]
    n_docs, total = sum(s > 0 for s in sizes), sum(sizes)
    df = collections.Counter(t for c in tfs for t in c)
    wanted = collections.defaultdict(collections.Counter)
    for item, text in items:
        if item is not None:
            wanted[item].update(terms(text))
    out = {}
    for item, query in wanted.items():
        scored = []
        for at, (doc, _) in enumerate(docs):
            score = 0
            for t, mult in query.items():
                if tf := tfs[at][t]:
                    w = math.floor(1000 * math.log((2.0 * n_docs + 2) / (2.0 * df[t] + 1)))
                    score += mult * w * (10**9 * tf // (1000 * tf + 12 * (75 + 25 * sizes[at] * n_docs // total)))
            if score > 0:
                scored.append((-score, doc is None, doc, -score))
        for rank, (_, _, doc, score) in enumerate(sorted(scored, key=lambda s: (s[0], s[1], s[2] or 0))[:k], 1):
            out[item, rank] = doc, -score
    return out


def got(df):
    return {(r.item_id, r["rank"]): (r.doc_id, r.score) for r in df.collect()}


def test_terms():
    texts = ["Abc-d3 Äéx　y_中文", None, "", "a a\x00A", "!?", "z" * 9]
    slices = list(term_counts(pa.array(texts)))
    assert [n.tolist() for _, n, _, _ in slices] == [[len(terms(t)) for t in texts]]
    _, _, owner, found = slices[0]
    assert len(set(found[owner == 3].tolist())) == 1 and len(set(found.tolist())) == len({t for x in texts for t in terms(x)})


def test_ranking_matches_scores_of_all_documents(spark):
    rng = random.Random(13)
    vocabulary = [f"v{k}" for k in range(400)]
    weights = [1 / (k + 1) for k in range(400)]
    text = lambda n: " ".join(rng.choices(vocabulary, weights, k=n))
    docs = [(k, text(rng.randint(0, 80))) for k in range(600)] + [(k, "v0 v1 rare") for k in range(600, 640)]
    items = [(k, text(rng.randint(1, 30))) for k in range(25)] + [(25, "rare"), (26, "v0"), (27, "absent words"), (28, "Rare RARE v399 v1"), (29, None), (30, "")]
    want = ranking(docs, items)
    d, i = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert got(ranked_search(d, i)) == want
    assert got(ranked_search(d, i, k=3)) == ranking(docs, items, 3)


def test_without_broadcasts(spark, monkeypatch):
    monkeypatch.setattr("quire.llm.lexical.BROADCAST_ROWS", 0)
    docs = [(k, f"a b{k % 7} c{k % 11} d") for k in range(200)]
    items = [(1, "a b1 c2"), (2, "b3 b3 c4 zz")]
    d, i = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert got(ranked_search(d, i)) == ranking(docs, items)


def test_edges(spark):
    docs = [(2, "same words"), (2, "same words"), (None, "same words"), (1, "same words"), (3, None), (4, ""), (5, "w " * 60_000 + "rare"), (6, "w")]
    docs += [(k, "filler text") for k in range(10, 40)]
    items = [(7, "same"), (7, "rare"), (None, "same"), (8, "w"), (9, None)]
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("term", F.lit("x")).withColumn("row", F.lit(1))
    i = spark.createDataFrame(items, "item_id long, text string").withColumn("item", F.lit(3))
    assert got(ranked_search(d, i)) == ranking(docs, items)
    assert ranked_search(d.limit(0), i).count() == 0 and ranked_search(d, i.limit(0)).count() == 0


def test_query(spark, sf):
    same(op13_lexical(spark, sf), OP13_SQL, connect(sf))
    rows = lambda t, c: [(r[0], r[1]) for r in spark.read.parquet(f"{sf}/{t}.parquet").select(c, "text").collect()]
    assert got(op13_lexical(spark, sf)) == ranking(rows("documents", "doc_id"), rows("benchmark", "item_id"))
