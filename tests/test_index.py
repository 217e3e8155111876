import os
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from quire.functions.text import index_terms, query_terms
from quire.operators import retrieval as R
from quire.operators.claims import replay_claims
from quire.operators.graphs import resolve_pointers
from quire.operators.reranking import BadReply, checked_scores, with_scores
from quire.operators.sketches import distinct_sketches, merged_counts
from quire.operators.text_index import BLOCK, TextIndex
from quire.operators.vector_index import VectorIndex
from quire.plans.search import SearchRequest, search
from quire.sources import writers
from quire.sources.manifests import Conflict, fingerprint, latest, publish
from quire.sources.tables import KeyedTable


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(3)
    words = [f"w{k}" for k in range(60)] + ["common"]
    rows = [(k, " ".join(rng.choices(words, [1 / (j + 1) for j in range(60)] + [4], k=rng.randint(1, 40)))) for k in range(1500)]
    rows += [(2000, "图像识别 and images"), (2001, "人人人"), (2002, None), (2003, "")]
    return spark.createDataFrame(rows, "id long, text string").withColumn("kind", F.col("id") % 3).cache()


@pytest.fixture(scope="module")
def index(corpus, tmp_path_factory):
    return TextIndex.build(corpus, str(tmp_path_factory.mktemp("index")), "id", ["text"], ["kind"], buckets=8, segment=400)


def by_id(df):
    return {r.doc_id: r.score for r in df.collect()}


@pytest.mark.parametrize("query", ["common w3", "w40", "W1 w1, w2!", "absent w5", "图像识别", "像识 common", "人人"])
def test_index_scores_are_those_of_the_scan(index, corpus, query):
    assert by_id(index.scores(query)) == pytest.approx(by_id(R.bm25(corpus, query, "id")))
    want = sorted(by_id(R.bm25(corpus, query, "id")).items(), key=lambda x: (-round(x[1], 9), x[0]))[:10]
    got = index.top(query, 10).orderBy("rank").collect()
    assert [r.rank for r in got] == list(range(1, len(want) + 1))
    assert [r.score for r in got] == pytest.approx([s for _, s in want])


def test_filtered_scores_use_the_filtered_statistics(index, corpus):
    allowed = index.documents().where("kind = 1")
    assert by_id(index.scores("common w3", allowed=allowed)) == pytest.approx(by_id(R.bm25(corpus.where("kind = 1"), "common w3", "id")))


def test_queries_read_their_buckets_only(index):
    plan = index.scores("w3")._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^]]*bucket", plan) and "documents" not in plan
    one = index.blocks(["w3"]).select(F.input_file_name().alias("f")).distinct().collect()
    assert len({os.path.dirname(r.f) for r in one}) == 1


def test_blocks_that_cannot_reach_the_best_are_skipped(index):
    blocks = index.blocks(["common", "w40"])
    kept, idf = index._reachable(["common", "w40"], 5, {"text": 1.0})
    assert kept.count() < blocks.count() and set(idf) == {(0, "common"), (0, "w40")}
    assert blocks.agg(F.max("n")).first()[0] <= BLOCK
    tight = blocks.select("best", F.explode("postings").alias("p"), (F.lit(index.docs) / F.lit(index.terms["text"])).alias("s"))
    impact = F.expr("p.tf * 2.2 / (p.tf + 1.2 * (0.25 + 0.75 * p.length * s))")
    assert tight.where(impact > F.col("best") + 1e-9).count() == 0


def test_index_edges(spark, corpus, tmp_path):
    empty = TextIndex.build(corpus.limit(0), str(tmp_path / "e"), "id", ["text"])
    assert empty.scores("w1").count() == 0 and empty.top("w1", 3).count() == 0
    assert TextIndex.open(spark, str(tmp_path / "e")).docs == 0
    with pytest.raises(ValueError):
        TextIndex.open(spark, str(tmp_path / "none"))


def test_terms_of_queries_and_texts_agree(spark):
    texts = ["Deep 学习模型 v2 中", "naïve Ünit_x 3.5", "日本語テキスト", "", "a b a", "漢"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", index_terms(F.col("t")).alias("w")).collect()
    assert all(sorted(set(r.w)) == query_terms(r.t) for r in rows)


def test_search_through_an_index(spark, tmp_path):
    rows = [
        (f"c{k}", f"p{k % 4}", "deep nets" if k % 4 == 0 else "图像 other", f"{'deep learning 图像识别' if k < 6 else 'cooking'} text number {k}", "References" if k == 0 else "1 Intro", [float(k), 1.0], 2018 + k % 3)
        for k in range(12)
    ]
    chunks = spark.createDataFrame(rows, "chunk_id string, paper_id string, title string, text string, section string, embedding array<float>, year int")
    chunks = chunks.withColumns({"section_title": F.lit(None).cast("string"), "page_start": F.lit(1)})
    index = TextIndex.build(chunks.drop("embedding"), str(tmp_path / "i"), "chunk_id", ["title", "text"], ["section", "year"])
    for query in ("deep learning", "像识"):
        for mode in ("keyword", "hybrid"):
            request = SearchRequest(query, mode=mode, top_k=3, filters={"year_from": 2019})
            plain, through = (search(chunks, request, [1.0, 1.0], index=i).drop("evidence").orderBy("rank").collect() for i in (None, index))
            assert plain and [tuple(r) for r in plain] == [tuple(r) for r in through]


# ---- manifests and keyed tables


def test_a_second_writer_of_a_version_is_refused(spark, tmp_path):
    root = str(tmp_path)
    assert latest(spark, root) is None
    publish(spark, root, 1, {"a": 1})
    with pytest.raises(Conflict):
        publish(spark, root, 1, {"a": 2})
    (tmp_path / "manifest-00000002.json").write_text('{"a": ')  # not complete
    assert latest(spark, root) == (1, {"a": 1})
    with pytest.raises(Conflict):
        publish(spark, root, 2, {"a": 2})
    os.utime(tmp_path / "manifest-00000002.json", (1, 1))  # its writer is gone
    publish(spark, root, 2, {"a": 2})
    assert latest(spark, root) == (2, {"a": 2})
    before = fingerprint(spark, root)
    (tmp_path / "x").write_text("x")
    assert fingerprint(spark, root) != before


def files(root):
    return {os.path.join(at, f) for at, _, names in os.walk(f"{root}/data") for f in names if f.endswith(".parquet")}


def test_changes_rewrite_their_buckets_only(spark, tmp_path):
    root = str(tmp_path / "t")
    table = KeyedTable.create(spark.range(1000).select(F.col("id").alias("k"), F.lit("a").alias("v")), root, "k", 32)
    before = files(root)
    changed = table.update(spark.createDataFrame([(5, "b"), (7, "b"), (5000, "b")], "k long, v string"), ["v"])
    new = {re.search(r"_bucket=(\d+)", f)[1] for f in files(root) - before}
    assert before <= files(root) and 1 <= len(new) <= 3
    assert changed.read().where("v = 'b'").count() == 2 and changed.read().count() == 1000
    assert table.read().where("v = 'b'").count() == 0  # the version before is as it was
    changed = changed.upsert(spark.createDataFrame([("c", 5), ("c", 2000)], "v string, k long")).delete(spark.createDataFrame([(7,), (8,), (9999,)], "k long"))
    again = KeyedTable.open(spark.newSession(), root)
    assert again.version == 4 and again.read().count() == 999 and {(r.k, r.v) for r in again.lookup([5, 7, 2000, 3]).collect()} == {(5, "c"), (2000, "c"), (3, "a")}
    with pytest.raises(Conflict):
        table.delete(spark.range(1).select(F.col("id").alias("k")))
    with pytest.raises(ValueError):
        changed.upsert(spark.createDataFrame([(1, "x"), (1, "y")], "k long, v string"))
    with pytest.raises(ValueError):
        KeyedTable.create(spark.createDataFrame([(1,), (1,)], "k int"), str(tmp_path / "bad"), "k")
    gone = again.delete(again.read())
    assert gone.read().count() == 0 and gone.lookup([1]).count() == 0


def test_lookup_prunes_buckets(spark, tmp_path):
    table = KeyedTable.create(spark.range(1000).select(F.col("id").alias("k")), str(tmp_path / "t"), "k", 32)
    assert len(table.lookup([1, 2]).select(F.input_file_name()).distinct().collect()) <= 2
    assert table.lookup([]).count() == 0


def test_alias_outlives_the_session(spark, tmp_path):
    writers.write_version(spark.range(5), str(tmp_path), "v1")
    writers.write_version(spark.range(6), str(tmp_path), "v2")
    writers.swap(spark, "numbers_now", str(tmp_path), "v1")
    writers.swap(spark, "numbers_now", str(tmp_path), "v2")
    assert writers.current(spark.newSession(), str(tmp_path)).count() == 6


# ---- vectors


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(12, 8)) * 4
    x = (centres[rng.integers(0, 12, 900)] + rng.normal(size=(900, 8))).astype(np.float32).astype(np.float64)
    x[700:] = x[699]  # many equal vectors
    return x


def nearest(x, q, k, rows):
    d = ((x[rows][None] - q[:, None]) ** 2).sum(2)
    return [[int(rows[j]) for j in np.lexsort((rows, np.round(line, 12)))[:k]] for line in d]


def test_vector_search_is_that_of_all_pairs(spark, vectors, tmp_path):
    df = spark.createDataFrame([(k, v.tolist(), k % 2) for k, v in enumerate(vectors)] + [(5000, [1.0], 0), (5001, [float("nan")] * 8, 0), (5002, None, 0)], "id long, v array<double>, label int")
    index = VectorIndex.build(df, str(tmp_path / "v"), "id", "v", ["label"], cells=16, turns=3)
    asked = list(range(0, 900, 30))
    queries = df.where(F.col("id").isin(asked) | (F.col("id") == 5000))
    for where, rows in ((None, np.arange(900)), (F.col("label") == 1, np.arange(1, 900, 2))):
        got = {}
        for r in index.search(queries, 7, "id", "v", where).orderBy("query_id", "rank").collect():
            got.setdefault(r.query_id, []).append(r.id)
            assert r.score == pytest.approx(1 / (1 + ((vectors[r.id] - vectors[r.query_id]) ** 2).sum()))
        assert got == dict(zip(asked, nearest(vectors, vectors[asked], 7, rows)))
    near = index.search(queries, 7, "id", "v", probes=4, exact=False)
    want = nearest(vectors, vectors[asked], 7, np.arange(900))
    hits = sum(r.id in want[asked.index(r.query_id)] for r in near.collect())
    assert hits >= 0.9 * 7 * len(asked)
    assert index.search(queries.limit(0), 7, "id", "v").count() == 0
    assert VectorIndex.open(spark, str(tmp_path / "v")).counts.sum() == 900


def test_vector_search_in_blocks(spark, vectors, tmp_path, monkeypatch):
    monkeypatch.setattr("quire.operators.vector_index.QUERY_BYTES", 8 * 8 * 10)
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(vectors[:300])], "id long, v array<double>")
    index = VectorIndex.build(df, str(tmp_path / "v"), "id", "v", cells=5, turns=1)
    got = {}
    for r in index.search(df.where("id < 30"), 3, "id", "v").orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.id)
    assert got == dict(enumerate(nearest(vectors[:300], vectors[:30], 3, np.arange(300))))


# ---- pointers


def test_pointers(spark):
    chain = [(k, k + 1) for k in range(100)]
    rows = chain + [(200, 201), (201, 202), (202, 200), (203, 201), (300, 300), (400, None), (None, 1)]
    got = {r.source: (r.target, r.cyclic) for r in resolve_pointers(spark.createDataFrame(rows, "source long, target long")).collect()}
    assert got == {k: (100, False) for k in range(100)} | {200: (201, True), 201: (202, True), 202: (200, True), 203: (201, True), 300: (300, True)}
    assert resolve_pointers(spark.createDataFrame([], "source long, target long")).count() == 0



# ---- reranking


def test_replies_are_checked():
    assert checked_scores([(1, 0.5), {"index": 0, "score": 2}], 2) == [2.0, 0.5]
    for bad in ([(0, 1.0)], [(0, 1.0), (0, 1.0)], [("0", 1.0), (1, 1.0)], [(0, 1.0), (2, 1.0)], [(0, "x"), (1, 1.0)], [(0, float("nan")), (1, 1.0)], [(True, 1.0), (0, 1.0)], None, [{"index": 0}, (1, 1.0)], [0, 1]):
        with pytest.raises(BadReply):
            checked_scores(bad, 2)


class Reversed:
    """The later a passage, the better."""

    def __call__(self, query, passages):
        return [(k, float(int(p))) for k, p in enumerate(passages)]


class Broken:
    def __call__(self, query, passages):
        raise OSError("no answer")


class Malformed:
    def __call__(self, query, passages):
        return [(k + 1, 1.0) for k in range(len(passages))]


class FailsLate:
    def __call__(self, query, passages):
        if "20" in passages:
            raise RuntimeError
        return [(k, 1.0) for k in range(len(passages))]


def test_reranking_by_a_service(spark):
    hits = spark.createDataFrame([(f"c{k}", f"p{k % 12}", k, str(k), 1.0 / (k + 1)) for k in range(84)], "chunk_id string, paper_id string, position int, text string, score double")
    scored = {r.chunk_id: r.service_score for r in with_scores(hits, "q", Reversed).collect()}
    assert scored == {f"c{k}": float(k) if k < 60 else None for k in range(84)}  # five of each paper
    order = [r.paper_id for r in R.rerank(with_scores(hits, "q", Reversed), F.col("service_score"), 3).where("is_primary").orderBy("new_position").collect()]
    assert order == ["p11", "p10", "p9"]
    for service in (Broken, Malformed, FailsLate):
        fallen = R.rerank(with_scores(hits, "q", service), F.col("service_score"), 3).where("is_primary").orderBy("new_position").collect()
        assert [r.paper_id for r in fallen] == ["p0", "p1", "p2"] and all(r.rerank_score is None and r.score == r.retrieval_score for r in fallen)


# ---- sketches and claims


def test_distinct_counts_merge(spark):
    rows = spark.createDataFrame([("a", d, v) for d in range(4) for v in range(d * 50, d * 50 + 100)] + [("b", 0, None), (None, 1, 7), (None, 2, 7)], "f string, d int, v long")
    kept = distinct_sketches(rows, ["f", "d"], "v", exact=300)
    assert {(r.f, r.n, r.is_exact) for r in merged_counts(kept, ["f"], 300).collect()} == {("a", 250, True), (None, 1, True)}
    rough = merged_counts(distinct_sketches(rows, ["f", "d"], "v", exact=99), ["f"], 99).where("f = 'a'").first()
    assert not rough.is_exact and abs(rough.n - 250) <= 0.05 * 250
    big = distinct_sketches(spark.range(40_000).select((F.col("id") % 7).alias("k"), (F.col("id") % 20_011).alias("v")), ["k"], "v", exact=3000)
    assert big.where("members is not null").count() > 0 or big.count() == 7
    total = merged_counts(big.withColumn("all", F.lit(1)), ["all"]).first()
    assert not total.is_exact and abs(total.n - 20_011) <= 0.06 * 20_011


def replay(spark, claims, **more):
    columns = "id long, paper_id string, field string, seq long, source_type string, value string, names array<string>, decided boolean, dismissed boolean, byline array<string>, body string, complete boolean"
    rows = [(k, "p", c["field"], k, c["source"], c.get("value"), c.get("names"), c.get("decided", False), c.get("dismissed", False), c.get("byline"), c.get("body"), c.get("complete")) for k, c in enumerate(claims)]
    out = {r.id: r for r in replay_claims(spark.createDataFrame(rows, columns)).collect()}
    return [out[k].outcome for k in range(len(claims))], [k for k in out if out[k].is_current]


def test_claims_in_order(spark):
    t = lambda source, value, **more: {"field": "title", "source": source, "value": value, **more}
    assert replay(spark, [t("filename", "x1"), t("pdf_embedded", "Real title"), t("crossref", "Real <i>title</i>"), t("ieee_api", "Other"), t("manual", "Mine"), t("ieee_api", "Other"), t("manual", "")]) == (
        ["filled", "overridden", "unchanged", "overridden", "overridden", "archived", "unchanged"],
        [4],
    )
    # A cleaner form of the same title comes in from a source of as much authority, but not over a human's choice.
    assert replay(spark, [t("crossref", "A <b>b</b>"), t("pdf_embedded", "A b"), t("ieee_api", "A b")]) == (["filled", "unchanged", "overridden"], [2])
    assert replay(spark, [t("crossref", "A <b>b</b>", decided=True), t("ieee_api", "A b")])[0] == ["filled", "unchanged"]
    # What a human has turned down does not come back.
    assert replay(spark, [t("pdf_embedded", "One"), t("pdf_heuristic", "Two", dismissed=True), t("crossref", "Two"), t("crossref", "Three")])[0] == ["filled", "archived", "archived", "overridden"]
    a = lambda source, value, **more: {"field": "abstract", "source": source, "value": value, **more}
    assert replay(spark, [a("pdf_embedded", "https://a.b"), a("pdf_embedded", "We show x."), a("pdf_heuristic", "We show y."), a("pdf_heuristic", "We show z.", body="Abstract We show z. So it is.")])[0] == ["archived", "filled", "archived", "overridden"]
    assert replay(spark, [a("crossref", "We show..."), a("ieee_api", "We show it all."), a("pdf_embedded", "We tell.")])[0] == ["filled", "overridden", "archived"]


def test_bylines_of_pages(spark):
    n = lambda source, names, **more: {"field": "authors", "source": source, "names": names, "value": "; ".join(names), **more}
    whole = {"byline": ["Ann Lee", "Bo Roe"], "complete": True}
    assert replay(spark, [n("pdf_embedded", ["Ann Lea"]), n("pdf_heuristic", ["Ann Lee", "Bo Roe"], **whole)])[0] == ["filled", "overridden"]
    assert replay(spark, [n("pdf_embedded", ["Ann Lea"]), n("pdf_heuristic", ["Ann Lee", "Bo Roe"], byline=["Ann Lee", "Bo Roe"], complete=False)])[0] == ["filled", "archived"]
    assert replay(spark, [n("pdf_embedded", ["A. Lee", "Bo Roe"]), n("pdf_heuristic", ["Ann Lee", "Bo Roe"], **whole)])[0] == ["filled", "archived"]  # an abbreviation
    assert replay(spark, [n("pdf_embedded", ["Ann Lee", "Bo Roe", "Cy De"]), n("pdf_heuristic", ["Ann Lee", "Bo Roe"], **whole)])[0] == ["filled", "archived"]  # may be cut
    assert replay(spark, [n("pdf_embedded", ["user1"]), n("pdf_embedded", ["Ann Lee"])])[0] == ["archived", "filled"]


# ---- builds at one time, and equal scores


def test_a_build_that_was_overtaken_takes_the_other_one(spark, corpus, tmp_path, monkeypatch):
    root, build = str(tmp_path / "i"), TextIndex.build.__func__

    def overtaken(cls, docs, root, *args, **how):
        build(cls, corpus.where("id < 1000"), root, "id", ["text"])  # another session is faster
        return build(cls, docs, root, *args, **how)

    monkeypatch.setattr(TextIndex, "build", classmethod(overtaken))
    index = TextIndex.open_or_build(spark, root, corpus, "id", ["text"])
    assert index.docs == 1000 and by_id(index.scores("common w3")) == pytest.approx(by_id(R.bm25(corpus.where("id < 1000"), "common w3", "id")))
    assert index.documents().count() == 1000


def test_equal_documents_have_equal_scores(spark, tmp_path):
    rows = spark.range(3000).select("id", F.expr("concat(if(id % 2 = 0, 'a b c d e f g h', 'h g f e d c b a'), if(id % 3 = 0, ' x a a c', ' y'))").alias("text"))
    index = TextIndex.build(rows.repartition(7), str(tmp_path / "i"), "id", ["text"], segment=300)
    for scored in (index.scores("a b c d e f g h"), index.top("a b c d e f g h", 3000)):
        assert scored.select("score").distinct().count() == 2
    assert [r.doc_id for r in index.top("a b c d e f g h", 20).orderBy("rank").collect()] in ([3 * k for k in range(20)], [k for k in range(40) if k % 3][:20])


def test_distinct_counts_without_a_limit_are_exact(spark):
    rows = spark.range(60_000).select((F.col("id") % 7).alias("k"), (F.col("id") % 20_011).alias("v"))
    kept = distinct_sketches(rows, ["k"], "v", exact=None)
    assert kept.select(F.max(F.size("members"))).first()[0] < 1000
    total = merged_counts(kept.withColumn("all", F.lit(1)), ["all"], exact=None).first()
    assert total.is_exact and total.n == 20_011


def test_many_claims_of_one_field(spark):
    # 60,000 claims of one field: the log of all before was copied at each, so this took more than a minute.
    import time

    rows = spark.range(60_000).selectExpr("id", "'p' AS paper_id", "'title' AS field", "id AS seq", "'crossref' AS source_type", "concat('Title ', id % 3) AS value", "id = 1 AS decided")
    rows = rows.unionByName(spark.range(2).selectExpr("60000 + id AS id", "'q' AS paper_id", "'venue' AS field", "id AS seq", "'crossref' AS source_type", "'A' AS value", "false AS decided"))
    start = time.time()
    out = {r.id: (r.paper_id, r.outcome, r.is_current) for r in replay_claims(rows).collect()}
    assert time.time() - start < 60
    assert len(out) == 60_002 and out[0] == ("p", "filled", True) and out[1] == ("p", "conflict", False) and out[4] == ("p", "archived", False) and out[59_999] == ("p", "conflict", False)
    assert out[60_000] == ("q", "filled", True) and out[60_001] == ("q", "unchanged", False)


def test_build_exchanges_postings_once(spark, tmp_path):
    # They went by document first and then by bucket; a bucket's part was one task's, however large.
    from quire.operators import text_index as I

    docs = spark.range(300).selectExpr("id", "concat('a b a c', id % 7, ' ', repeat('d ', cast(id % 5 as int))) AS text").unionByName(spark.createDataFrame([(300, ""), (301, None)], "id long, text string"))
    counts = spark.createDataFrame([(["b", "a", "b"],), ([],), (None,)], "w array<string>").select(I._counts(F.col("w")).alias("c"))
    assert [r.c and [tuple(x) for x in r.c] for r in counts.collect()] == [[("a", 1), ("b", 2)], None, None]
    whole = I.TextIndex.build(docs, str(tmp_path / "one"), "id", ["text"])
    before, I.SLICE = I.SLICE, 10
    try:
        cut = I.TextIndex.build(docs, str(tmp_path / "many"), "id", ["text"])
    finally:
        I.SLICE = before
    parts = lambda index: index.spark.read.parquet(f"{index.root}/postings").select("bucket", "segment").distinct().count()
    assert parts(cut) > parts(whole)
    for query in ("a d", "c3 d zz"):
        found = [sorted(map(tuple, index.scores(query).collect())) for index in (whole, cut)]
        assert found[0] == found[1] and len(found[0]) > 0
        assert whole.top(query, 5).collect() == cut.top(query, 5).collect()
