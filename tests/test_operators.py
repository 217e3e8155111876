import datetime

import pytest
from pyspark.sql import functions as F

from quire.operators import catalog as C
from quire.operators import documents as D
from quire.operators import evaluation as E
from quire.operators import maintenance as M
from quire.operators import metadata as B
from quire.operators import records as K
from quire.operators import retrieval as R
from quire.plans.search import SearchRequest, needs_rewrite, rewrite, search, search_chunks, search_outcome
from quire.schemas import SchemaMismatch, strict
from quire.sources import readers, writers
from quire.streaming.outbox import latest_revisions, stream_outbox, windowed_counts


def legs(spark, *lists):
    rows = [(f"l{k}", x, p) for k, ids in enumerate(lists) for p, x in enumerate(ids)]
    return spark.createDataFrame(rows, "leg string, doc_id string, position int")


def test_rrf_rules(spark):
    weights = {"l0": 1.0, "l1": 1.0}
    score = lambda *x, k=60, w=weights: {r.doc_id: r.score for r in R.rrf(legs(spark, *x), w, k).collect()}
    assert score(["a", "b"]) == pytest.approx({"a": 1 / 61, "b": 1 / 62})
    assert score(["a", "a", "b"]) == pytest.approx({"a": 1 / 61, "b": 1 / 63})
    assert score(["a"], k=1) == pytest.approx({"a": 0.5})
    got = score(["a", "b", "c"], ["c", "d", "a"])
    assert min(got["a"], got["c"]) > max(got["b"], got["d"])
    assert score(["a"], ["b"], w={"l0": 1.0, "l1": 0.0})["b"] == 0.0
    assert score([], []) == {}
    with pytest.raises(ValueError):
        R.rrf(legs(spark, ["a"]), {"l0": -1.0})


@pytest.mark.parametrize(("score", "want"), [(1.0, "high"), (0.9, "high"), (0.899, "medium"), (0.6, "medium"), (0.599, "low"), (0.0, "low")])
def test_relevance(spark, score, want):
    assert spark.range(1).select(R.relevance(F.lit(score)).alias("x")).first().x == want


def test_metrics(spark):
    def ndcg(ranking, grades, k=2):
        r = spark.createDataFrame([("q", p, n + 1) for n, p in enumerate(ranking)], "query_id string, paper_id string, rank int")
        g = spark.createDataFrame([("q", p, x) for p, x in grades.items()], "query_id string, paper_id string, grade int")
        return E.metrics(r, g, k).first()

    assert ndcg(["a", "b"], {"a": 2, "b": 1}).ndcg == pytest.approx(1.0)
    assert ndcg(["x", "a"], {"a": 2}).ndcg == pytest.approx(0.6309297535714574)
    assert ndcg(["b", "a"], {"a": 2, "b": 1}).ndcg == pytest.approx(0.7967075809905066)
    assert ndcg(["x", "y", "a"], {"a": 1}).mrr == pytest.approx(1 / 3)
    assert ndcg(["x"], {}).recall == 0.0
    with pytest.raises(ValueError):
        E.metrics(None, None, True)


def test_bootstrap(spark):
    same = spark.createDataFrame([(f"q{k}", 0.25) for k in range(5)], "query_id string, delta double")
    row = E.verdict(E.paired_bootstrap(same, 200)).first()
    assert (row.n, row.mean, row.low, row.high, row.verdict) == (5, 0.25, 0.25, 0.25, "win")
    mixed = spark.createDataFrame([(f"q{k}", (-1.0) ** k) for k in range(20)], "query_id string, delta double")
    row = E.verdict(E.paired_bootstrap(mixed, 500)).first()
    assert row.low < 0 < row.high and row.verdict == "indistinguishable"


def test_sections():
    pages = [(1, "My Paper\n1 Introduction\nSome text here.\n\nMore text.\nA. Smith wrote."), (2, "RESULTS\nIt is good-\nness.\n1.5 2.5 3.5\nReferences\n[1] x")]
    got = D.sections_of(pages)
    assert [(s["number"], s["title"]) for s in got] == [(None, "Body"), ("1", "Introduction"), (None, "Results"), (None, "References")]
    assert got[1]["paragraphs"] == [(1, "Some text here."), (1, "More text. A. Smith wrote.")]
    assert got[2]["paragraphs"][0][1].startswith("It is goodness.")
    assert D.sections_of([]) == []


@pytest.mark.parametrize(
    ("line", "want"),
    [
        ("2.1 Architecture", ("2.1", "Architecture")), ("IV. RESULTS", ("IV", "RESULTS")), ("II-A. Setup", ("II-A", "Setup")), ("i think so", None), ("I think this is a very long line of plain prose", None),
        ("3) Method:", ("3", "Method:")), ("1 2.5 3.5 4.5", None), ("1 Introduction.", None), ("Results and discussion:", (None, "Results and Discussion")), ("LONG TITLE", (None, "LONG TITLE")), ("A", None), ("A B.", None), ("• abstract", (None, "Abstract")),
    ],
)
def test_headings(line, want):
    assert D.heading(line) == want


def test_chunks():
    with pytest.raises(ValueError):
        D.check_limits(100, 100, 120)
    paragraphs = [(1, "Sentence number one. " * 30), (2, "Another one here. " * 60), (3, "short")]
    chunks = D.chunk_section(paragraphs, 100, 12, 120)
    assert all(len(c["text"]) <= 480 for c in chunks)
    assert chunks[0]["page_start"] == 1 and chunks[-1]["page_end"] == 3
    tail = D.overlap_tail(chunks[0]["text"], 48)
    assert tail and chunks[1]["text"].startswith(tail)
    assert D.windows("x" * 25, 10) == ["x" * 10, "x" * 10, "x" * 5]
    assert D.dips([0.9, 0.1, 0.9, 0.5, 0.9]) == {1, 3}
    assert D.dips([0.9, 0.85]) == set()


def test_semantic_chunks(spark):
    def embed(texts):
        return [[1.0, 0.0] if "alpha" in t else [0.0, 1.0] for t in texts]

    text = " ".join(["This sentence is about alpha things."] * 4 + ["That other one is about beta things."] * 4)
    docs = spark.createDataFrame([(1, 1, text)], "doc_id long, page int, text string")
    got = [r.text for r in D.chunk_documents(docs, 100, 0, 120, embed, min_tokens=20).orderBy("chunk_index").collect()]
    assert len(got) == 2 and "beta" not in got[0] and "alpha" not in got[1]


def test_abstracts(spark):
    texts = {
        1: ["Abstract - We present a converter in\n65 nm CMOS. It reduces power.\nI.\nINTRODUCTION\nBody"], 2: ["Abstract - A converter.\n1 introduction\nBody"], 3: ["ABSTRACT\n\nFirst\nsecond.\n\nThird"],
        4: ["Abstract: on two", "pages here.\nIndex Terms - x"], 5: ["No mark"], 6: ["Abstract"], 7: ["Abstract A.\n16 comparators work.\n2 Method"],
    }
    pages = spark.createDataFrame([(k, n + 1, t) for k, ts in texts.items() for n, t in enumerate(ts)], "doc_id long, page int, text string")
    got = {r.doc_id: r.abstract for r in D.abstracts(pages).collect()}
    assert got == {1: "We present a converter in 65 nm CMOS. It reduces power.", 2: "A converter.", 3: "First second.", 4: "on two pages here.", 7: "A. 16 comparators work."}


def test_running_lines(spark):
    pages = [(1, p, f"Journal of X\nbody {p} text\nJournal of X inside\nmore\nlast words {p}\n{p}") for p in range(1, 5)] + [(2, 1, "Journal of X\nonly page")]
    got = {(r.doc_id, r.page): r.text for r in D.strip_running_lines(spark.createDataFrame(pages, "doc_id long, page int, text string")).collect()}
    assert got[1, 2] == "body 2 text\nJournal of X inside\nmore\nlast words 2"
    assert got[2, 1] == "Journal of X\nonly page"


def test_merge_and_title_rules(spark):
    columns = "field string, current string, incoming string, current_source string, incoming_source string, human_decision boolean, rejected_before boolean, same_identifier boolean"
    rows = [
        ("title", "a", "b", "filename", "ieee_api", False, False, False, "overridden"),
        ("title", "a", "b", "ieee_api", "crossref", False, False, False, "conflict"),
        ("title", "a", "b", "pdf_embedded", "pdf_heuristic", False, False, False, "archived"),
        ("venue", None, "b", None, "filename", False, False, False, "filled"),
        ("venue", "a", " ", "filename", "manual", False, False, False, "unchanged"),
        ("venue", "a", "b", "ieee_api", "manual", True, False, False, "overridden"),
        ("venue", "a", "b", "filename", "ieee_api", True, False, False, "archived"),
        ("abstract", "We show...", "We show all.", "ieee_api", "crossref", False, False, False, "overridden"),
        ("doi", "a", "b", "ieee_api", "crossref", False, False, True, "unchanged"),
    ]
    got = B.merge_decision(spark.createDataFrame([r[:-1] for r in rows], columns)).collect()
    want = {(r[0], r[1], r[2], r[3]): r[-1] for r in rows}
    assert {(r.field, r.current, r.incoming, r.current_source): r.outcome for r in got} == want


def test_ledger(spark):
    schema = "id string, paper_id string, source_id string, field string, value string, is_current boolean, decided_by string, decided_at timestamp"
    t = datetime.datetime(2024, 1, 1)
    ledger = spark.createDataFrame([("1", "p", "s1", "title", "A", True, "auto", t), ("2", "p", "s2", "title", "B", False, "auto", t)], schema)
    claims = spark.createDataFrame([("p", "s3", "title", "A"), ("p", "s2", "title", "B"), ("p", "s3", "title", "C")], "paper_id string, source_id string, field string, value string")
    assert [r.value for r in B.record_claims(ledger, claims).collect()] == ["C"]
    now = B.promote(ledger, ledger.where("id = '2'"), "me", F.lit(t)).orderBy("id").collect()
    assert [(r.id, r.is_current, r.decided_by) for r in now] == [("1", False, "auto"), ("2", True, "me")]


def test_outbox_settles(spark):
    box = spark.createDataFrame([("a", 1, 0, None), ("b", 2, 0, None)], "paper_id string, revision long, attempts int, enqueued_at timestamp")
    sent = spark.createDataFrame([("a", 1), ("b", 1)], "paper_id string, revision long")
    assert [r.paper_id for r in M.settle(box, sent, True).collect()] == ["b"]
    assert {r.paper_id: r.attempts for r in M.settle(box, sent, False).collect()} == {"a": 1, "b": 1}
    more = M.enqueue(box, spark.createDataFrame([("b", datetime.datetime(2024, 1, 1)), ("c", datetime.datetime(2024, 1, 2))], "paper_id string, enqueued_at timestamp"))
    assert {r.paper_id: r.revision for r in more.collect()} == {"a": 1, "b": 3, "c": 1}


def test_requests():
    assert SearchRequest(" q ", top_k=5, rerank=True).leg_size() == 25
    assert SearchRequest("q", top_k=5, rerank=True, backend="python").leg_size() == 125
    assert SearchRequest("q", mode="semantic", top_k=5).leg_size() == 15
    for bad in ({"query": " "}, {"mode": "x"}, {"top_k": 0}, {"offset": 1}, {"recall_k": 5, "top_k": 6}, {"recall_k": 10, "offset": 10}, {"recall_k": 10, "backend": "python"}):
        with pytest.raises(ValueError):
            SearchRequest(**({"query": "q"} | bad))
    assert needs_rewrite("深度学习") and not needs_rewrite("deep learning") and not needs_rewrite("深" * 301)


@pytest.mark.parametrize(("mode", "rerank"), [("keyword", False), ("semantic", False), ("hybrid", False), ("hybrid", True)])
def test_search(spark, mode, rerank):
    rows = [
        (f"c{k}", f"p{k % 4}", "deep nets" if k % 4 == 0 else "other", f"{'deep learning' if k < 6 else 'cooking'} text number {k}", "References" if k == 0 else "1 Intro", [float(k), 1.0])
        for k in range(12)
    ]
    chunks = spark.createDataFrame(rows, "chunk_id string, paper_id string, title string, text string, section string, embedding array<float>")
    chunks = chunks.withColumns({"section_title": F.lit(None).cast("string"), "page_start": F.lit(1), "year": F.lit(2020)})
    got = search(chunks, SearchRequest("deep learning", mode=mode, top_k=3, rerank=rerank, filters={"year_from": 2019}), [1.0, 1.0]).orderBy("rank").collect()
    assert 0 < len(got) <= 3 and [r["rank"] for r in got] == list(range(1, len(got) + 1))
    assert got[0].score == 1.0 and all(e.chunk_id != "c0" for r in got for e in r.evidence)


def test_search_pages_facets_and_total(spark):
    rows = [(f"c{k}", f"p{k % 6}", "nets", f"deep learning {'deep ' * (k % 4)}number {k}", "References" if k == 1 else None, [float(k), 1.0], 2017.0 + k % 2, "jov") for k in range(18)]
    chunks = spark.createDataFrame(rows, "chunk_id string, paper_id string, title string, text string, section string, embedding array<float>, year double, venue string")
    chunks = chunks.withColumns({"section_title": F.lit(None).cast("string"), "page_start": F.lit(1)})
    whole = [r.paper_id for r in search(chunks, SearchRequest("deep", top_k=6, recall_k=6), [1.0, 1.0]).orderBy("rank").collect()]
    pages = [[r.paper_id for r in search(chunks, SearchRequest("deep", top_k=2, recall_k=6, offset=at), [1.0, 1.0]).orderBy("rank").collect()] for at in (0, 2, 4)]
    assert sum(pages, []) == whole and len(set(whole)) == 6
    out = search_outcome(chunks, SearchRequest("deep", filters={"venue": "JOV!", "year_to": 2017}), [1.0, 1.0])
    assert out.total.first().total == 3
    assert {(r.facet, r.key, r.papers) for r in out.facets.collect()} == {("venue", "jov", 3), ("year", "2017", 3)}
    hits = search_chunks(chunks, SearchRequest("deep", top_k=3), [1.0, 1.0]).collect()
    assert len({r.paper_id for r in hits}) == 3 and sum(r.is_primary for r in hits) == 3
    for p in {r.paper_id for r in hits}:
        own = [r for r in hits if r.paper_id == p]
        assert 1 <= len(own) <= 4 and len({r.score for r in own}) == 1


def test_rerank_by_paper_keeps_what_the_pool_leaves_out(spark):
    rows = [(f"c{p}{k}", f"p{p:02}", p * 7 + k, 1.0 - p / 100, k == 0, 1.0 if (p, k) == (3, 2) else 0.5 if k == 0 else 0.1) for p in range(25) for k in range(7)]
    hits = spark.createDataFrame(rows, "chunk_id string, paper_id string, position int, score double, is_primary boolean, raw double")
    out = R.rerank(hits, F.col("raw"), 24).orderBy("new_position").collect()
    order = list(dict.fromkeys(r.paper_id for r in out))
    assert order[:3] == ["p03", "p00", "p01"] and len(order) == 24 and len(out) == 24 * 7
    best = [r for r in out if r.paper_id == "p03"]
    assert best[0].chunk_id == "c32" and best[0].is_primary and {r.score for r in best} == {1.0} and {r.rerank_score for r in best} == {1.0}
    late = [r for r in out if r.paper_id == "p22"]  # beyond the first hundred chunks
    assert {r.rerank_score for r in late} == {None} and {r.score for r in late} == {0.78}


def test_rewrites():
    assert rewrite("深度学习", lambda q: '\n "deep learning" \n x') == ("deep learning", True)
    assert rewrite("deep", lambda q: "x") == ("deep", False) and rewrite("深度", None) == ("深度", False)

    def broken(query):
        raise TimeoutError

    assert rewrite("深度", broken) == ("深度", False) and rewrite("深度", lambda q: " ") == ("深度", False)


def test_running_counts_over_many_ranges(spark):
    import random

    rng = random.Random(1)
    values = [rng.choice([0.0, 1.5, rng.random()]) for _ in range(500)] + [None]
    df = spark.createDataFrame([(v,) for v in values], "value double")
    counted = df.where("value is not null").groupBy("value").agg(F.count("*").alias("c"))
    got = {r.value: r.upto for r in E.running_counts(counted, "value").collect()}
    known = sorted(v for v in values if v is not None)
    assert got == {v: sum(x <= v for x in known) for v in known}
    assert E.nearest_rank(df, 0.5).first().value == known[round(0.5 * (len(known) - 1))]
    assert E.nearest_rank(df.limit(0), 0.5).first().value is None


def test_markdown_sections():
    text = "# A Title\nwho\n\nwhere\n<!-- page break -->\n## 1. Intro\nIt is good-\nness.\n<!-- note -->\n### Results\n|a|\n|b|\n## A. Setup\n\n## " + "x" * 300 + "\nend"
    got = [(s["number"], s["title"], s["page_start"], s["paragraphs"]) for s in D.markdown_sections(text)]
    assert got[0] == (None, "A Title", 1, [(1, "who"), (1, "where")])
    assert got[1] == ("1", "Intro", 2, [(2, "It is goodness.")])
    assert got[2] == (None, "Results", 2, [(2, "|a|\n|b|")])
    assert got[3][:2] == ("A", "Setup") and got[3][3][0][1].startswith("## xxx")
    assert D.markdown_sections("") == [] and D.markdown_sections("plain")[0]["title"] == "Body"


def test_markdown_chunks_and_failing_embedders(spark):
    docs = spark.createDataFrame([(1, 1, "# One\ntext of one. and more."), (1, 2, "# Two\ntext of two.")], "doc_id long, page int, text string")
    got = D.chunk_documents(docs, markdown=True).orderBy("chunk_index").collect()
    assert [(r.section, r.page_start, r.degraded) for r in got] == [("One", 1, None), ("Two", 2, None)]

    def broken(texts):
        raise ConnectionError

    assert {r.degraded for r in D.chunk_documents(docs, embed=broken, markdown=True).collect()} == {"embedding_failed: ConnectionError"}


def test_ingest_and_better_fingerprints(spark):
    known = spark.createDataFrame([("k", "f0")], "id string, fingerprint string")
    new = spark.createDataFrame([("a", "f1"), ("b", "f1"), ("c", "f0"), ("d", None)], "id string, fingerprint string")
    taken, gone = B.ingest(known, new)
    assert sorted(r.id for r in taken.collect()) == ["a", "d"] and sorted(r.id for r in gone.collect()) == ["b", "c"]
    papers = spark.createDataFrame([("a", "f1", 1), ("b", "f2", 2), ("c", "f3", 3), ("d", "f4", 4)], "id string, fingerprint string, created_at int")
    better = spark.createDataFrame([("b", "doi:1"), ("c", "doi:1"), ("d", "f1")], "id string, fingerprint string")
    assert {r.id: r.fingerprint for r in B.upgrade_fingerprints(papers, better).collect()} == {"a": "f1", "b": "doi:1", "c": "f3", "d": "f4"}


def test_unreadable_stores_say_nothing(spark):
    papers = spark.createDataFrame([("p", "INDEXED", None, None)], "id string, status string, parser_backend string, deleted_at timestamp")
    files = spark.createDataFrame([("p", "papers/p/a.pdf", None)], "paper_id string, object_key string, deleted_at timestamp")
    chunks = spark.createDataFrame([("p", "m")], "paper_id string, embedding_model string")
    objects = spark.createDataFrame([("papers/p/b.pdf",), ("papers/q/c.pdf",)], "key string")
    index = spark.createDataFrame([], "paper_id string, docs long, backends array<string>, models array<string>")
    got = lambda **how: {r.paper_id: r.issues for r in M.consistency(papers, files, chunks, objects, index, **how).collect()}
    assert got() == {"p": ["missing_object", "orphan_object", "missing_index"], "q": ["unknown_paper"]}
    assert got(objects_readable=False) == {"p": ["missing_index"]} and got(objects_readable=False, index_readable=False) == {}


def test_open_cleanups_and_errors_in_means(spark):
    jobs = spark.createDataFrame([(1, "cleanup", '{"expires_at": "2024-01-02T00:00:00"}'), (2, "cleanup", '{"expires_at": "2024-01-01T00:00:00"}'), (3, "parse", "{}"), (4, "cleanup", "{}")], "id int, kind string, payload string")
    assert [r.id for r in M.open_cleanups(jobs, F.lit("2024-01-01 12:00:00").cast("timestamp")).collect()] == [1]
    rows = spark.createDataFrame([("m", "1", None), ("m", "3", " "), ("m", "9", "timeout"), ("m", "x", None)], "metric string, value string, error string")
    assert E.aggregate(rows.withColumn("g", F.lit(1)), ["g"], error="error").first().mean == 2.0


def test_checked_writes(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, None), (None, None)], "id int, t string")
    assert writers.write_checked(df, str(tmp_path), "v", ["id", "t"]) == (1, 2)
    assert sorted(r._why for r in spark.read.parquet(str(tmp_path / "v-failed")).collect()) == ["missing id, missing t", "missing t"]


def test_scans_are_bounded(spark):
    assert M.bounded(spark.range(5), 5).count() == 5
    with pytest.raises(M.ScanLimit):
        M.bounded(spark.range(6), 5)


def test_shells_with_dependents_are_skipped(spark):
    shells = spark.createDataFrame([(k,) for k in ("held", "one", "two", "none", "only_shell", "same")], "id string")
    matches = [("held", "matched", "p1"), ("one", "matched", "p1"), ("one", "ambiguous", "p2"), ("two", "matched", "p1"), ("two", "matched", "p2"), ("only_shell", "matched", "one"), ("same", "matched", "p1"), ("same", "matched", "p1")]
    matches = spark.createDataFrame(matches, "record_id string, status string, paper_id string")
    got = {r.shell_id: (r.action, r.target, r.reason) for r in K.reconcile_shells(shells, matches, spark.createDataFrame([("held",), ("p1",)], "paper_id string")).collect()}
    assert got == {
        "held": ("skip", None, "has dependents"), "one": ("merge", "p1", "one match"), "two": ("delete", None, "several matches"), "none": ("delete", None, "no match"),
        "only_shell": ("delete", None, "no match"), "same": ("merge", "p1", "one match"),
    }


def test_shells_are_merged(spark):
    decisions = [("s", "merge", "t"), ("r", "merge", "s"), ("d", "delete", None), ("k", "keep", None), ("x", "merge", "y"), ("y", "merge", "x"), ("e", "merge", "d"), ("m", "merge", "missing")]
    decisions = spark.createDataFrame(decisions, "shell_id string, action string, target string")
    tags = spark.createDataFrame([("s", "x"), ("t", "x"), ("s", "y"), ("k", "z"), ("r", "w"), ("r", "x"), ("x", "1"), ("e", "2"), ("m", "3")], "paper_id string, tag string")
    papers = spark.createDataFrame([(p,) for p in "stdkrxyem"], "id string")
    rows, left = K.merge_shells(decisions, tags, papers, ["tag"])
    assert sorted((r.paper_id, r.tag) for r in rows.collect()) == [("e", "2"), ("k", "z"), ("m", "3"), ("t", "w"), ("t", "x"), ("t", "y"), ("x", "1")]
    assert sorted(r.id for r in left.collect()) == ["e", "k", "m", "t", "x", "y"]


def test_reextraction_is_taken_over(spark):
    current = spark.createDataFrame([("p", "a", "1"), ("p", "b", "2")], "paper_id string, field string, value string")
    fresh = spark.createDataFrame([("p", "a", "9"), ("p", "c", "3")], "paper_id string, field string, value string")
    got = K.apply_reextraction(current, K.reextraction_diff(current, fresh))
    assert sorted((r.field, r.value) for r in got.collect()) == [("a", "9"), ("b", "2"), ("c", "3")]
    got = K.apply_reextraction(current, K.reextraction_diff(current, fresh), ["c"])
    assert sorted((r.field, r.value) for r in got.collect()) == [("a", "1"), ("b", "2"), ("c", "3")]


def test_strict_schema(spark):
    good = spark.createDataFrame([("a", "A", "a")], "id string, normalized_name string, name string")
    assert strict(good, "authors").columns == ["id", "name", "normalized_name"]
    with pytest.raises(SchemaMismatch):
        strict(good.withColumn("extra", F.lit(1)), "authors")


def test_sources(spark, tmp_path):
    import io
    import json
    import zipfile

    lines = [
        json.dumps({"title": "A", "article_number": "1", "publication_title": "V", "publication_date": "July 2015", "authors": [{"full_name": "X Y"}], "start_page": "1", "end_page": "4"}),
        json.dumps({"title": "B", "DOI": "10.1/B", "type": "article", "author": [{"given": "C", "family": "D"}]}),
        json.dumps({"title": "E", "year": "1999", "authors": ["F G"]}),
        "{bad",
        "",
    ]
    (tmp_path / "x.jsonl").write_text("\n".join(lines))
    got = readers.read_bibliography(spark, str(tmp_path / "x.jsonl")).collect()
    assert [(r.format, r.title, r.year, r.authors, r.error) for r in got] == [
        ("ieee", "A", 2015, ["X Y"], None), ("csl", "B", None, ["C D"], None), ("generic", "E", 1999, ["F G"], None), (None, None, None, None, "invalid_json"),
    ]
    assert got[0].pages == "1-4" and got[0].date.isoformat() == "2015-07-01" and got[1].doi == "10.1/b"
    folder = tmp_path / "in"
    (folder / "sub").mkdir(parents=True)
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("a.txt", "hello")
        z.writestr("../evil.txt", "x")
        z.writestr("n.zip", "x")
        z.writestr("bomb.txt", "0" * 1_000_000)
    (folder / "sub" / "One.ZIP").write_bytes(data.getvalue())
    (folder / ".hidden.zip").write_bytes(b"x")
    (folder / "bad.zip").write_bytes(b"nope")
    rows = readers.read_archives(readers.read_folder(spark, str(folder), "*.zip")).collect()
    assert {(r.name, r.error) for r in rows} == {("a.txt", None), ("../evil.txt", "unsafe_path"), ("n.zip", "nested_archive"), ("bomb.txt", "suspicious_ratio"), (None, "bad_archive")}
    (tmp_path / "q.jsonl").write_text('{"id": "1", "query": "x"}\n\n{"id": "2", "query": "y", "note": "n"}\n')
    assert [r.id for r in readers.read_eval_queries(spark, str(tmp_path / "q.jsonl")).collect()] == ["1", "2"]
    (tmp_path / "l.jsonl").write_text('{"query_id": "1", "paper_id": "p", "grade": 1}\n{"query_id": oops\n')
    with pytest.raises(ValueError, match="l.jsonl:2: .*oops"):
        readers.read_graded_labels(spark, str(tmp_path / "l.jsonl"))
    assert [r.key for r in readers.object_listing(spark, str(folder), "sub/").collect()] == ["sub/One.ZIP"]


def test_article_fields(spark, tmp_path):
    import json

    record = {
        "title": "A", "article_number": 7, "publication_title": "V", "is_number": 88, "issn": "1234-5678", "citing_paper_count": "12",
        "authors": [{"full_name": "Third", "author_order": 3}, {"full_name": "First", "author_order": 1}, {"full_name": "Second", "author_order": "2"}, {"full_name": "Unnumbered"}],
        "index_terms": {"ieee_terms": {"terms": ["X", " y "]}, "author_terms": {"terms": []}},
    }
    (tmp_path / "r.jsonl").write_text(json.dumps(record) + "\n" + json.dumps({"title": "B"}) + "\n")
    got = {r.title: r for r in readers.read_bibliography(spark, str(tmp_path / "r.jsonl")).collect()}
    a, b = got["A"], got["B"]
    assert (a.authors, a.issue_number, a.issn, a.citing_count) == (["First", "Second", "Third", "Unnumbered"], "88", "1234-5678", 12)
    assert (a.ieee_terms, a.author_terms, a.dynamic_index_terms, b.ieee_terms, b.citing_count) == (["X", "y"], [], [], [], None)


def test_budget_pages(spark):
    rows = spark.createDataFrame([("g", k, t) for k, t in enumerate(["aaaa", "bbb", None, "cccc", "dd"])] + [("h", 0, "xx")], "g string, k int, t string")
    page = lambda budget, start=0: [(r.g, r.place, r.t, r.truncated, r.next_offset) for r in C.budget_page(rows, "g", "k", "t", budget, start).orderBy("g", "k").collect()]
    assert page(9) == [("g", 0, "aaaa", False, 4), ("g", 1, "bbb", False, 4), ("g", 2, None, False, 4), ("g", 3, "cc", True, 4), ("h", 0, "xx", False, None)]
    assert page(9, 4) == [("g", 4, "dd", False, None)]
    assert page(7)[:2] == [("g", 0, "aaaa", False, 2), ("g", 1, "bbb", False, 2)] and page(100)[-2][-1] is None


def test_writers(spark, tmp_path):
    df = spark.range(10)
    assert writers.write_version(df, str(tmp_path), "v1", 10) == 10
    with pytest.raises(ValueError):
        writers.write_version(df, str(tmp_path), "v2", 11)
    writers.swap(spark, "numbers", str(tmp_path), "v1")
    assert spark.table("numbers").count() == 10
    assert writers.insert_missing(df, spark.range(8, 12).union(spark.range(11, 12)), "id").count() == 2


def test_streams(spark, sf, tmp_path):
    source = spark.read.parquet(f"{sf}/events.parquet")
    source.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(source.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    updates = stream.select(F.col("user_id").alias("paper_id"), F.col("event_id").alias("revision"), "value")
    store: dict = {}

    def apply(df, epoch):
        for r in df.collect():
            if r.revision > store.get(r.paper_id, -1):
                store[r.paper_id] = r.revision

    q = stream_outbox(updates, apply, str(tmp_path / "cp"), "0 seconds")
    q.processAllAvailable()
    q.stop()
    want = {r.paper_id: r.revision for r in latest_revisions(source.select(F.col("user_id").alias("paper_id"), F.col("event_id").alias("revision"), "value")).collect()}
    assert store == want
    counts = windowed_counts(stream, "1 day", late="1 hour")
    q = counts.writeStream.outputMode("update").format("memory").queryName("days").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("days").count() > 0


def test_a_revision_that_comes_during_a_flush_stays_open(spark, tmp_path):
    from quire.streaming.outbox import flush_in_batches, pending_updates

    (tmp_path / "in").mkdir()
    schema = "paper_id long, revision long, kind string"
    add = lambda df: df.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    add(spark.createDataFrame([(p, 1, "update") for p in range(45)] + [(7, 0, "update"), (None, 1, "update"), (9, 1, "done")], schema))
    changes = pending_updates(spark.readStream.schema(schema).parquet(str(tmp_path / "in")))
    seen: dict = {}

    def keep(df, epoch):
        seen.update({r.paper_id: (r.revision, r.attempts, r.open) for r in df.collect()})

    q = changes.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    assert seen == {p: (1, 0, p != 9) for p in range(45)}
    batches: list = []

    def write(batch):
        batches.append(batch)
        if len(batches) == 1:  # while the first batch is written, paper 3 changes again
            add(spark.createDataFrame([(3, 2, "update")], schema))
            q.processAllAvailable()
        if len(batches) == 2:
            raise OSError("unreachable")
        return True

    flush_in_batches(spark.createDataFrame([(p, *s) for p, s in seen.items()], "paper_id long, revision long, attempts int, open boolean"), write, add)
    q.processAllAvailable()
    q.stop()
    assert [len(b) for b in batches] == [20, 20, 4]
    assert seen[3] == (2, 0, True) and seen[0] == (1, 0, False) and seen[44] == (1, 0, False)
    second = {p for p, _ in batches[1]}
    assert all(seen[p] == (1, 1, True) for p in second) and all(not seen[p][2] for p in range(45) if p not in second and p != 3)


@pytest.mark.parametrize(("text", "want"), [("2015", 2015), ("July 2015", 2015), ("999", None), ("a-1999-b", 1999), ("12345", None), ("", None), (None, None)])
def test_parse_year(spark, text, want):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(K.parse_year(F.col("t")).alias("y")).first().y == want


def test_venues(spark):
    venues = spark.createDataFrame([("v", "IEEE Trans. X", "ieee trans x")], "id string, name string, normalized_name string")
    papers = spark.createDataFrame([("1", "v", 2019, None, None), ("2", "v", None, 2020, None), ("3", "w", 2019, None, None)], "id string, venue_id string, year int, venue_year int, deleted_at timestamp")
    assert [r.id for r in K.papers_of_venue(papers, venues, "IEEE Trans X").orderBy("id").collect()] == ["1", "2"]
    assert [r.id for r in K.papers_of_venue(papers, venues, ["ieee trans. x", "other"], 2020).collect()] == ["2"]


def test_cache_misses(spark):
    files = spark.createDataFrame([("a", "o"), ("b", "o"), ("a", "p")], "sha256 string, options string")
    assert {(r.sha256, r.options) for r in K.cache_misses(files, files.where("sha256 = 'a' and options = 'o'")).collect()} == {("b", "o"), ("a", "p")}
