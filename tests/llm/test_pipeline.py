"""The pipeline against its stages' contracts."""

import collections
import functools
import random

from pyspark.sql import functions as F

import corpus_pipeline as P
from quire.llm import mixing, packing
from quire.llm.common import clear_written, written
from tests.llm import brute
from tests.llm.test_text import check_pieces


def test_stages(spark, sf):
    assert [n for n, _ in P.STAGES] == ["quality", "toxicity", "near_duplicates", "mixing", "packing"]
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, seen = docs.columns, [docs.collect()]
    for name, stage in P.STAGES[:-1]:
        docs = P.materialize(stage(spark, docs, sf), name)
        assert docs.columns == columns
        seen.append(docs.collect())
    first, good, clean, unique, mixed = seen
    assert {r.doc_id for r in good} <= {r.doc_id for r in first} and all(not brute.quality_counts(r.text)[0] < 20 for r in good)
    assert {r.doc_id for r in clean} <= {r.doc_id for r in good}
    want = brute.components([r.text for r in clean])
    groups = {min(clean[k].doc_id for k in g) for _, g in want.values()}
    assert sorted(r.doc_id for r in unique) == sorted(groups)
    assert collections.Counter(mixed) == collections.Counter(unique)
    check_pieces(P.run(spark, sf).collect(), [(r.doc_id, r.text) for r in mixed])


TEXT = "The people of the town went to the market on {} day and bought bread, cheese, apples and {} other things for their long way home."


def small_docs(spark):
    words = "red green blue white black brown amber ivory olive coral".split()
    rows = [(k, TEXT.format(words[k % 10] + str(k), k * 7) + " " + " ".join(f"{w}{k * 13 % 97}" for w in words), "en", "ab"[k % 2], 100) for k in range(60)]
    rows += [(60, rows[0][1], "en", "a", 1), (5, rows[6][1] + " more", "en", None, 1), (None, rows[7][1] + " some", "en", "b", 1), (None, None, None, None, None), (61, "", "en", "a", 0), (1, rows[1][1], "en", "b", 100)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")


def test_stages_with_odd_rows_and_names(spark, sf):
    names = ("score", "n_words", "position", "_key", "_t", "row", "key", "at", "cls", "quality", "slot", "window")
    docs = small_docs(spark).select("*", *(F.lit("mine").alias(c) for c in names))
    columns = docs.columns
    for name, stage in P.STAGES[:-1]:
        before = docs.count()
        docs = P.materialize(stage(spark, docs, sf), name)
        assert docs.columns == columns and 0 < docs.count() <= before
        assert all(r[c] == "mine" for r in docs.collect() for c in names)
        assert stage(spark, docs.limit(0), sf).count() == 0
    left = docs.collect()
    assert len({r.text for r in left}) == len(left)
    check_pieces(P.STAGES[-1][1](spark, docs, sf).collect(), [(r.doc_id, r.text) for r in left])
    assert P.STAGES[-1][1](spark, docs.limit(0), sf).count() == 0


def test_mixing_shows_in_the_packed_sequences(spark, monkeypatch):
    """Every run of sequences holds both sources in their shares; without the mixing stage it would not."""
    monkeypatch.setattr("quire.llm.packing.RUN_ROWS", 64)
    monkeypatch.setattr("quire.llm.packing.in_runs", functools.partial(packing.in_runs, run_rows=64))
    rng = random.Random(4)
    topic = {"a": "bread cheese apple butter".split(), "b": "stone iron copper silver".split()}
    rows = [(k, " ".join(rng.choices(topic["a" if k < 512 else "b"], k=40)), "a" if k < 512 else "b") for k in range(1024)]
    docs = P.materialize(spark.createDataFrame(rows, "doc_id long, text string, source string"), "docs")
    source = {r[0]: r[2] for r in rows}

    def worst(docs):
        pieces = sorted(packing.packing_stage(spark, docs, "").collect(), key=lambda r: (r.sequence_id, r.offset))
        shares = []
        for at in range(0, len(pieces) - 255, 256):
            some = [source[r.doc_id] for r in pieces[at : at + 256]]
            shares.append(abs(some.count("a") / len(some) - 0.5))
        return max(shares)

    assert worst(docs) > 0.4
    assert worst(P.materialize(mixing.mixing_stage(spark, docs, ""), "mixed")) < 0.2


def test_run_clears_what_stages_wrote(spark, sf):
    clear_written(spark)
    assert P.run(spark, sf).count() > 0
    assert len(written()) <= 3  # the last stage's input and its own tables


def test_registry():
    import re

    import __spark_entry__ as entry

    names = list(entry.queries())
    for n in range(1, 11):
        assert sum(bool(re.match(rf"op{n}_", x)) for x in names) == 1
    assert "pipeline" in names


def test_pipeline_on_an_empty_table(spark, sf, tmp_path):
    for name in ("documents", "labels"):
        table = spark.read.parquet(f"{sf}/{name}.parquet")
        (table.limit(0) if name == "documents" else table).write.parquet(str(tmp_path / f"{name}.parquet"))
    assert P.run(spark, str(tmp_path)).count() == 0
