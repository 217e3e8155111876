"""Operators 1, 4 and 6."""

import collections
import random

import pytest
from pyspark.sql import functions as F

import numpy as np

from quire.llm import common
from quire.llm.common import clear_written, find_splitters, interval_index, materialize
from quire.llm.mixing import mixing_stage, op1_mixing, pfair_mix, windows
from quire.llm.quality import COUNTS, RULES, base_columns, fit, judge, op4_quality, quality_stage
from quire.llm.sharding import histogram_shards, op6_sharding
from tests.llm import brute
from tests.llm.brute import quality_counts

PYTHON = ("Python", "Pandas", "Arrow")


def plan(df):
    return df._jdf.queryExecution().toString()


# ---- mixing


def check_mix(rows, weights, half_rows):
    """The whole order against a slot-by-slot fluid model and a plain scheduler of each window."""
    assert sorted(r.position for r in rows) == list(range(len(rows)))
    n = collections.Counter(r.source for r in rows)
    halves = {s: -(-k // half_rows) for s, k in n.items()}
    by_slot = collections.defaultdict(list)
    for r in sorted(rows, key=lambda r: r.position):
        by_slot[r.slot].append(r)
    assert list(by_slot) == list(range(sum(halves.values())))  # positions follow slots
    lines, done = brute.target_lines(halves, weights), collections.Counter()
    for t, line in enumerate(lines):
        assert all(abs(done[s] - line[s]) < 2 for s in halves), t  # halves: less than one block
        if t in by_slot:
            (s,) = {r.source for r in by_slot[t]}
            assert {r.block for r in by_slot[t]} == {done[s] // 2}
            assert len(by_slot[t]) == min(half_rows, n[s] - done[s] * half_rows)
            done[s] += 1
    of_window = collections.defaultdict(list)
    for t, some in by_slot.items():
        of_window[some[0].window].append(some[0].source)
    names = sorted(n, key=lambda s: (s is not None, s))
    for order in of_window.values():
        counts = collections.Counter(order)
        assert order == brute.earliest_deadline_first({s: counts[s] for s in names if counts[s]})


@pytest.mark.parametrize("seed", range(3))
def test_mix_keeps_to_target_lines(spark, seed):
    rng = random.Random(seed)
    rows = [(k, rng.choices(["hot", "a", "b", None, "ü"], [50, 10, 20, 5, 3])[0], "x") for k in range(1500)]
    df = spark.createDataFrame(rows, "doc_id long, source string, slot string")
    weights = {"hot": 5, "a": 7, "b": 1, None: 2, "ü": 3}
    got = pfair_mix(df, weights, block_rows=8, window=32).collect()
    assert sorted(r.doc_id for r in got) == list(range(1500))
    check_mix(got, weights, 4)


def test_mix_adds_up_no_rounding(spark):
    """Many windows, equal thirds, and many sources far below one block a window."""
    sizes = {"a": 3000, "b": 3000, "c": 3000} | {f"s{k:02}": 30 for k in range(40)}
    df = spark.createDataFrame([(s, k) for s, n in sizes.items() for k in range(n)], "source string, doc_id long")
    weights = {s: n for s, n in sizes.items()}
    check_mix(pfair_mix(df, weights, block_rows=4, window=16).collect(), weights, 2)
    halves, weight = np.array([10**6, 10**6, 10**6 + 1, 700]), np.array([1.0, 1.0, 1.0, 1e-3])
    lag = 0.0
    for at, done, _ in windows(halves, weight, 256):
        lag = max(lag, abs(done[0] - done[1]))
    assert lag <= 1


def test_mix_of_documents(spark, sf):
    df = op1_mixing(spark, sf)
    rows = df.collect()
    n = collections.Counter(r.source for r in rows)
    check_mix(rows, {s: float(k) ** 0.7 for s, k in n.items()}, 16)
    assert not any(p in plan(df) for p in PYTHON)


def test_mix_with_a_shuffled_schedule(spark, monkeypatch):
    monkeypatch.setattr("quire.llm.mixing.BROADCAST_ROWS", -1)
    df = spark.createDataFrame([(k, None if k % 3 else "a") for k in range(300)], "doc_id long, source string")
    check_mix(pfair_mix(df, {"a": 1}, block_rows=4, window=16).collect(), {"a": 1, None: 1}, 2)


def test_mix_edges(spark):
    empty = spark.createDataFrame([], "doc_id long, source string, position string")
    assert pfair_mix(empty).count() == 0 and pfair_mix(empty).columns.count("position") == 1
    odd = spark.createDataFrame([(None, None), (None, None), (1, "a"), (1, "a")], "doc_id long, source string")
    assert sorted(r.position for r in pfair_mix(odd).collect()) == [0, 1, 2, 3]
    with pytest.raises(ValueError):
        pfair_mix(odd, {"a": 0.0})
    same = spark.createDataFrame([(None, "a")] * 4000, "doc_id long, source string")
    tasks = collections.Counter(r.p for r in pfair_mix(same).select(F.spark_partition_id().alias("p")).collect())
    assert max(tasks.values()) < 3000  # rows without an id are spread


CLASHES = (*COUNTS, "kept", "votes", "quality", "base_failed", "_t", "_w", "_h", "_win", "_key", "_src", "_at", "key", "src", "row", "part", "at", "block", "window", "slot", "position", "shard", "size", "half")


def test_native_operators_leave_other_columns_alone(spark):
    rows = [(k, "one two three four five six seven eight nine ten " * (k % 4), "en", "ab"[k % 2]) for k in range(40)] + [(None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumns({c: F.lit("mine") for c in CLASHES})
    for stage in (quality_stage, mixing_stage):
        got = stage(spark, docs, "")
        assert got.columns == docs.columns
        assert all(r[c] == "mine" for r in got.collect() for c in CLASHES)
        assert stage(spark, docs.limit(0), "").count() == 0
    assert sorted(map(str, mixing_stage(spark, docs, "").collect())) == sorted(map(str, docs.collect()))
    mine = lambda df, made: all(r[c] == "mine" for r in df.collect() for c in CLASHES if c not in made)
    assert mine(pfair_mix(docs), ("block", "window", "slot", "position"))
    assert mine(histogram_shards(docs, F.lit(1), ["text"], ["doc_id"]), ("shard", "slot"))
    assert mine(judge(docs), (*COUNTS, "votes", "base_failed", "quality", "kept"))


# ---- sharding


def check_shards(rows, shards=16):
    slots = collections.defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) <= set(range(shards))


def test_shards_of_documents(spark, sf):
    df = op6_sharding(spark, sf)
    rows = df.collect()
    check_shards(rows)
    import zlib

    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert {(r.doc_id, r.size, r.text_crc32) for r in rows} == {(k, len(t.encode()) + 1, zlib.crc32(t.encode())) for k, t in texts.items()}
    assert {r.law for r in rows} == {"bytes"} and {r.grown_shard for r in rows} == {None}
    assert not any(p in plan(df) for p in PYTHON)


def test_shards_are_even_despite_a_hot_group(spark):
    rows = spark.range(30_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "copy").otherwise(F.col("id").cast("string")).alias("g"), F.lit(10).alias("slot"))
    got = histogram_shards(rows, F.lit(7), ["g"], ["doc_id"], 8)
    sums = [r.n for r in got.groupBy("shard").agg(F.count("*").alias("n")).collect()]
    assert len(sums) == 8 and max(sums) - min(sums) < 0.03 * 30_000 / 8
    alone = got.where("g <> 'copy'").groupBy("g").agg(F.count_distinct("shard").alias("n")).agg(F.max("n")).first()[0]
    assert alone == 1


def test_shards_edges(spark):
    empty = spark.createDataFrame([], "doc_id long, g string, shard int")
    assert histogram_shards(empty, F.lit(1), ["g"], ["doc_id"]).count() == 0
    same = spark.createDataFrame([(None, None)] * 64, "doc_id long, g string")
    got = histogram_shards(same, F.lit(1), ["g"], ["doc_id"], 4).collect()
    check_shards(got, 4)
    assert max(collections.Counter(r.shard for r in got).values()) < 40


def test_splitters_are_exact(spark):
    rng = random.Random(3)
    keys = [rng.choice([5, 2**62, rng.getrandbits(63), rng.getrandbits(20)]) for _ in range(2000)]
    df = spark.createDataFrame([(k, 1 + k % 7) for k in keys], "k long, w int")
    cut = find_splitters(df, F.col("k"), F.col("w"), 10, 0.01)
    assert cut.total == sum(1 + k % 7 for k in keys) and cut.bounds == sorted(cut.bounds)
    assert cut.below == [sum(1 + k % 7 for k in keys if k < b) for b in cut.bounds]


def test_many_bounds_are_searched(spark, monkeypatch):
    bounds = sorted(random.Random(1).sample(range(10**6), 300))
    values = [0, 10**6, *bounds, *(b - 1 for b in bounds), *(b + 1 for b in bounds)]
    df = spark.createDataFrame([(v,) for v in values], "v long")
    for limit in (10, 1000):
        monkeypatch.setattr(common, "TREE_BOUNDS", limit)
        got = {r.v: r.k for r in df.select("v", interval_index(F.col("v"), bounds).alias("k")).collect()}
        assert all(got[v] == sum(b <= v for b in bounds) for v in values)


def test_written_tables_can_be_cleared(spark):
    clear_written(spark)
    table = materialize(spark.range(3), "t")
    path = table.inputFiles()[0].rpartition("/")[0].removeprefix("file://")
    assert table.count() == 3 and clear_written(spark) == 1
    import os

    assert not os.path.exists(path)


# ---- quality


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(1)
    vocabulary = ["alpha", "Beta", "gamma,", "#x", "ü|", "a"]
    made = [" ".join(rng.choices(vocabulary, k=n)) for n in (0, 1, 7, 8, 9, 16, 40, 300)]
    phrase = "one two three four five six seven eight nine "
    made += [phrase * 2, phrase * 3 + "end", phrase[:-6] + "x " + phrase, "same line\nsame line\n\n \nother\nsame line", "\t \n", " lead and tail ", "a b c\x1cd", "w " * 30]
    return [None, "", *made, "word " * 20_000]


def test_base_counts_match_brute_force(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in base_columns(df).collect():
        got = (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words)
        assert got == quality_counts(texts[r.doc_id]), (r.doc_id, (texts[r.doc_id] or "")[:80])


def test_quality_of_documents(spark, sf):
    df = op4_quality(spark, sf)
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = df.collect()
    assert len(rows) == len(texts)
    for r in rows:
        n, *_, repeat = want = quality_counts(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (n < 20 or 100 * repeat > 30 * n)
        assert not (r.base_failed and r.kept)
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    good = [r.kept for r in rows if labels.get(r.doc_id) == 1 and not r.base_failed]
    bad = [r.kept for r in rows if labels.get(r.doc_id) == 0]
    assert sum(good) >= 0.98 * len(good) and sum(bad) <= 0.5 * len(bad)
    assert not any(p in plan(df) for p in PYTHON)


def test_verdicts_match_brute_force(spark, sf):
    """Votes from the counts by plain comparisons, and expectation-maximisation over single rows instead of patterns."""
    rows = judge(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")).collect()
    bad = [
        lambda r: 10 * r.n_symbols > r.n_words, lambda r: 100 * r.n_letters < 70 * r.word_chars, lambda r: 10 * r.n_upper > 4 * r.n_letters, lambda r: 10 * r.n_marks > r.n_words,
        lambda r: 100 * r.n_repeat_words > 15 * r.n_words, lambda r: r.n_dup_lines >= 2 and 10 * r.n_dup_lines > 2 * r.n_lines, lambda r: r.n_words >= 60 and 100 * r.n_distinct < 30 * r.n_words,
        lambda r: r.n_words < 20, lambda r: r.word_chars > 16 * r.n_words or 2 * r.word_chars < 3 * r.n_words, lambda r: r.n_words >= 100 and 200 * r.n_stops < r.n_words,
    ]
    good = [lambda r: 50 * r.n_symbols <= r.n_words, lambda r: 100 * r.n_letters >= 88 * r.word_chars, lambda r: 10 * r.n_upper <= r.n_letters, lambda r: False, lambda r: r.n_repeat_words == 0, *[lambda r: False] * 5]
    votes = np.array([[0 if not r.n_words else -1 if b(r) else 1 if g(r) else 0 for b, g in zip(bad, good)] for r in rows])
    assert [list(r.votes) for r in rows] == votes.tolist()
    prior, rate = 0.85, {1: np.full(10, 0.98), 0: np.full(10, 0.25)}  # P(good vote | class)
    post = None
    for _ in range(100):
        log = {y: np.log(p) + np.where(votes == 1, np.log(rate[y]), np.where(votes == -1, np.log(1 - rate[y]), 0)).sum(axis=1) for y, p in ((1, prior), (0, 1 - prior))}
        post = 1 / (1 + np.exp(log[0] - log[1]))
        share = {1: post, 0: 1 - post}
        rate = {y: (20 * start + ((votes == 1) * share[y][:, None]).sum(axis=0)) / (20 + ((votes != 0) * share[y][:, None]).sum(axis=0)) for y, start in ((1, 0.98), (0, 0.25))}
        prior = (20 * 0.85 + post.sum()) / (20 + len(rows))
    assert np.abs(post - np.array([r.quality for r in rows])).max() < 1e-4
    assert [r.kept for r in rows] == [bool(p >= 0.5 and not r.base_failed) for p, r in zip(post, rows)]


def test_quality_edges(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, kept string")
    assert judge(empty).count() == 0
    rows = spark.createDataFrame([(1, None, "x"), (1, None, "x"), (None, "", None)], "doc_id long, text string, n_words string")
    got = judge(rows).collect()
    assert len(got) == 3 and all(r.base_failed and not r.kept and r.n_words == 0 for r in got)


def test_few_distinct_words_do_not_depend_on_length(spark):
    rng = random.Random(2)
    poor = lambda n: " ".join(rng.choices([f"w{k}" for k in range(150)], k=n))
    rich = lambda n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))
    df = spark.createDataFrame([(n, t(n), t is poor) for n in (1500, 1999, 2000, 30_000) for t in (poor, rich)], "doc_id long, text string, poor boolean")
    k = [r.name for r in RULES].index("few_distinct_words")
    assert all((r.votes[k] == -1) == r.poor for r in judge(df).collect())


def test_expectation_maximisation_tells_rules_apart():
    rng = random.Random(5)
    counts = collections.Counter()
    for _ in range(5000):
        good = rng.random() < 0.8
        accurate = [1 if (rng.random() < 0.95) == good else -1 for _ in range(3)]
        counts[*accurate, rng.choice((1, -1))] += 1
    model = fit(counts, 4)
    assert abs(model.prior - 0.8) < 0.05
    assert model.bad[0][0] > 0.85 and 0.3 < model.bad[3][0] < 0.7


def test_very_long_texts(spark):
    rows = [(k, "a" if k % 2 else "b", "x" * (2_000_000 if k == 3 else 50)) for k in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    out = histogram_shards(docs, F.octet_length("text") + 1, ["text"], ["doc_id"], shards=4).collect()
    assert sorted(r.doc_id for r in out) == list(range(40)) and all(len(r.text) == (2_000_000 if r.doc_id == 3 else 50) for r in out)
    mixed = pfair_mix(docs).collect()
    assert sorted(r.doc_id for r in mixed) == list(range(40)) and sum(len(r.text) for r in mixed) == 2_000_000 + 39 * 50
