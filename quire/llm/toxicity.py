"""Operator 7, toxicity by weak supervision.

Features are a fixed lexicon, patterns, and all words and word beginnings that labelled training
rows surely tie to toxicity. Voters are the fixed entries and families of features (equal first
letters). A generative label model over all documents estimates how often each voter fires on toxic
and on clean texts, and how voters correlate; its posterior labels train a linear classifier over
all features, which scores the texts.

Texts are read twice: training texts to count words, then all texts once to write the numbers of the
features they have. The label model, the classifier and the scores work on those numbers.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.llm.common import clear_written, join_small, kept_row, materialize, written
from quire.llm.shingles import shingle_sets

#: Common English insults, each a voter.
LEXICON = (
    "idiot", "idiots", "moron", "morons", "stupid", "scum", "loser", "losers", "pathetic", "worthless",
    "disgusting", "trash", "clown", "filth", "imbecile", "dumb", "bastard", "vermin", "retard", "garbage",
)

#: Patterns over the lower-cased text, each a voter.
PATTERNS = (
    ("second_person_insult", r"\byou(?:'re| are| r)? (?:a |an |such a |so |all )?(?:" + "|".join(LEXICON) + r")\b"),
    ("threat", r"\b(?:kill|hurt|destroy) (?:you|them|yourself|her|him)\b"),
    ("go_away", r"\b(?:shut up|drop dead|go to hell|get lost)\b"),
)

_WORD = re.compile(r"[^\W\d_]+")
#: Word beginnings of these lengths are features beside whole words; they stand for word families.
STEMS = (4, 5, 6, 7, 8)
#: Families beyond so many, the weaker ones, vote together by their strength, in so many groups.
LONE_VOTERS, SHARED_VOTERS = 96, 16
#: Features within so much of their family's best log odds are its pure ones.
PURE = 2.0
#: Up to so many labelled rows are broadcast; more are joined by shuffle.
BROADCAST_LABELS = 1_000_000


def features(word: str) -> list[str]:
    """A word's features: itself, and its beginnings with a trailing *."""
    return [word, *(f"{word[:n]}*" for n in STEMS if len(word) >= n)]


class Finder(dict):
    """Word -> numbers of the wanted features that it has; remembers a bounded number of words."""

    def __init__(self, wanted: Iterable[str], patterns: tuple[tuple[str, str], ...] = (), most: int = 300_000):
        super().__init__()
        self.number = {f: k for k, f in enumerate(wanted)}
        self.patterns = [(len(self.number) + k, re.compile(p)) for k, (_, p) in enumerate(patterns)]
        self.most = most

    def __missing__(self, word: str) -> tuple[int, ...]:
        if len(self) >= self.most:
            self.clear()
        found = tuple(self.number[f] for f in features(word) if f in self.number)
        self[word] = found
        return found

    def fired(self, text: str | None) -> list[int]:
        low = (text or "").lower()
        found: set[int] = set()
        for ids in map(self.__getitem__, set(_WORD.findall(low))):
            if ids:
                found.update(ids)
        found.update(k for k, p in self.patterns if p.search(low))
        return sorted(found)


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns))


def _weighted(training: DataFrame) -> DataFrame:
    """Training rows (text, toxic) with a weight: texts that are copies of each other share the weight of one.

    Copies repeat each other's chance words, so they are no further evidence. They are told by the least hash of
    their three-word shingles, which near copies mostly have in common.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            least = [int(items[0].view(np.int64)) if len(items) else 0 for items in shingle_sets(batch.column(0), 3)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(least, pa.int64())], names=["text", "toxic", "least"])

    marked = materialize(training.select("text", F.col("toxic").cast("int")).mapInArrow(run, "text string, toxic int, least long"), "training")
    copies = marked.groupBy("least").agg(F.count("*").alias("copies")).where("copies > 1")
    # A group of copies may hold a third of all rows: they are dealt over 16 groups, and its count is in each.
    copies = copies.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(15))))
    dealt = marked.withColumn("salt", F.pmod(F.monotonically_increasing_id(), F.lit(16)).cast("int"))
    return dealt.join(copies, ["least", "salt"], "left").select("text", "toxic", F.coalesce(1 / F.col("copies"), F.lit(1.0)).alias("weight"))


def _feature_counts(weighted: DataFrame) -> DataFrame:
    """feature, bad, good: in how many toxic and clean texts each feature is, by weight; and the weights' sums as feature ''.

    Counts are summed in each task first.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: tuple[Counter, Counter] = (Counter(), Counter())
        known: dict[str, list[str]] = {}

        def out() -> pa.RecordBatch:
            names = list(counts[0].keys() | counts[1].keys())
            made = [pa.array(names, pa.string()), *(pa.array([float(c[n]) for n in names], pa.float64()) for c in (counts[1], counts[0]))]
            for c in counts:
                c.clear()
            return pa.RecordBatch.from_arrays(made, names=["feature", "bad", "good"])

        for text, toxic, weight in _texts(batches):
            if len(counts[0]) + len(counts[1]) > 500_000:  # memory of a task is bounded
                yield out()
            if len(known) > 300_000:
                known.clear()
            found = {""}
            for w in set(_WORD.findall((text or "").lower())):
                if len(w) > 2:
                    some = known.get(w)
                    if some is None:
                        some = known[w] = features(w)
                    found.update(some)
            into = counts[toxic == 1]
            if weight == 1:
                into.update(found)
            else:
                for f in found:
                    into[f] += weight
        yield out()

    counted = weighted.mapInArrow(run, "feature string, bad double, good double")
    return counted.groupBy("feature").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))


@dataclass
class Lexicon:
    """Learned features with their log odds, and the voters that stand for families of them.

    A family's purest features are one voter. Its others are a second one, which only votes on texts
    where the first does not: that the purer ones are there too is no reason to trust them.
    """

    features: list[str]
    odds: np.ndarray
    voter: np.ndarray  # number of each feature's voter; fixed words and patterns follow the learned voters
    first: np.ndarray  # by voter: the voter that it gives way to, or -1
    leads: np.ndarray  # pure features that no stronger one of their family stands for

    def __post_init__(self) -> None:
        learned = set(self.features)
        self.vocabulary = [*self.features, *(w for w in LEXICON if w not in learned)]
        extra = len(self.vocabulary) - len(self.features) + len(PATTERNS)
        self.learned = len(self.first)
        self.of = np.concatenate([self.voter, self.learned + np.arange(extra)]).astype(int)
        self.first = np.concatenate([self.first, np.full(extra, -1)]).astype(int)

    def votes(self, ids: list[int]) -> np.ndarray:
        """The voters that fire on a text with these features."""
        fired = np.unique(self.of[ids])
        return fired[~np.isin(self.first[fired], fired)]


def learn_lexicon(counts: DataFrame, support: int = 4) -> Lexicon:
    """All features in at least `support` toxic texts whose log odds exceed 3 by more than chance.

    Chance is judged for all features looked at together, so a larger corpus with more rare words asks for
    more evidence. Features are chosen where the counts are; what comes to the driver is what the model keeps.
    """
    counts = materialize(counts.where((F.col("bad") >= support) | (F.col("feature") == "")), "features")
    n_toxic, n_clean = counts.where("feature = ''").select("bad", "good").first() or (0.0, 0.0)
    tried = counts.count()
    nt, nc = max(1.0, n_toxic), max(1.0, n_clean)
    odds = F.log((F.col("bad") + 0.5) / (n_toxic + 1)) - F.log((F.col("good") + 0.5) / (n_clean + 1))
    rate = (F.col("bad") + F.col("good")) / (nt + nc)
    # Log-likelihood ratio statistic of the feature's counts in both classes.
    part = lambda c, n: F.when(F.col(c) > 0, F.col(c) * F.log(F.col(c) / (n * rate))).otherwise(0.0)
    sure = 2 * (part("bad", nt) + part("good", nc))
    rows = counts.where("feature <> ''").select("feature", "bad", odds.alias("odds"), sure.alias("sure"))
    rows = rows.where((F.col("odds") > 3) & (F.col("sure") > 2 * float(np.log(max(1, tried))))).collect()
    rows.sort(key=lambda r: (-r.bad * r.odds, r.feature))
    stem = lambda f: f.rstrip("*")
    families: dict[str, list[int]] = {}
    for k, r in enumerate(rows):
        families.setdefault(stem(r.feature)[:4], []).append(k)
    best = {name: max(rows[k].odds for k in ks) for name, ks in families.items()}
    pure = {name: [k for k in ks if rows[k].odds >= best[name] - PURE] for name, ks in families.items()}
    other = {name: [k for k in ks if rows[k].odds < best[name] - PURE] for name, ks in families.items()}
    voter, leads, first = np.zeros(len(rows), int), np.zeros(len(rows), bool), []

    def add(ks: list[int], way: int = -1) -> int:
        voter[ks] = len(first)
        first.append(way)
        return len(first) - 1

    names = list(families)
    for name in names[:LONE_VOTERS]:
        n = add(pure[name])
        if other[name]:
            add(other[name], n)
    for part in (pure, other):
        rest = sorted((k for name in names[LONE_VOTERS:] for k in part[name]), key=lambda k: -rows[k].odds)
        for some in np.array_split(np.array(rest, int), SHARED_VOTERS):
            if len(some):
                add(some.tolist())
    for ks in pure.values():
        stars: list[str] = []
        for k in ks:  # strongest first
            leads[k] = not any(stem(rows[k].feature).startswith(g) for g in stars)
            if rows[k].feature.endswith("*"):
                stars.append(stem(rows[k].feature))
    return Lexicon([r.feature for r in rows], np.array([r.odds for r in rows]), voter, np.array(first, int), leads)


def fire(docs: DataFrame, vocabulary: list[str], text: str = "text", keep_text: bool = True) -> DataFrame:
    """Keep every row and add ids array<int>, the numbers of the features and patterns of its text."""
    row, unpacked = kept_row(docs, ["ids"] if keep_text else ["ids", text])
    inner = docs.select(row, F.col(f"`{text}`").cast("string").alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)  # the model's features
    schema = inner.select("row").schema.add("ids", T.ArrayType(T.IntegerType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = Finder(shared.value, PATTERNS)
        for batch in batches:
            ids = pa.array([finder.fired(t.as_py()) for t in batch.column(1)], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), ids], names=["row", "ids"])

    return inner.mapInArrow(run, schema).select(*unpacked, "ids")


def moments(fired: DataFrame, lexicon: Lexicon) -> tuple[np.ndarray, int, np.ndarray, np.ndarray]:
    """Over rows (ids, toxic): joint counts of voters, the number of rows, and counts by voter in toxic and clean rows."""
    m = len(lexicon.first)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        joint, n, by = np.zeros((m, m), np.int64), 0, np.zeros((2, m), np.int64)
        for batch in batches:
            n += len(batch)
            for ids, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if ids:
                    v = lexicon.votes(ids)
                    joint[np.ix_(v, v)] += 1
                    if toxic is not None:
                        by[int(toxic == 1), v] += 1
        j, k = np.nonzero(joint)
        c, v = np.nonzero(by)
        cols = [np.concatenate(x) for x in (([-1], j, -2 - c), ([-1], k, v), ([n], joint[j, k], by[c, v]))]
        yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.int64())], names=["j", "k", "n"])

    joint, by, rows = np.zeros((m, m)), np.zeros((2, m)), 0
    for j, k, n in fired.select("ids", "toxic").mapInArrow(run, "j int, k int, n long").groupBy("j", "k").agg(F.sum("n")).collect():  # voters ** 2 at most
        if j == -1:
            rows = n
        elif j < 0:
            by[-2 - j, k] = n
        else:
            joint[j, k] = n
    return joint, rows, by[1], by[0]


@dataclass
class LabelModel:
    """P(fires | toxic), P(fires | clean) by voter, the share of toxic texts, correlations of voters."""

    prior: float
    toxic: np.ndarray
    clean: np.ndarray
    correlation: np.ndarray
    odds: np.ndarray = field(init=False)
    shared: np.ndarray = field(init=False)

    def __post_init__(self) -> None:
        strong = np.clip(self.correlation, 0, 1) * (1 - np.eye(len(self.toxic)))
        self.shared = np.where(strong > 0.2, strong, 0)
        self.odds = np.log(self.toxic / self.clean)

    def posterior(self, fired: list[int]) -> float:
        """Probability of toxic. A voter that doesn't fire abstains; correlated ones that fire share their weight."""
        discount = 1 / (1 + self.shared[np.ix_(fired, fired)].sum(axis=1))
        x = np.log(self.prior / (1 - self.prior)) + (self.odds[fired] * discount).sum()
        return float(1 / (1 + np.exp(-np.clip(x, -50, 50))))


def fit_label_model(
    joint: np.ndarray, n: int, toxic: np.ndarray, clean: np.ndarray, prior: float, rounds: int = 30, turns: int = 3
) -> LabelModel:
    """Composite-likelihood EM over the 2 x 2 tables of all pairs of voters.

    joint[j, k] counts texts where j and k fire (j = k: where j fires); n is the number of texts.
    What comes from labelled rows (toxic, clean, prior) starts the search and stays as pseudo-counts;
    rates and prior are estimated anew in each round. Correlations are those that pairs show beyond
    what the classes explain. A pair counts less the further its joint count is from what the classes
    explain, in either direction (words of two languages never meet in a text, toxic or not), so
    dependent voters neither confirm nor refute each other; that is judged anew in each turn.
    """
    m = len(toxic)
    a, b, p = toxic.copy(), clean.copy(), prior
    if not n or m < 2:
        return LabelModel(p, a, b, np.eye(m))
    single = np.diag(joint)
    cells = np.stack([joint, single[:, None] - joint, single[None, :] - joint, n - single[:, None] - single[None, :] + joint])  # 11, 10, 01, 00
    weight = 0.01 * n * (m - 1)
    explained = lambda: n * (p * np.outer(a, a) + (1 - p) * np.outer(b, b))
    for _ in range(turns):
        off = np.abs(joint - explained())
        surely = off > 3 * np.sqrt(explained() + 1)
        use = np.where(surely, 1 - off / np.maximum(joint, explained()), 1.0)
        np.fill_diagonal(use, 0)
        for _ in range(rounds):
            both = []
            for one, share in ((a, p), (b, 1 - p)):
                j, k = one[:, None], one[None, :]
                both.append(share * np.stack([j * k, j * (1 - k), (1 - j) * k, (1 - j) * (1 - k)]))
            r = both[0] / (both[0] + both[1])
            hit = (cells * r * use).sum(axis=2)  # (cell, j)
            all_ = (cells * use).sum(axis=2)
            new_a = (hit[0] + hit[1] + weight * prior * toxic) / (hit.sum(axis=0) + weight * prior)
            miss = all_ - hit
            new_b = (miss[0] + miss[1] + weight * (1 - prior) * clean) / (miss.sum(axis=0) + weight * (1 - prior))
            p = float((hit.sum() + all_.sum() * prior) / (2 * all_.sum())) if all_.sum() else prior
            a, b = np.clip(new_a, 1e-4, 0.99), np.clip(new_b, 1e-6, 0.5)
            a = np.maximum(a, 2 * b)  # a voter for toxic is better than chance
    alone = p * a + (1 - p) * b
    spread = np.sqrt(np.maximum(1e-12, np.outer(alone * (1 - alone), alone * (1 - alone))))
    correlation = np.clip((joint - explained()) / n / spread, -1, 1)
    return LabelModel(p, a, b, correlation)


@dataclass
class Classifier:
    vocabulary: list[str]
    weights: np.ndarray
    bias: float

    def score(self, fired: list[int]) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.bias + self.weights[fired].sum(), -50, 50))))


def fit_classifier(vocabulary: list[str], rows: list[tuple[list[int], float]], start: np.ndarray, l2: float = 1e-3, rounds: int = 300) -> Classifier:
    """Logistic regression on soft labels, by gradient steps with per-weight rates.

    start: log odds of a text by one feature alone, or -inf; features in few rows weigh that at least.
    """
    size = len(vocabulary) + len(PATTERNS)
    w, bias = np.zeros(size), 0.0
    if not rows:
        return Classifier(vocabulary, w, -2.0)
    owner = np.repeat(np.arange(len(rows)), [len(f) for f, _ in rows])
    ids = np.array([k for f, _ in rows for k in f], int)
    y = np.array([t for _, t in rows])
    rare = np.bincount(ids, minlength=size) < 4
    seen, seen_bias = np.full(size, 1e-8), 1e-8
    for _ in range(rounds):
        x = bias + np.bincount(owner, w[ids], minlength=len(rows))
        error = 1 / (1 + np.exp(-np.clip(x, -50, 50))) - y
        g = np.bincount(ids, error[owner], minlength=size) + l2 * len(rows) * w * 0.01
        g_bias = error.sum()
        seen, seen_bias = seen + g * g, seen_bias + g_bias**2
        w, bias = w - 0.5 * g / np.sqrt(seen), bias - 0.5 * g_bias / np.sqrt(seen_bias)
    return Classifier(vocabulary, np.where(rare, np.maximum(w, start - bias), w), float(bias))


def fold(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 5


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = 12_000, support: int = 4) -> tuple[Classifier, DataFrame]:
    """The classifier, and the written table of docs with the numbers of each text's features (ids).

    docs: doc_id, text; all columns but the text are carried (`ids` is replaced), whatever their names. Labels
    count only for documents whose crc32(doc_id) mod 5 is not 0; several labels of a document count as the largest
    one. All labelled training rows serve to find features (copies of a text share the weight of one) and
    give the classes' rates and the prior;
    about `sample_rows` of them, chosen by a hash of doc_id, train the classifier, where the leading
    features of a family weigh at least as much as their counts say if few of the sample have them. The label
    model's counts are over all documents. Null and empty texts have no features; long texts are read whole;
    repeated rows count as often as they occur. Without labels, or without rows, only the fixed entries vote.
    """
    spark, others = docs.sparkSession, set(written())
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & (fold(F.col("doc_id")) != 0)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = materialize(known, "known")
    n_known = known.count()
    training = join_small(docs.select("doc_id", "text"), known, ["doc_id"], n_known, BROADCAST_LABELS)
    lexicon = learn_lexicon(_feature_counts(_weighted(training)), support)
    fired = materialize(fire(docs, lexicon.vocabulary, keep_text=False), "fired")
    others.add(written()[-1])

    marked = fired.select("doc_id", "ids").join(known.hint("shuffle_hash"), "doc_id", "left")
    joint, n_all, bad, good = moments(marked, lexicon)
    n_toxic, n_clean = marked.select(F.count_if(F.col("toxic") == 1), F.count_if(F.col("toxic") != 1)).first()
    prior = (n_toxic + 1) / (n_toxic + n_clean + 10)
    own = np.arange(len(bad)) < lexicon.learned  # learned voters; the fixed ones also have their own expectation
    toxic = (bad + np.where(own, 0.5, 1.0)) / (n_toxic + np.where(own, 1, 20))
    clean = (good + np.where(own, 0.5, 1.0)) / (n_clean + np.where(own, 1, 1000))
    model = fit_label_model(joint, n_all, np.clip(toxic, 1e-3, 0.95), np.clip(clean, 1e-6, 0.3), prior)

    # About sample_rows rows; a share of all 63-bit hashes, so that it is as exact for any number of labels.
    sampled = F.shiftrightunsigned(F.xxhash64("doc_id"), 1) <= F.lit(min(2**63 - 1, 2**63 * sample_rows // max(1, n_known)))
    chosen = fired.select("doc_id", "ids").join(F.broadcast(known.where(sampled).select("doc_id")), "doc_id", "left_semi")
    rows = [(ids, model.posterior(lexicon.votes(ids).tolist())) for (ids,) in chosen.select("ids").collect()]  # bounded by the sample
    start = np.full(len(lexicon.of), -np.inf)
    start[: len(lexicon.odds)][lexicon.leads] = np.log(prior / (1 - prior)) + lexicon.odds[lexicon.leads]
    clear_written(spark, [f for f in written() if f not in others])  # all but the table that is returned
    return fit_classifier(lexicon.vocabulary, rows, start), fired


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = 12_000, support: int = 4) -> Classifier:
    """The classifier of fit(), for scoring other tables; the same cases hold."""
    return fit(docs, labels, sample_rows, support)[0]


def add_score(fired: DataFrame, classifier: Classifier) -> DataFrame:
    """Rows with ids in place of them a score double, as an expression."""
    weights = F.expr(f"array({', '.join(f'{float(w)!r}D' for w in classifier.weights)})")
    odds = F.aggregate("ids", F.lit(classifier.bias), lambda x, k: x + F.element_at(weights, k + 1))
    return fired.withColumn("score", 1 / (1 + F.exp(-odds))).drop("ids")


def score(docs: DataFrame, classifier: Classifier, text: str = "text") -> DataFrame:
    """Keep every row and add score double, 0 to 1.

    Null and empty texts get the score of no feature; long texts are read whole; repeated rows and texts
    with the same features score alike. Columns named score and ids are replaced, any other name is free. An empty
    table gives no rows.
    """
    return add_score(fire(docs, classifier.vocabulary, text), classifier)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A toxicity score for every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    classifier, fired = fit(docs, labels)
    scored = add_score(fired.select("doc_id", "ids"), classifier)
    return scored.select("doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents that score as toxic go.

    Columns keep their values, whatever their names. Null and empty texts stay, as no feature speaks against
    them; repeated rows share a verdict; long texts are read whole; rows without an id are only scored, never
    trained on. An empty table gives no rows.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    row, unpacked = kept_row(docs)
    classifier, fired = fit(docs.select(row, F.col("doc_id"), F.col("text")), labels)
    return add_score(fired.select("row", "ids"), classifier).where("score < 0.5").select(*unpacked)
