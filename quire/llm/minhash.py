"""Operator 11, MinHash near-duplicate detection with min-max signatures.

Texts are sets of hashed word shingles, and equal sets form a class. Each of `hashes` random permutations
of the shingles is evaluated once and gives two values of the signature, the least and the greatest: both
agree between two sets with a chance equal to their similarity, and as they hardly ever agree for the
same reason, the share of values that agree is an unbiased estimate with less variance than as many
least values would give, for half the evaluations. Bands of `rows` values of one kind are the
buckets' keys; classes that share a bucket and whose signatures agree often enough are compared on
whole sets.

A bucket of few classes gives all its pairs. For classes in crowded ones it is counted which of their
shingles no other such class has: these bound every overlap, so texts that only share a passage drop out, and
the class with the fewest is the middle of its group. In a crowded bucket the classes are linked to one such
pivot, verified and merged, with other pivots from turn to turn, so a large group of copies costs about one comparison a
member and bucket. Pairs left between different components are found by prefixes of their sets in order
of rarity, which rule out most of a group's outsiders without a comparison.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.llm.common import clear_written, materialize, shuffle_partitions, written
from quire.llm.jaccard import Threshold, _class_of, _members, _relabel, _verified
from quire.llm.shingles import mix, shingle_sets

_U = np.uint64
#: Buckets with more classes than this are crowded.
CROWD = 32
#: Rows of a crowded bucket that one group of the last step takes.
GROUP = 4 * CROWD
#: Shingles whose permutations are worked out at once.
BLOCK = 1 << 16


@dataclass(frozen=True)
class MinMax:
    """Signatures of 2 * hashes values in bands of `rows`.

    With 80 permutations and bands of 5, two sets at similarity 0.85 share none of the 32 bands with a
    chance of 7 in 10**9, and more alike ones with less.
    """

    hashes: int = 80
    rows: int = 5
    seed: int = 1

    @property
    def bands(self) -> int:
        return 2 * self.hashes // self.rows

    def least_agreeing(self, limit: Threshold) -> int:
        """Values that surely agree at the threshold: the mean less six standard deviations."""
        values, share = 2 * self.hashes, limit.num / limit.den
        return int(values * share - 6 * (values * share * (1 - share)) ** 0.5)

    def permutations(self) -> tuple[np.ndarray, np.ndarray]:
        """A mask and an odd factor for each permutation of the 64-bit numbers."""
        draws = np.random.default_rng(self.seed).integers(0, 1 << 64, (2, self.hashes), dtype=np.uint64)
        return draws[0], draws[1] | _U(1)

    def sign(self, sets: list[np.ndarray]) -> np.ndarray:
        """One row of values for each non-empty set: all least ones, then all greatest ones."""
        masks, factors = self.permutations()
        found = np.empty((len(sets), 2 * self.hashes), _U)
        at = 0
        while at < len(sets):
            stop, held = at, 0
            while stop < len(sets) and (stop == at or held + len(sets[stop]) <= BLOCK):
                held += len(sets[stop])
                stop += 1
            items = np.concatenate(sets[at:stop])
            starts = np.cumsum([0, *(len(s) for s in sets[at : stop - 1])])
            drawn = np.empty_like(items)
            with np.errstate(over="ignore"):
                for j in range(self.hashes):
                    np.multiply(np.bitwise_xor(items, masks[j], out=drawn), factors[j], out=drawn)
                    found[at:stop, j] = np.minimum.reduceat(drawn, starts)
                    found[at:stop, self.hashes + j] = np.maximum.reduceat(drawn, starts)
            at = stop
        return found

    def keys(self, values: np.ndarray) -> np.ndarray:
        """The bucket keys of each row of values, one a band."""
        with np.errstate(over="ignore"):
            weights = mix(np.arange(1, self.rows + 1, dtype=_U) * _U(0x9E3779B97F4A7C15)) | _U(1)
            bands = values.reshape(len(values), self.bands, self.rows) * weights
            return mix(bands.sum(axis=2, dtype=_U) + np.arange(self.bands, dtype=_U))

    def short(self, values: np.ndarray) -> np.ndarray:
        """One byte of each value; bytes of different values agree with a chance of 1 in 256."""
        return (mix(values) >> _U(56)).astype(np.uint8)


def signatures(docs: DataFrame, size: int, scheme: MinMax) -> DataFrame:
    """doc_id, cls, n (set size), and for the first row of a class in each task keys and short, as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            names, sizes, fresh, places = [], [], [], []
            for k, items in enumerate(shingle_sets(batch.column(1), size)):
                name = _class_of(items)
                names.append(name)
                sizes.append(len(items))
                if len(items) and name not in seen:
                    seen.add(name)
                    fresh.append(items)
                    places.append(k)
            keys: list[bytes | None] = [None] * len(names)
            short: list[bytes | None] = [None] * len(names)
            if fresh:
                values = scheme.sign(fresh)
                for place, a, b in zip(places, scheme.keys(values), scheme.short(values)):
                    keys[place], short[place] = a.tobytes(), b.tobytes()
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(names, pa.int64()), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), pa.array(short, pa.binary())],
                names=["doc_id", "cls", "n", "keys", "short"],
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, cls long, n long, keys binary, short binary")


def _buckets(classes: DataFrame, bands: int) -> DataFrame:
    """(key, cls, n, k) for the buckets of k > 1 classes.

    Entries are cut into even ranges of (key, class) and sorted there, so that a bucket of any size is spread
    over tasks, and an entry whose neighbours have other keys goes at once.
    """

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in filter(len, batches):
            keys = np.concatenate([np.frombuffer(k.as_buffer(), np.int64) for k in batch.column(2)])
            cls, n = (np.repeat(batch.column(c).to_numpy(), bands) for c in (0, 1))
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(cls), pa.array(n)], names=["key", "cls", "n"])

    def shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in filter(len, batches):
            keys = batch.column(0).to_numpy()
            same = keys[1:] == keys[:-1]
            # The neighbours of a batch's first and last rows are not known here.
            yield batch.filter(pa.array(np.concatenate([[True], same]) | np.concatenate([same, [True]])))

    spark = classes.sparkSession
    rows = classes.mapInArrow(entries, "key long, cls long, n long").repartitionByRange(shuffle_partitions(spark), "key", "cls")
    rows = materialize(rows.sortWithinPartitions("key", "cls").mapInArrow(shared, "key long, cls long, n long"), "entries")
    sizes = rows.groupBy("key").agg(F.count("*").alias("k")).where("k > 1")
    return materialize(rows.join(sizes, "key"), "buckets")


def _alike(pairs: DataFrame, classes: DataFrame, least: int) -> DataFrame:
    """The pairs (a, b) whose signatures agree in at least so many values."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(batch.num_rows, -1) for c in (2, 3))
            yield batch.select(["a", "b"]).filter(pa.array((a == b).sum(axis=1) >= least))

    side = lambda c: classes.select(F.col("cls").alias(c), F.col("short").alias(f"{c}_short"))
    joined = pairs.join(side("a"), "a").join(side("b"), "b")
    return joined.select("a", "b", "a_short", "b_short").where("a_short is not null").mapInArrow(run, "a long, b long")


def _sized(limit: Threshold, a: str, b: str) -> Column:
    """Sets whose sizes are too far apart cannot be linked."""
    return F.expr(f"{limit.den} * least({a}, {b}) >= {limit.num} * greatest({a}, {b})")


def _possible(limit: Threshold, a_n: str, b_n: str, common: str) -> Column:
    """Sets of these sizes with an overlap of at most `common` may be linked."""
    return F.expr(f"{limit.num + limit.den} * least({common}, {a_n}, {b_n}) >= {limit.num} * ({a_n} + {b_n})")


def _few_pairs(buckets: DataFrame, limit: Threshold) -> DataFrame:
    """All pairs (a, b) of classes that meet in buckets of few, once each."""
    held = buckets.where(F.col("k") <= CROWD).groupBy("key").agg(F.sort_array(F.collect_list(F.struct("cls", "n"))).alias("all"))
    rest = F.posexplode("all").alias("place", "x")
    first = held.select("all", rest).select(F.col("x.cls").alias("a"), F.col("x.n").alias("n"), F.explode(F.expr("slice(all, place + 2, size(all))")).alias("y"))
    return first.where(_sized(limit, "n", "y.n")).select("a", F.col("y.cls").alias("b")).distinct()


def _items(members: DataFrame, classes: DataFrame) -> DataFrame:
    """(cls, item): the shingles of these classes (cls)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in filter(len, batches):
            sets = [np.frombuffer(s.as_buffer(), np.int64) for s in batch.column(1)]
            cls = np.repeat(batch.column(0).to_numpy(), [len(s) for s in sets])
            yield pa.RecordBatch.from_arrays([pa.array(cls), pa.array(np.concatenate(sets))], names=["cls", "item"])

    return members.join(classes, "cls", "left_semi").mapInArrow(run, "cls long, item long")


def _common(crowded: DataFrame, members: DataFrame) -> DataFrame:
    """crowded (key, cls, n) with m, how many of the class's shingles another class in crowded buckets has too.

    No overlap with one of them is larger than m.
    """
    items = _items(members, crowded.select("cls").distinct())
    own = items.groupBy("item").agg(F.count("*").alias("k"), F.min("cls").alias("cls")).where("k = 1").groupBy("cls").agg(F.count("*").alias("own"))
    return crowded.join(own, "cls", "left").select("key", "cls", "n", (F.col("n") - F.coalesce("own", F.lit(0))).alias("m"))


def _rest(held: DataFrame, members: DataFrame, limit: Threshold) -> DataFrame:
    """(a, b): classes of different components that may still be linked, by prefixes of shingles in order of rarity.

    held: cls, n, m, comp, ... of classes in crowded buckets. Shingles of one class only come first and find no one, so a
    class with many of its own has hardly an entry left. The smaller set's entry must be in its shorter index
    prefix, and what follows a shared entry must be enough. A shingle's classes are dealt over the more groups the
    more they are.
    """
    num, den = limit.num, limit.den
    classes = materialize(held.select("cls", "n", "m", "comp").distinct(), "outside")
    items = _items(members, classes.select("cls"))
    counts = items.groupBy("item").agg(F.count("*").alias("k")).where("k > 1")
    place = F.row_number().over(Window.partitionBy("cls").orderBy("k", "item")) - 1
    entries = items.join(counts, "item").withColumn("place", place).join(classes, "cls").withColumn("place", F.expr("place + n - m"))
    probe, index = f"n - ({num} * n + {den - 1}) div {den}", f"n - (2 * {num} * n + {num + den - 1}) div {num + den}"
    entries = materialize(entries.where(f"place <= {probe}").withColumn("first", F.expr(f"place <= {index}")), "prefixes")
    groups = F.expr(f"cast(1 + k div {GROUP} as int)")
    side = lambda s, salt: entries.withColumn("salt", salt).select("item", "salt", "first", *(F.col(c).alias(f"{s}_{c}") for c in ("cls", "n", "place", "comp")))
    a = side("a", F.explode(F.sequence(F.lit(0), groups - 1))).where("first").drop("first")
    b = side("b", F.pmod(F.xxhash64("cls"), groups).cast("int")).drop("first")
    enough = f"{den} * a_n >= {num} * b_n and {num + den} * least(a_n - a_place, b_n - b_place) >= {num} * (a_n + b_n)"
    met = a.join(b, ["item", "salt"]).where("a_comp <> b_comp and (a_n < b_n or (a_n = b_n and a_cls < b_cls))").where(enough)
    return met.select(F.col("a_cls").alias("a"), F.col("b_cls").alias("b")).distinct()


def _turn(held: DataFrame, step: int) -> DataFrame:
    """Per key its largest component (main), a pivot in it, its classes, their least size, and the pairs left between components.

    The first pivot is the most central class; in later turns chance has a say.
    """
    chance = F.pmod(F.xxhash64("cls", F.lit(step)), F.lit(1000)) * min(step, 1)
    central = (F.col("m") / F.col("n") * (1000 + chance)).alias("central")
    by_comp = held.groupBy("key", "comp").agg(F.count("*").alias("k"), F.min("n").alias("low"), F.max(F.struct(central, "cls", "n", "m")).alias("lead"))
    largest = by_comp.groupBy("key").agg(
        F.max(F.struct("k", "lead", "comp")).alias("main"), F.sum("k").alias("k"), F.sum(F.col("k") * F.col("k")).alias("kk"), F.min("low").alias("low")
    )
    lead = [F.col(f"main.lead.{c}").alias(f"pivot{end}") for c, end in (("cls", ""), ("n", "_n"), ("m", "_m"))]
    return largest.select("key", F.col("main.comp").alias("main"), *lead, "k", "low", F.expr("(k * k - kk) div 2").alias("left"))


def link_classes(
    docs: DataFrame, found: DataFrame, size: int, limit: Threshold, scheme: MinMax, patience: float = 0.005, rounds: int = 4
) -> DataFrame:
    """(cls, comp) of classes that may be linked to others: equal comp means connected by links.

    found: what `signatures` gave, as a written table. Classes that are missing are linked to none.
    """
    others, least = set(written()), scheme.least_agreeing(limit)

    def merged(labels: DataFrame, pairs: DataFrame, stars: bool = False) -> tuple[DataFrame, str]:
        labels = _relabel(labels, materialize(_verified(pairs, members, limit, stars), "links"))
        return labels, written()[-1]

    # One row a class: each task sent its own, so these are few where copies are many.
    classes = materialize(found.where("keys is not null").select("cls", "n", "keys", "short").dropDuplicates(["cls"]), "classes")
    buckets = _buckets(classes.select("cls", "n", "keys"), scheme.bands)
    crowded = materialize(buckets.where(F.col("k") > CROWD).select("key", "cls", "n"), "crowded")
    pairs = materialize(_alike(_few_pairs(buckets, limit), classes, least), "pairs")
    wanted = materialize(pairs.select(F.col("a").alias("cls")).union(pairs.select("b")).union(crowded.select("cls")).distinct(), "wanted")
    bits = min(26, max(16, (16 * wanted.count()).bit_length()))  # of a map that lets tasks skip most other texts
    members = materialize(_members(docs, size, wanted, bits), "members")
    labels, folder = merged(wanted.select("cls", F.col("cls").alias("comp")), pairs)
    crowded = materialize(_common(crowded, members).where(f"{limit.den} * m >= {limit.num} * n"), "central")
    total, before = crowded.count(), 0
    for step in range(rounds + 1):
        held = materialize(crowded.join(labels, "cls"), "held")
        turn = materialize(_turn(held, step), "turn")
        left = turn.agg(F.sum("left")).first()[0] or 0
        outside = held.join(turn.where("left > 0"), "key").where("comp <> main").where(_possible(limit, "n", "greatest(low, m)", "m"))
        if left <= patience * total or step == rounds or (step > 1 and left > 0.9 * before):
            break
        before = left
        stars = outside.where(_possible(limit, "n", "pivot_n", "least(m, pivot_m)")).select(F.col("pivot").alias("a"), F.col("cls").alias("b")).distinct()
        labels, folder = merged(labels, materialize(_alike(stars, classes, least), "stars"), stars=True)
    if left:
        rest = _rest(held, members, limit)
        labels, folder = merged(labels, materialize(_alike(rest, classes, least), "rest"))
    clear_written(docs.sparkSession, [f for f in written() if f not in others and f != folder])
    return labels


def near_duplicates(docs: DataFrame, size: int = 3, limit: Threshold = Threshold(17, 20), scheme: MinMax = MinMax()) -> DataFrame:
    """doc_id, n_shingles, class_size (rows with its set), component_id, kept: one row for each row of docs.

    Words are parted at ASCII space characters, A-Z lower-cased; a set holds the distinct shingles of
    `size` words, or the whole sequence if it has fewer. Documents whose sets reach the threshold are
    linked; component_id is the smallest doc_id reachable by links, and the document of that id is kept.
    Texts that are null or have no word have an empty set and stand alone. Rows with null doc_id link
    like others but never give the component's id; where no row of a component has one, all are kept.
    Repeated rows stay as they are, each with the same answer. Texts of any length are read whole, other columns of docs
    ignored, an empty table gives no rows. Links are confirmed on whole sets of 64-bit hashes; a
    pair at the threshold is found with the chance that MinMax states.
    """
    found = materialize(signatures(docs, size, scheme), "signatures")
    labels = link_classes(docs, found, size, limit, scheme)
    rows = found.select("doc_id", "cls", "n")
    classes = rows.where("n > 0").groupBy("cls").agg(F.min("doc_id").alias("low"), F.count("*").alias("class_size")).join(labels, "cls", "left")
    classes = classes.where("class_size > 1 or comp is not null").withColumn("comp", F.coalesce("comp", "cls"))
    classes = materialize(classes, "classes")
    lows = classes.groupBy("comp").agg(F.min("low").alias("component"))
    named = classes.join(lows, "comp").select("cls", "class_size", "component")
    joined = rows.join(named, "cls", "left")  # a class of very many rows is split by adaptive execution
    alone = (F.col("n") == 0) | F.col("class_size").isNull()
    component = F.when(alone, F.col("doc_id")).otherwise(F.col("component"))
    return joined.select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.when(alone, F.lit(1)).otherwise(F.col("class_size")).cast("long").alias("class_size"),
        component.alias("component_id"),
        F.col("doc_id").eqNullSafe(component).alias("kept"),
    )


def op11_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Set size and component of every document, by three-word shingles and a similarity of 0.85."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return near_duplicates(docs).select("doc_id", "n_shingles", "component_id", "kept")
