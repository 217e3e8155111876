"""Operator 3, n-gram Jaccard join with adaptive multi-match prefixes.

Texts are sets of hashed word shingles. Equal sets form a class, and all else is between classes.
Shingles have one global order: by hash, but shingles that a sketch over all documents counts as
frequent come last, by that count. If two sets reach the threshold, then for any l the first l
shingles they share lie within known prefixes of both, so each set takes the l that makes its
estimated cost (prefix entries to scan, and candidates to verify) least, and a pair is verified
only if its prefixes share at least the smaller of the two l.

Of two sets the smaller one's entry must lie in its shorter index prefix. The frequent shingles of
a template, last in order, mostly stay out of it, so texts that share a template but are no near
copies rarely meet there.

Large groups of copies would still give all their pairs. So while the classes that share prefix shingles
would give many more pairs than entries, each such shingle links its classes to one pivot only;
those pairs are verified, and what they join needs no further pairs inside. The last step takes
all pairs that are left between different components, and so misses none. Crowded shingles and their
pivots are spread over groups in every join, so that none of them is the work of one task.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.common import by_shuffle, clear_written, kept_row, materialize, written
from quire.llm.components import components
from quire.llm.shingles import overlap, shingle_sets

#: Shingles in more prefixes than this are crowded: groups of copies show there first.
CROWD = 32
#: Each of the sketch's two tables has 2**SKETCH_BITS counts.
SKETCH_BITS = 18
#: Frequent shingles are spread over this many groups where only their presence counts.
SALT = 64
#: Crowded shingles and pivots are spread over this many groups in joins.
SPREAD = 16


@dataclass(frozen=True)
class Threshold:
    """Jaccard similarity of at least num / den."""

    num: int = 3
    den: int = 4

    def probe(self, n):
        """Entries of a set of n before its last ceil(t * n), for meeting smaller sets."""
        return n - -(-self.num * n // self.den)

    def index(self, n):
        """The same for meeting sets that are not smaller."""
        return n - -(-2 * self.num * n // (self.num + self.den))

    def linked(self, common: int, a: int, b: int) -> bool:
        return self.den * common >= self.num * (a + b - common)


def _class_of(items: np.ndarray) -> int:
    """A signed 64-bit name of a set."""
    return xxhash.xxh3_64_intdigest(items.tobytes(), seed=len(items)) - (1 << 63)


def _signatures(docs: DataFrame, size: int, bits: int) -> DataFrame:
    """Per document its text's hash, class and set size; and per task, in other rows, the sketch's counts.

    The sketch has two tables of 2**bits counts, by the first and by the last bits of a shingle's
    hash. Copies within a task count once in it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch, seen = np.zeros(2 << bits, np.int64), set()
        for batch in batches:
            names, sizes = [], []
            for items in shingle_sets(batch.column(1), size):
                name = _class_of(items)
                names.append(name)
                sizes.append(len(items))
                if name not in seen:
                    seen.add(name)
                    for cells in _cells(items, bits):
                        np.add.at(sketch, cells, 1)
            none = pa.nulls(len(names), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(names, pa.int64()), pa.array(sizes, pa.int64()), none, pa.nulls(len(names), pa.int64())], names=_SIG
            )
        for at in range(0, 2 << bits, 1 << 16):
            k = np.flatnonzero(sketch[at : at + (1 << 16)]) + at
            none = pa.nulls(len(k), pa.int64())
            yield pa.RecordBatch.from_arrays([none, none, none, none, pa.array(k, pa.int32()), pa.array(sketch[k])], names=_SIG)

    text = F.col("text").cast("string")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("text_key"))
    return rows.mapInArrow(run, "doc_id long, text_key long, cls long, n long, bucket int, hits long")


_SIG = ["doc_id", "text_key", "cls", "n", "bucket", "hits"]


def _cells(items: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Where a shingle counts in the two tables of the sketch."""
    low = (items & np.uint64((1 << bits) - 1)).astype(np.int64)
    return (items >> np.uint64(64 - bits)).astype(np.int64), low + (1 << bits)


class _Order:
    """The global order of shingles: by hash, frequent ones last by their count.

    A shingle counts as frequent if both its cells hold far more than the mean; its count is the
    smaller one's excess.
    """

    def __init__(self, bits: int, cells: np.ndarray, excess: np.ndarray, total: int):
        self.bits, self.cells, self.excess, self.total = bits, cells, excess, total

    def arrange(self, items: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The items in order, and the estimated number of sets with each of them beyond one."""
        more = np.zeros(len(items), np.int64)
        if len(self.cells):
            both = []
            for b in _cells(items, self.bits):
                at = np.minimum(np.searchsorted(self.cells, b), len(self.cells) - 1)
                both.append(np.where(self.cells[at] == b, self.excess[at], 0))
            more = np.minimum(*both)
            if more.any():
                order = np.lexsort((items, more))
                return items[order], more[order]
        return items, more


def shingle_order(signatures: DataFrame, bits: int) -> _Order:
    """The order from the sketch's counts; only frequent cells come to the driver."""
    counted = signatures.where("bucket is not null")
    total = (counted.agg(F.sum("hits")).first()[0] or 0) // 2  # shingles in all sets
    load = total / (1 << bits)
    often = counted.groupBy("bucket").agg(F.sum("hits").alias("hits")).where(F.col("hits") > load + 6 * load**0.5 + 4).orderBy("bucket").toArrow()
    return _Order(bits, often.column("bucket").to_numpy().astype(np.int64), often.column("hits").to_numpy() - int(load), total)


#: Share of shingles that some other set has, beyond what the sketch shows; only weighs costs.
BACKGROUND = 0.05


def choose_matches(excess: np.ndarray, probe: int, index: int) -> int:
    """How many shared prefix shingles to ask for: the number with the least estimated cost.

    Asking for l makes both prefixes longer by l. The cost is the entries, the entries of others that
    the index prefix meets, and verifying candidates: each candidate needs l of the met entries, and
    verifying one moves two whole sets. At most a sixteenth of the set is asked for.
    """
    n = len(excess)
    met = np.concatenate([[0.0], np.cumsum(excess + BACKGROUND)])
    asked = np.unique(np.maximum(1, (n // 16) >> np.arange(8)))
    seen = met[np.minimum(n, index + asked)]
    return int(asked[np.argmin(np.minimum(n, probe + asked) + seen + seen / asked * 2 * n)])


def _entries(docs: DataFrame, size: int, limit: Threshold, order: _Order) -> DataFrame:
    """Prefix entries of each class: token, cls, n, pos, need (shared entries asked for), idx (in the index prefix), crowded."""
    shared = docs.sparkSession.sparkContext.broadcast(order)  # frequent buckets only

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order, seen = shared.value, set()
        cols: list[list[np.ndarray]] = [[] for _ in range(4)]
        held = 0

        def out() -> pa.RecordBatch:
            arrays = [pa.array(np.concatenate(c)) for c in cols]
            for c in cols:
                c.clear()
            return pa.RecordBatch.from_arrays(arrays, names=["token", "cls", "shape", "place"])

        for batch in batches:
            for items in shingle_sets(batch.column(0), size):
                n = len(items)
                name = _class_of(items)
                if not n or name in seen:
                    continue
                seen.add(name)
                tokens, excess = order.arrange(items)
                need = choose_matches(excess, limit.probe(n), limit.index(n))
                length = min(n, limit.probe(n) + need)
                cols[0].append(tokens[:length].view(np.int64))
                cols[1].append(np.full(length, name))
                cols[2].append(np.full(length, (n << 31) | need))
                cols[3].append((np.arange(length) << 1) | (excess[:length] > 0))
                held += length
                if held > 200_000:
                    yield out()
                    held = 0
        if held:
            yield out()

    packed = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "token long, cls long, shape long, place long")
    # Only shingles that two classes hold in their prefixes go on. Frequent ones surely are, so they
    # need not meet in one task: their classes are spread over groups.
    often = F.col("place").bitwiseAND(1) == 1
    salted = packed.withColumn("salt", F.when(often, F.pmod(F.xxhash64("cls"), F.lit(SALT))).otherwise(F.lit(0)))
    once = salted.repartition("token", "salt").dropDuplicates(["token", "salt", "cls"])
    rows = once.select(
        "token",
        "salt",
        "cls",
        F.shiftright("shape", 31).alias("n"),
        F.shiftright("place", 1).alias("pos"),
        F.col("shape").bitwiseAND((1 << 31) - 1).alias("need"),
        often.alias("often"),
    )
    index = f"n - (2 * {limit.num} * n + {limit.num + limit.den - 1}) div {limit.num + limit.den}"
    rows = rows.withColumn("idx", F.expr(f"pos < {index} + need"))
    counted = rows.withColumns({"k": F.expr("count(*) over (partition by token, salt)"), "ki": F.expr("count_if(idx) over (partition by token, salt)")})
    met = ((F.col("k") > 1) & (F.col("ki") > 0)) | F.col("often")
    return counted.where(met).select("token", "cls", "n", "pos", "need", "idx", ((F.col("k") > CROWD) | F.col("often")).alias("crowded"))


def _members(docs: DataFrame, size: int, classes: DataFrame, bits: int = 22) -> DataFrame:
    """The whole sets of the wanted classes: cls, items (sorted hashes), one row each.

    A bit map of fixed size, filled from the classes where they are, lets each task skip most other
    documents; a join then takes exactly the wanted ones.
    """
    spark = docs.sparkSession
    low = F.pmod("cls", F.lit(1 << bits))
    words = classes.groupBy(F.shiftright(low, 5).alias("w")).agg(F.expr("bit_or(shiftleft(1L, cast(pmod(cls, 32) as int)))").alias("b"))
    table = words.toArrow()  # at most 2**bits / 32 rows
    bitmap = np.zeros(max(1, (1 << bits) // 32), np.uint32)
    bitmap[table.column("w").to_numpy()] = table.column("b").to_numpy().astype(np.uint32)
    shared = spark.sparkContext.broadcast(bitmap)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap, seen = shared.value, set()
        for batch in batches:
            names, sets, held = [], [], 0
            for items in shingle_sets(batch.column(0), size):
                if not len(items):
                    continue
                name = _class_of(items)
                low = name % (1 << bits)
                if name not in seen and (int(bitmap[low >> 5]) >> (low & 31)) & 1:
                    seen.add(name)
                    names.append(name)
                    sets.append(items.tobytes())
                    held += len(items)
                    if held > 500_000:
                        yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(sets, pa.binary())], names=["cls", "items"])
                        names, sets, held = [], [], 0
            if names:
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(sets, pa.binary())], names=["cls", "items"])

    found = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "cls long, items binary")
    # A class comes once from a task at most, however many copies it has; whole sets are exchanged once, for both steps.
    return found.dropDuplicates(["cls"]).join(by_shuffle(classes), "cls", "left_semi")


def _sifted(pairs: DataFrame, members: DataFrame, limit: Threshold) -> DataFrame:
    """The pairs (a, b) of classes that 16 bits of each shingle don't rule out: a quarter of what their sets would move.

    Shared shingles have equal bits, so at least as many shingles of a as they share have bits that are in b: no link is lost.
    """

    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            low = [np.frombuffer(s.as_buffer(), np.uint64).astype(np.uint16).tobytes() for s in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(low, pa.binary())], names=["cls", "bits"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        there = np.zeros(1 << 16, bool)
        for batch in batches:
            keep = []
            for k, (x, y) in enumerate(zip(batch.column(2), batch.column(3))):
                a, b = (np.frombuffer(s.as_buffer(), np.uint16) for s in (x, y))
                there[b] = True
                if limit.linked(int(there[a].sum()), len(a), len(b)):
                    keep.append(k)
                there[b] = False
            yield batch.select(["a", "b"]).take(pa.array(keep, pa.int64()))

    marks = members.select("cls", "items").mapInArrow(bits, "cls long, bits binary")
    side = lambda c: marks.select(F.col("cls").alias(c), F.col("bits").alias(f"{c}_bits"))
    joined = pairs.select("a", "b").join(side("a"), "a").join(side("b"), "b")
    return joined.select("a", "b", "a_bits", "b_bits").mapInArrow(run, "a long, b long")


def _verified(pairs: DataFrame, members: DataFrame, limit: Threshold, stars: bool = False) -> DataFrame:
    """The pairs (a, b) of classes that reach the threshold; with stars=True few classes are a, some very often."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for k, (x, y) in enumerate(zip(batch.column(2), batch.column(3))):
                a, b = (np.frombuffer(s.as_buffer(), np.uint64) for s in (x, y))
                if limit.linked(overlap(a, b), len(a), len(b)):
                    keep.append(k)
            yield batch.select(["a", "b"]).take(pa.array(keep, pa.int64()))

    side = lambda c: members.select(F.col("cls").alias(c), F.col("items").alias(f"{c}_items"))
    if stars:
        pivots = side("a").join(pairs.select("a").distinct(), "a", "left_semi")
        joined = _spread_join(pairs.select("a", "b"), pivots, "a", "b").join(side("b"), "b")
    else:
        joined = pairs.select("a", "b").join(side("a"), "a").join(side("b"), "b")
    return joined.select("a", "b", "a_items", "b_items").mapInArrow(run, "a long, b long")


def _spread_join(many: DataFrame, few: DataFrame, key: str, part: str) -> DataFrame:
    """Join on a key that many rows share: they are dealt over groups by `part`, and each of the few rows is in every group."""
    left = many.withColumn("salt", F.pmod(F.xxhash64(part), F.lit(SPREAD)).cast("int"))
    right = few.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1))))
    return left.join(by_shuffle(right), [key, "salt"]).drop("salt")


def _relabel(labels: DataFrame, links: DataFrame) -> DataFrame:
    """labels (cls, comp) after joining the components that links (a, b) of classes connect."""
    to = lambda c: labels.select(F.col("cls").alias(c), F.col("comp").alias(f"{c}_comp"))
    edges = links.join(by_shuffle(to("a")), "a").join(by_shuffle(to("b")), "b").select(F.col("a_comp").alias("a"), F.col("b_comp").alias("b"))
    roots = components(edges).select(F.col("node").alias("comp"), "root")
    joined = labels.join(by_shuffle(roots), "comp", "left").select("cls", F.coalesce("root", "comp").alias("comp"))
    return materialize(joined, "labels")


def _star_round(crowded: DataFrame, labels: DataFrame, members: DataFrame, limit: Threshold, step: int) -> DataFrame:
    """Labels after linking the classes of each crowded shingle to one pivot of theirs.

    The pivot is a class with many crowded shingles in its prefix, so with few of its own: it is
    likely central to its group. Which of these it is changes from step to step.
    """
    chance = F.pmod(F.xxhash64("cls", F.lit(step)), F.lit(1000))
    shapes = crowded.groupBy("cls", "n", "need").agg((F.count("*") * (2000 + chance)).alias("weight")).join(by_shuffle(labels), "cls")
    held = crowded.select("token", "cls").join(by_shuffle(shapes.select("cls", "weight")), "cls")
    pivots = held.groupBy("token").agg(F.max_by("cls", F.struct("weight", "cls")).alias("a"))
    about = lambda side: shapes.select(*(F.col(c).alias(d) for c, d in zip(("cls", "n", "need", "comp"), (side, f"{side}_n", f"{side}_need", f"{side}_comp"))))
    stars = _spread_join(crowded.select("token", F.col("cls").alias("b")), pivots, "token", "b").groupBy("a", "b").agg(F.count("*").alias("shared"))
    chosen = about("a").join(pivots.select("a").distinct(), "a", "left_semi")
    pairs = _spread_join(stars.where("a <> b").join(by_shuffle(about("b")), "b"), chosen, "a", "b")
    fit = limit.den * F.least("a_n", "b_n") >= limit.num * F.greatest("a_n", "b_n")
    pairs = pairs.where((F.col("a_comp") != F.col("b_comp")) & fit & (F.col("shared") >= F.least("a_need", "b_need")))
    return _relabel(labels, materialize(_verified(pairs, members, limit, stars=True), "links"))


def link_classes(
    docs: DataFrame, signatures: DataFrame, size: int, limit: Threshold, bits: int = SKETCH_BITS, patience: float = 0.005, rounds: int = 4
) -> DataFrame:
    """(cls, comp) of classes that are linked to others: equal comp means connected by links.

    Classes that are missing are linked to none.
    """
    spark, others = docs.sparkSession, set(written())
    order = shingle_order(signatures, bits)
    total = order.total
    entries = materialize(_entries(docs, size, limit, order), "entries")
    crowded = materialize(entries.where("crowded").drop("crowded"), "crowded")
    labels = materialize(crowded.select("cls", F.col("cls").alias("comp")).distinct(), "labels")
    members, before = None, 0
    for step in range(rounds + 1):
        by_comp = crowded.select("token", "cls", "idx").join(by_shuffle(labels), "cls").groupBy("token", "comp").agg(F.count("*").alias("k"), F.count_if("idx").alias("ki"))
        largest = F.max(F.struct("k", "comp", "ki")).alias("m")
        main = by_comp.groupBy("token").agg(largest, F.sum("k").alias("k"), F.sum("ki").alias("ki"))
        main = materialize(main.select("token", F.col("m.comp").alias("main"), "k", F.expr("(ki - m.ki) * k + m.ki * (k - m.k)").alias("left")), "main")
        left = main.agg(F.sum("left")).first()[0] or 0
        if left <= patience * total or step == rounds or (step > 1 and left > 0.9 * before):
            break
        before = left
        if members is None:
            near = crowded.groupBy("cls", "need").count().where("count >= need").select("cls")
            members = materialize(_members(docs, size, near), "members")
        labels = _star_round(crowded, labels, members, limit, step)
    # All pairs left: in a crowded shingle those with a class outside of its main component.
    none = F.lit(None).cast("long")
    known = _spread_join(crowded.join(by_shuffle(labels), "cls"), main.where(F.col("left") > 0).select("token", "main", "k"), "token", "cls")
    plain = entries.where("not crowded").drop("crowded").withColumns({"comp": F.col("cls"), "main": none, "k": F.lit(1).cast("long")})
    rows = known.select(*plain.columns).unionByName(plain)
    outside = F.col("main").isNull() | (F.col("comp") != F.col("main"))
    # A shingle's classes are dealt over the more groups the more they are.
    groups = F.expr(f"cast(greatest(1, least({SPREAD}, k div {4 * CROWD})) as int)")
    once, copies = F.pmod(F.xxhash64("cls"), groups).cast("int"), F.explode(F.sequence(F.lit(0), groups - 1))
    # Sets whose sizes are too far apart don't meet: b is in the size class of a or in the next one.
    ratio = 1.05 * limit.den / limit.num
    size_class = F.floor(F.log(F.col("n").cast("double")) / float(np.log(ratio))).cast("int")

    def side(df: DataFrame, s: str, salt) -> DataFrame:
        df = df.withColumn("salt", salt).withColumn("size_class", F.explode(F.array(size_class, size_class + 1)) if s == "a" else size_class)
        return df.select(*on, *(F.col(c).alias(f"{s}_{c}") for c in ("cls", "n", "pos", "need", "comp")))

    on = ["token", "salt", "size_class"]
    meets = F.expr(_meets(limit))
    met = side(rows.where(outside & F.col("idx")), "a", copies).join(by_shuffle(side(rows, "b", once)), on).where(meets)
    inner = side(known.where(~outside & F.col("idx")), "a", once).join(by_shuffle(side(known.where(outside), "b", copies)), on).where(meets)
    found = met.unionByName(inner).groupBy("a_cls", "b_cls", "a_n", "b_n", "a_need", "b_need").agg(
        F.count("*").alias("shared"), F.min("a_pos").alias("a_pos"), F.min("b_pos").alias("b_pos")
    )
    num, den = limit.num, limit.den
    enough = f"shared >= least(a_need, b_need) and {num + den} * least(a_n - a_pos, b_n - b_pos) >= {num} * (a_n + b_n)"
    pairs = materialize(found.where(enough).select(F.col("a_cls").alias("a"), F.col("b_cls").alias("b")), "pairs")
    met_classes = pairs.select(F.col("a").alias("cls")).union(pairs.select("b")).distinct()
    labels = materialize(labels.where("cls <> comp").join(met_classes.withColumn("m", F.lit(1)), "cls", "full_outer").select("cls", F.coalesce("comp", "cls").alias("comp")).union(labels.where("cls <> comp").select("comp", "comp")).distinct(), "labels")
    members = materialize(_members(docs, size, met_classes), "members")
    # Most pairs are no links: those go before whole sets are moved.
    labels = _relabel(labels, materialize(_verified(_sifted(pairs, members, limit), members, limit), "links"))
    *done, _ = (f for f in written() if f not in others)  # the labels were written last; nothing needs the rest any more
    clear_written(spark, done)
    return labels


def _meets(limit: Threshold) -> str:
    """Condition under which entries a and b of one shingle may be among the first shared ones of a pair.

    a is the smaller set (of equal ones the lesser name), and its entry is in its index prefix, so a pair
    comes once a shingle and always in one order. At most need - 1 shared shingles come before one that
    counts, so what follows bounds the overlap.
    """
    num, den = limit.num, limit.den
    return (
        f"a_comp <> b_comp and (a_n < b_n or (a_n = b_n and a_cls < b_cls)) and {den} * a_n >= {num} * b_n "
        f"and {num + den} * (least(a_n - a_pos, b_n - b_pos) + least(a_need, b_need) - 1) >= {num} * (a_n + b_n)"
    )


def _grouped(docs: DataFrame, size: int, limit: Threshold) -> DataFrame:
    """For each row doc_id, text_key, n, class_size, comp (null if it is linked to none) and component (least doc_id)."""
    signatures = materialize(_signatures(docs, size, SKETCH_BITS), "signatures")
    labels = link_classes(docs, signatures, size, limit)
    found = signatures.where("bucket is null").select("doc_id", "text_key", "cls", "n")
    classes = found.where("n > 0").groupBy("cls").agg(F.min("doc_id").alias("low"), F.count("*").alias("class_size"))
    classes = classes.join(labels, "cls", "left").select("cls", "low", "class_size", F.coalesce("comp", "cls").alias("comp"), F.col("comp").isNotNull().alias("met"))
    # Classes that met no other are their own component; the rest are few.
    classes = materialize(classes.where("met or class_size > 1"), "classes")
    lows = classes.groupBy("comp").agg(F.min("low").alias("component"))
    named = classes.join(lows, "comp").select("cls", "class_size", "comp", "component")
    # A class may hold a third of all rows: its name is copied to several groups.
    named = named.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1))))
    salt = F.pmod(F.xxhash64("doc_id", F.monotonically_increasing_id()), F.lit(SPREAD)).cast("int")
    joined = found.withColumn("salt", salt).join(by_shuffle(named), ["cls", "salt"], "left")
    none = F.lit(None).cast("long")
    of = lambda c: F.when(F.col("n") > 0, F.col(c)).otherwise(none).alias(c)
    return joined.select("doc_id", "text_key", "n", of("class_size"), of("comp"), of("component"))


def near_duplicates(docs: DataFrame, size: int = 5, limit: Threshold = Threshold()) -> DataFrame:
    """doc_id, n_shingles, class_size (copies of its set), component_id: one row for each row of docs.

    Words are parted at ASCII space characters, A-Z lower-cased; a set holds the distinct shingles
    of `size` words, or the whole sequence if it has fewer. Documents whose sets reach the threshold
    are linked; component_id is the smallest doc_id reachable by links. Texts that are null or have
    no word have an empty set and stand alone. Rows with null doc_id link like others but never
    give the component's id. Repeated rows stay as they are. Other columns of docs are ignored.
    Sets are compared by 64-bit hashes of shingles and named by a 64-bit hash.
    """
    rows = _grouped(docs, size, limit)
    alone = F.col("comp").isNull()
    return rows.select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.when(alone, F.lit(1)).otherwise(F.col("class_size")).cast("long").alias("class_size"),
        F.when(alone, F.col("doc_id")).otherwise(F.col("component")).alias("component_id"),
    )


def op3_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Set size and component of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return near_duplicates(docs).select("doc_id", "n_shingles", "component_id")


def deduplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of each group of linked rows one stays, the one with the smallest id.

    Rows are told apart by doc_id and text, so ids that stand for several texts lose none but copies: of a
    group's rows with its smallest id the text with the least hash stays, and of equal rows the first. A
    group of rows without an id keeps one too. Null and empty texts, and long ones without a copy, stay;
    columns keep their values, whatever their names. An empty table gives no rows.
    """
    found = materialize(_grouped(docs.select("doc_id", "text"), 5, Threshold()).where("comp is not null").drop("n", "class_size"), "found")
    first = found.where(F.col("doc_id").eqNullSafe(F.col("component")))
    lead = first.groupBy("comp").agg(F.min("text_key").alias("lead"), F.count("*").alias("rows"))
    again = first.join(lead.where("rows > 1"), "comp")  # ids that stand for several rows of a group
    behind = again.where("text_key <> lead").select("doc_id", "text_key")
    gone = found.where(~F.col("doc_id").eqNullSafe(F.col("component"))).select("doc_id", "text_key").union(behind).distinct()
    repeated = materialize(again.where("text_key = lead").groupBy("doc_id", "text_key").count().where("count > 1").select("doc_id", "text_key"), "again")

    row, unpacked = kept_row(docs)
    rows = docs.select(row, F.col("doc_id").cast("long").alias("id"), F.xxhash64(F.col("text").cast("string")).alias("key"))
    same = lambda df: F.col("id").eqNullSafe(df["doc_id"]) & (F.col("key") == df["text_key"])
    kept = rows.join(gone, same(gone), "left_anti")
    if repeated.limit(1).count():
        one = kept.join(repeated, same(repeated), "left_semi").groupBy("id", "key").agg(F.first("row").alias("row"))
        kept = kept.join(repeated, same(repeated), "left_anti").select("row").unionByName(one.select("row"))
    return kept.select(*unpacked)
