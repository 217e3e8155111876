"""Plumbing that several operators share: the shared folder, lineage cuts, exact splitters."""

from __future__ import annotations

import json
import tempfile
import uuid
from bisect import bisect_right
from collections.abc import Iterable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words of every text operator: runs of anything but these six ASCII space characters.
SPACES = "\x20\x09\x0a\x0b\x0c\x0d"
SPACE_RUN = "[\\x20\\x09-\\x0D]+"

#: Keys of the splitter search are non-negative and below 2**KEY_BITS.
KEY_BITS = 63


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see.

    It is spark.checkpoint.dir. Only where that is unset, as in tests on a local master, a
    temporary folder takes its place.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current.rstrip("/")
    if not context.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir is not set; executors need a shared folder")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="quire-"))
    return context.getCheckpointDir().rstrip("/")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet into the shared folder and return the table read back.

    A written table survives lost executors, is split into even tasks again when it is read,
    and lets later passes read only the columns they need.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/quire-{uuid.uuid4().hex}/{name}"
    _written.append(path.rpartition("/")[0])
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Folders of this session's written tables.
_written: list[str] = []


def written() -> list[str]:
    """Folders of the tables that this session has written and not cleared."""
    return list(_written)


def clear_written(spark: SparkSession, folders: Iterable[str] | None = None) -> int:
    """Delete this session's written tables (or these of them), once nothing lazy refers to them; how many folders went."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    gone = 0
    for folder in list(_written) if folders is None else folders:
        _written.remove(folder)
        path = jvm.org.apache.hadoop.fs.Path(folder)
        gone += bool(path.getFileSystem(conf).delete(path, True))
    return gone


def put_file(spark: SparkSession, path: str, chunks: Iterable[bytes]) -> str:
    """Write bytes to a path of the shared folder, by Hadoop's file systems; the full path."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    out = fs.create(where, True)
    held = bytearray()
    for chunk in chunks:
        held += chunk
        if len(held) > 1 << 20:
            out.write(held)
            held = bytearray()
    out.write(held)
    out.close()
    return fs.makeQualified(where).toString()


def plan_table(spark: SparkSession, rows: Iterable[dict], schema: str, name: str) -> DataFrame:
    """Rows that the driver has worked out from sums, as JSON lines in the shared folder, read back as a table."""
    folder = f"{shared_dir(spark)}/quire-{uuid.uuid4().hex}"
    _written.append(folder)
    path = put_file(spark, f"{folder}/{name}.json", (json.dumps(r).encode() + b"\n" for r in rows))
    return spark.read.schema(schema).json(path)


def checkpoint(df: DataFrame) -> DataFrame:
    """A reliable checkpoint, for tables of narrow rows; Spark deletes it when it is unreachable."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def join_small(big: DataFrame, small: DataFrame, on: list[str], rows: int, limit: int, how: str = "inner") -> DataFrame:
    """Join with a broadcast of `small` when its counted `rows` are within `limit`, else by shuffle."""
    return big.join(F.broadcast(small) if rows <= limit else small, on, how)


def by_shuffle(df: DataFrame) -> DataFrame:
    """df for a join that must not broadcast it: Spark judges it by its files, but rows copied to groups, or packed in
    files, are many times that size in the driver's memory."""
    return df.hint("merge")


#: More bounds than this are searched in an array; a tree of comparisons would outgrow compiled code.
TREE_BOUNDS = 256


def interval_index(value: Column, bounds: Sequence[int]) -> Column:
    """How many of the ascending `bounds` are at or below `value`: a balanced tree of comparisons, or
    a binary search in one array of many bounds."""
    if len(bounds) > TREE_BOUNDS:
        table = longs(bounds)
        steps = F.array(*(F.lit(1 << k) for k in reversed(range(len(bounds).bit_length()))))
        return F.aggregate(steps, F.lit(0), lambda at, step: F.when(F.get(table, at + step - 1) <= value, at + step).otherwise(at))

    def node(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(value < F.lit(bounds[mid]), node(lo, mid)).otherwise(node(mid + 1, hi))

    return node(0, len(bounds))


def longs(values: Sequence[int]) -> Column:
    """An array of fixed numbers; Spark folds it into one constant."""
    return F.expr(f"array({', '.join(f'{v}L' for v in values)})")


@dataclass
class Splitters:
    """Boundaries of consecutive key ranges, with the exact weight below each of them."""

    bounds: list[int]
    below: list[int]
    total: int
    rounds: int

    def part(self, key: Column) -> Column:
        return interval_index(key, self.bounds).cast("int")

    def find(self, key: int) -> int:
        return bisect_right(self.bounds, key)


def find_splitters(
    keys: DataFrame, key: Column, weight: Column, parts: int, tolerance: float = 0.01, first_bits: int = 14
) -> Splitters:
    """Histogram sort: count the exact weight below candidate boundaries and refine the probes.

    Each round cuts the key range around every open boundary into equal pieces and sums the weight
    in each piece over all rows; only these sums, at most 2**16 of them a round, come to the driver. A
    boundary is settled when the weight below it is within `tolerance` of an even part of its
    target, or when its range holds a single key (rows of one key cannot be parted by key).
    """
    spark = keys.sparkSession
    keys = keys.select(key.alias("k"), weight.cast("long").alias("w"))
    width = KEY_BITS
    open_: dict[int, list[tuple[int, int]]] = {0: []}  # prefix -> targets in that range
    start = {0: 0}  # prefix -> weight below the range
    settled: dict[int, tuple[int, int]] = {}
    total, rounds = None, 0
    while open_:
        bits = min(first_bits, width) if total is None else max(1, min(width, (2**16 // len(open_)).bit_length() - 1, 12))
        narrow = width - bits
        rows = keys
        if total is not None:
            rows = rows.where(F.shiftright("k", width).isin([int(p) for p in open_]))
        found: dict[int, list[tuple[int, int]]] = {}
        for piece, w in rows.groupBy(F.shiftright("k", narrow).alias("p")).agg(F.sum("w").alias("w")).collect():
            found.setdefault(piece >> bits, []).append((piece, w or 0))
        rounds += 1
        if total is None:
            total = sum(w for _, w in found.get(0, []))
            open_[0] = [(j, total * (j + 1) // parts) for j in range(parts - 1)]
        slack = tolerance * total / parts
        next_open: dict[int, list[tuple[int, int]]] = {}
        next_start: dict[int, int] = {}
        for prefix, targets in open_.items():
            pieces = sorted(found.get(prefix, []))
            at, low = 0, start[prefix]
            for j, target in targets:  # ascending
                while at < len(pieces) and low + pieces[at][1] <= target:
                    low += pieces[at][1]
                    at += 1
                if at == len(pieces):
                    settled[j] = ((prefix + 1) << width, low)
                    continue
                piece, w = pieces[at]
                if target - low <= slack or (narrow == 0 and target - low <= low + w - target):
                    settled[j] = (piece << narrow, low)
                elif low + w - target <= slack or narrow == 0:
                    settled[j] = ((piece + 1) << narrow, low + w)
                else:
                    next_open.setdefault(piece, []).append((j, target))
                    next_start[piece] = low
        open_, start, width = next_open, next_start, narrow
    ends = [settled[j] for j in range(parts - 1)]
    top = 2**KEY_BITS - 1  # a boundary at the very end of the range would not fit a long
    return Splitters([min(b, top) for b, _ in ends], [w for _, w in ends], total or 0, rounds)


def deal(df: DataFrame, part: str, parts: int, order: list[str]) -> DataFrame:
    """The one exchange: row to task `part`, sorted there; adds `at`, which counts a task's rows from 0.

    The operators hand rows over with the caller's columns inside one struct, so no names clash.
    """
    dealt = df.repartitionById(parts, F.col(part)).sortWithinPartitions(*order)
    return dealt.withColumn("at", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))


def kept_row(df: DataFrame, without: Iterable[str] = ()) -> tuple[Column, list[Column]]:
    """The caller's columns as one struct `row`, but for those that are replaced; and how to unpack it."""
    names = [c for c in df.columns if c not in set(without)]
    row = F.struct(*(F.col(f"`{c}`") for c in names)) if names else F.lit(None).cast("struct<none: int>")
    return row.alias("row"), [F.col("row").getField(c).alias(c) for c in names]
