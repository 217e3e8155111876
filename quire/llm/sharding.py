"""Operator 6, sharding by histogram sort. Native: DataFrame expressions only.

Rows are ordered by a 63-bit key (40 bits hash what groups them, 23 bits part the rows of a group),
exact byte counts below candidate boundaries are refined until every splitter meets its tolerance,
and the rows move once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.common import deal, find_splitters, kept_row, longs, materialize, shuffle_partitions


def histogram_shards(
    df: DataFrame, size: Column, group: list[str], tie: list[str], shards: int = 16, tolerance: float = 0.01
) -> DataFrame:
    """Give every row a shard 0..shards-1 of near equal total `size` and a gapless slot in it.

    Rows with equal `group` columns get adjacent keys, so they share a shard unless the group
    crosses a boundary; a group of any size is cut by the hash of `tie` and of the row's number.
    Adds columns shard (int), slot (long) and keeps all others; columns named like these two are
    replaced, any other name is free. Null group or tie values hash like any value. Repeated rows are kept as often as
    they occur. An empty table returns no rows. The work within a shard is done by several tasks.
    """
    spark = df.sparkSession
    pieces = max(1, -(-shuffle_partitions(spark) // shards))
    parts = shards * pieces
    low = F.shiftrightunsigned(F.xxhash64(*tie, F.monotonically_increasing_id()), 41)
    high = F.shiftleft(F.shiftrightunsigned(F.xxhash64(*group), 24), 23)
    row, unpacked = kept_row(df, ("shard", "slot"))
    table = materialize(df.select(row, size.cast("long").alias("size"), high.bitwiseOR(low).alias("key")), "sized")
    cut = find_splitters(table, F.col("key"), F.col("size"), parts, tolerance)
    table = table.withColumn("part", cut.part(F.col("key")))
    counts = dict(table.groupBy("part").count().collect())  # one row for each task at most
    base, before = [], 0
    for part in range(parts):
        if part % pieces == 0:
            before = 0
        base.append(before)
        before += counts.get(part, 0)
    dealt = deal(table, "part", parts, ["key"])
    first = F.element_at(longs(base), F.col("part") + 1)
    shard = F.floor(F.col("part") / F.lit(pieces)).cast("int")
    return dealt.select(*unpacked, shard.alias("shard"), (first + F.col("at")).alias("slot"))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 16 shards of near equal bytes; equal texts stay side by side."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(
        "doc_id",
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text).cast("long").alias("text_crc32"),
        F.xxhash64(text).alias("_text"),
    )
    out = histogram_shards(rows, F.col("size"), ["_text"], ["doc_id"])
    return out.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
