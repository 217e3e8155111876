"""Pointers that lead on to pointers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.lineage import cut


def resolve_pointers(pointers: DataFrame) -> DataFrame:
    """(source, target, cyclic) from (source, target): where each source's chain of pointers ends.

    Each turn follows two pointers at once, so a chain of n takes about log2(n) turns of one join. Sources whose chain
    never ends, as it is a cycle or runs into one, keep their own target and are marked; so is a source that
    points to itself. Each source must come once; rows with nulls are left out.
    """
    own = cut(pointers.where("source is not null and target is not null").select("source", "target"))
    steps, reach, total = own.withColumn("open", F.lit(True)), 1, own.count()
    while True:
        ahead = steps.select(F.col("source").alias("target"), F.col("target").alias("next"))
        # A pointer is open while what it points to points on itself.
        steps = cut(steps.join(ahead, "target", "left").select("source", F.coalesce("next", "target").alias("target"), F.col("next").isNotNull().alias("open")))
        reach *= 2
        if reach > 2 * total or not steps.where("open").limit(1).count():
            break
    loops = F.col("open")
    first = own.withColumnRenamed("target", "first")
    return steps.join(first, "source").select("source", F.when(loops, F.col("first")).otherwise(F.col("target")).alias("target"), loops.alias("cyclic"))
