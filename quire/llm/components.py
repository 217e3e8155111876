"""Connected components of a distributed edge list by hooking and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import clear_written, materialize, written


def components(edges: DataFrame) -> DataFrame:
    """edges (a, b) -> (node, root): the smallest node that each node of an edge can reach.

    Each round hooks every node to its smallest neighbour, follows the pointers to their ends and
    contracts the edges; components at least halve, so the rounds are few, and a node with many
    edges only takes part in minima that are pre-aggregated. Self-loops and repeated edges do no harm.
    Tables are written between steps, as the files of a small one are read by few tasks, however many wrote them.
    """
    spark, others = edges.sparkSession, set(written())
    pairs = materialize(edges.select("a", "b").where("a <> b").distinct(), "edges")
    roots = None
    while pairs.limit(1).count():
        both = pairs.union(pairs.select("b", "a"))
        step = materialize(both.groupBy("a").agg(F.min("b").alias("low")).select(F.col("a").alias("node"), F.least("a", "low").alias("root")), "step")
        while True:  # a node's root may point on
            ahead = step.select(F.col("node").alias("root"), F.col("root").alias("next"))
            jumped = materialize(step.join(ahead, "root", "left").select("node", F.coalesce("next", "root").alias("root"), (F.col("next") != F.col("root")).alias("moved")), "jumped")
            step = jumped.select("node", "root")
            if not jumped.where("moved").limit(1).count():
                break
        to = lambda name: step.select(F.col("node").alias(name), F.col("root").alias(f"{name}_root"))
        pairs = materialize(
            pairs.join(to("a"), "a").join(to("b"), "b").select(F.col("a_root").alias("a"), F.col("b_root").alias("b")).where("a <> b").distinct(), "edges"
        )
        if roots is not None:
            ahead = step.select(F.col("node").alias("root"), F.col("root").alias("next"))
            step = roots.join(ahead, "root", "left").select("node", F.coalesce("next", "root").alias("root"))
        roots = materialize(step, "roots")
    if roots is None:
        return pairs.select(F.col("a").alias("node"), F.col("b").alias("root"))
    *done, _ = (f for f in written() if f not in others)  # the roots were written last
    clear_written(spark, done)
    return roots
