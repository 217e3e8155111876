"""Distinct counts that can be merged: exact up to a limit, by sketch beyond it; or exact without a limit."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Up to so many distinct values a count is exact.
EXACT = 3000
#: The sketch has 2**LG_K registers: a relative error of about 1.04 / 2**(LG_K / 2), 1.6 %.
LG_K = 12
#: Without a limit a group's members are dealt over so many rows.
PARTS = 64


def distinct_sketches(rows: DataFrame, keys: list[str], value: str, exact: int | None = EXACT) -> DataFrame:
    """keys, sketch, members: to be kept, for example by day and facet, and merged later without the rows.

    members holds the distinct values of groups with at most `exact` of them, in no order, and is null for larger ones; sketch counts
    any number. Null values are not counted. With exact=None all members are kept, those of a group in up to PARTS rows.
    """
    if exact is None:
        found = rows.where(F.col(value).isNotNull()).select(*keys, F.col(value).alias("_value")).distinct()
        dealt = found.groupBy(*keys, F.pmod(F.xxhash64("_value"), F.lit(PARTS)).alias("_part"))
        return dealt.agg(F.hll_sketch_agg("_value", F.lit(LG_K)).alias("sketch"), F.collect_list("_value").alias("members")).drop("_part")
    distinct = rows.where(F.col(value).isNotNull()).select(*keys, F.col(value).alias("_value")).distinct()
    sketches = distinct.groupBy(*keys).agg(F.count("*").alias("_n"), F.hll_sketch_agg("_value", F.lit(LG_K)).alias("sketch"))
    same = lambda a, b: [a[k].eqNullSafe(b[k]) for k in keys]
    few = sketches.where(F.col("_n") <= exact).select(*keys)
    members = distinct.join(few, same(distinct, few), "left_semi").groupBy(*keys).agg(F.collect_list("_value").alias("members"))
    return sketches.join(members, same(sketches, members), "left").select(*(sketches[k] for k in keys), "sketch", "members")


def merged_counts(sketches: DataFrame, by: list[str], exact: int | None = EXACT) -> DataFrame:
    """by, n, is_exact: distinct values over all groups of the same `by`, from what distinct_sketches gave.

    The count is exact where all groups kept their members and together have at most `exact` (None: any number); else it is the merged sketch's.
    """
    merged = sketches.groupBy(*by).agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("_estimate"), F.bool_and(F.col("members").isNotNull()).alias("_all"))
    values = sketches.select(*by, F.explode("members").alias("_value")).distinct()
    counted = values.groupBy(*by).agg(F.count("*").alias("_n"))
    joined = merged.join(counted, [merged[k].eqNullSafe(counted[k]) for k in by], "left")
    is_exact = F.col("_all") & (F.lit(True) if exact is None else F.coalesce("_n", F.lit(0)) <= exact)
    return joined.select(*(merged[k] for k in by), F.when(is_exact, F.coalesce("_n", F.lit(0))).otherwise(F.col("_estimate")).alias("n"), is_exact.alias("is_exact"))
