"""Retrieval quality: metrics per query, means, paired bootstrap, rank correlation, comparison."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def metrics(rankings: DataFrame, labels: DataFrame, k: int) -> DataFrame:
    """query_id with hit_rate, recall, ndcg at k and mrr over the whole ranking.

    rankings: query_id, paper_id, rank from 1; a repeated paper counts at its best rank, ranks are
    then closed up. labels: query_id, paper_id, grade; relevant means grade > 0. Queries without a
    relevant label score 0.
    """
    if isinstance(k, bool) or not isinstance(k, int) or k <= 0:
        raise ValueError("k must be a positive whole number")
    once = rankings.groupBy("query_id", "paper_id").agg(F.min("rank").alias("rank"))
    w = Window.partitionBy("query_id").orderBy("rank", "paper_id")
    ranked = once.withColumn("rank", F.row_number().over(w))
    graded = labels.where("grade > 0").groupBy("query_id", "paper_id").agg(F.max("grade").alias("grade"))
    gain = lambda g, r: (F.pow(F.lit(2.0), g) - 1) / F.log2(r + 1.0)
    hits = ranked.join(graded, ["query_id", "paper_id"])
    found = hits.groupBy("query_id").agg(
        F.min("rank").alias("first"),
        F.count_if(F.col("rank") <= k).alias("found"),
        F.sum(F.when(F.col("rank") <= k, gain(F.col("grade"), F.col("rank")))).alias("dcg"),
    )
    best = graded.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("grade"), "paper_id")))
    ideal = best.groupBy("query_id").agg(
        F.count("*").alias("relevant"), F.sum(F.when(F.col("place") <= k, gain(F.col("grade"), F.col("place")))).alias("ideal")
    )
    zero = F.lit(0.0)
    joined = ranked.select("query_id").distinct().join(found, "query_id", "left").join(ideal, "query_id", "left")
    return joined.select(
        "query_id",
        F.when(F.col("found") > 0, 1.0).otherwise(zero).alias("hit_rate"),
        F.coalesce(F.col("found") / F.col("relevant"), zero).alias("recall"),
        F.coalesce(1.0 / F.col("first"), zero).alias("mrr"),
        F.coalesce(F.col("dcg") / F.col("ideal"), zero).alias("ndcg"),
    )


def aggregate(values: DataFrame, by: list[str], metric: str = "metric", value: str = "value", error: str | None = None) -> DataFrame:
    """mean and n by group and metric; values that are no numbers are skipped, as are rows with an error."""
    number = F.col(value).cast("string").try_cast("double")
    if error is not None:
        values = values.where(F.coalesce(F.trim(F.col(error)), F.lit("")) == "")
    return values.withColumn("_v", number).where("_v is not null").groupBy(*by, metric).agg(F.avg("_v").alias("mean"), F.count("*").alias("n"))


def paired_deltas(baseline: DataFrame, candidate: DataFrame, key: str = "query_id", value: str = "value") -> DataFrame:
    """key, delta = candidate - baseline for keys that both have; a missing value counts 0."""
    left = baseline.select(key, F.coalesce(value, F.lit(0.0)).alias("_b"))
    return left.join(candidate.select(key, F.coalesce(value, F.lit(0.0)).alias("_c")), key).select(key, (F.col("_c") - F.col("_b")).alias("delta"))


def paired_bootstrap(deltas: DataFrame, resamples: int = 10_000, seed: int = 17, key: str = "query_id") -> DataFrame:
    """n, mean, low, high: mean delta and its 95 % interval from resampled means.

    Draw i of resample r is the delta at a position hashed from (seed, r, i). Deltas are numbered once;
    each draw is a row that looks its position up, so resamples are spread over tasks.
    """
    w = Window.orderBy(key)  # one row a query of the evaluation set
    numbered = deltas.select((F.row_number().over(w) - 1).cast("long").alias("at"), "delta")
    n = numbered.agg(F.count("*").alias("n"), F.avg("delta").alias("mean"))
    draws = (
        deltas.sparkSession.range(resamples)
        .crossJoin(F.broadcast(n))  # one row
        .withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
        .withColumn("at", F.pmod(F.xxhash64(F.lit(seed), "id", "i"), F.col("n")))
    )
    means = draws.join(numbered, "at").groupBy("id").agg(F.avg("delta").alias("m"))
    ordered = means.agg(F.sort_array(F.collect_list("m")).alias("m"))  # `resamples` numbers
    at = lambda q: F.element_at("m", int(q * (resamples - 1)) + 1)
    return ordered.crossJoin(n).select("n", "mean", at(0.025).alias("low"), at(0.975).alias("high"))


def verdict(interval: DataFrame, tolerance: float = 0.01) -> DataFrame:
    """win, loss, within_tolerance or indistinguishable from low and high."""
    v = (
        F.when(F.col("low") > 0, "win")
        .when(F.col("high") < -tolerance, "loss")
        .when(F.col("high") < 0, "within_tolerance")
        .otherwise("indistinguishable")
    )
    return interval.withColumn("verdict", v)


def win_loss(deltas: DataFrame) -> DataFrame:
    return deltas.agg(
        F.count_if(F.col("delta") > 0).alias("wins"), F.count_if(F.col("delta") < 0).alias("losses"), F.count_if(F.col("delta") == 0).alias("ties")
    )


def running_counts(counted: DataFrame, value: str, count: str = "c") -> DataFrame:
    """Adds upto: the sum of counts of all values up to each one, for rows with distinct values.

    Values are dealt into ranges between approximate quantiles; sums run within ranges, and a small table
    has what lies before each range, so no task sees all values.
    """
    spark = counted.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    bounds = sorted(set(counted.stat.approxQuantile(value, [k / parts for k in range(1, parts)], 0.5 / parts))) if parts > 1 else []
    edges = F.array(*map(F.lit, bounds)) if bounds else F.array().cast("array<double>")
    ranged = counted.withColumn("_part", F.size(F.filter(edges, lambda b: b <= F.col(value).cast("double"))))
    sums = ranged.groupBy("_part").agg(F.sum(count).alias("_sum"))
    before = F.coalesce(F.sum("_sum").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row a range
    inside = F.sum(count).over(Window.partitionBy("_part").orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    placed = ranged.withColumn("_in", inside).join(F.broadcast(sums.select("_part", before.alias("_before"))), "_part")
    return placed.withColumn("upto", F.col("_before") + F.col("_in")).drop("_part", "_in", "_before")


def nearest_rank(values: DataFrame, fraction: float, value: str = "value") -> DataFrame:
    """The value at place round(fraction * (n - 1)) of the sorted values, halves to even; no interpolation."""
    known = values.where(F.col(value).isNotNull())
    n = known.agg(F.count("*").alias("n"))
    place = F.bround(F.lit(fraction) * (F.col("n") - 1), 0).cast("long")
    running = running_counts(known.groupBy(value).agg(F.count("*").alias("c")), value).crossJoin(F.broadcast(n))  # one row
    return running.where(F.col("upto") > place).agg(F.min(value).alias("value"))


def average_ranks(rows: DataFrame, value: str) -> DataFrame:
    """Adds rank: the mean place of equal values. Ranks come from counts by value."""
    counted = rows.where(F.col(value).isNotNull()).groupBy(value).agg(F.count("*").alias("_c"))
    placed = running_counts(counted, value, "_c").withColumn("rank", F.col("upto") - (F.col("_c") - 1) / 2.0)
    return rows.join(placed.drop("_c", "upto"), value)


def spearman(rows: DataFrame, x: str, y: str) -> DataFrame:
    """rho rounded to 3 digits over rows where both are known; null for fewer than three."""
    known = rows.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(x, y)
    both = average_ranks(average_ranks(known, x).withColumnRenamed("rank", "_rx"), y)
    return both.agg(F.when(F.count("*") >= 3, F.round(F.corr("_rx", "rank"), 3)).alias("rho"))
