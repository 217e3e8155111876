"""Writers: versioned tables with a checked swap, keyed updates and deletes, appends and exports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.sources.manifests import latest, publish


def write_version(df: DataFrame, root: str, version: str, expected: int | None = None, partition_by: list[str] | None = None) -> int:
    """Write a new version of a table; its row count must be the expected one. Returns the count."""
    path = f"{root}/{version}"
    writer = df.write.mode("errorifexists")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    rows = df.sparkSession.read.parquet(path).count()
    if expected is not None and rows != expected:
        raise ValueError(f"{path} has {rows} rows, {expected} were expected; the current version stays")
    return rows


def write_checked(df: DataFrame, root: str, version: str, required: list[str]) -> tuple[int, int]:
    """Write the rows that have all required columns as a new version; (written, failed).

    Failed rows go to a folder beside it, with their reasons.
    """
    missing = F.array_compact(F.array(*(F.when(F.col(c).isNull(), F.lit(f"missing {c}")) for c in required)))
    marked = df.withColumn("_why", missing)
    written = write_version(marked.where(F.size("_why") == 0).drop("_why"), root, version)
    bad = marked.where(F.size("_why") > 0).withColumn("_why", F.array_join("_why", ", "))
    failed = write_version(bad, root, f"{version}-failed")
    return written, failed


def swap(spark: SparkSession, name: str, root: str, version: str) -> None:
    """Make a version the current one, for all sessions, and point this session's view `name` at it."""
    found = latest(spark, root)
    publish(spark, root, found[0] + 1 if found else 1, {"version": version})
    current(spark, root).createOrReplaceTempView(name)


def current(spark: SparkSession, root: str) -> DataFrame:
    """The current version of a table, as the newest manifest names it."""
    found = latest(spark, root)
    if found is None:
        raise ValueError(f"no version of {root} is current")
    return spark.read.parquet(f"{root}/{found[1]['version']}")


def update_columns(table: DataFrame, changes: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """The table with these columns of matching rows replaced; no row is added."""
    new = changes.select(key, F.lit(True).alias("_hit"), *(F.col(c).alias(f"_{c}") for c in columns))
    both = table.join(new, key, "left")
    return both.select(*(F.when(F.col("_hit"), F.col(f"_{c}")).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in table.columns))


def delete_keys(table: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return table.join(keys.select(key).distinct(), key, "left_anti")


def insert_missing(table: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """The rows whose key the table lacks, each key once, to be appended."""
    return rows.dropDuplicates([key]).join(table.select(key), key, "left_anti")


def append(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def export_citations(papers: DataFrame, path: str, kind: str = "bibtex") -> None:
    """Text files of citations (columns of operators.citations)."""
    papers.select(F.col(kind).alias("value")).write.mode("overwrite").text(path)
