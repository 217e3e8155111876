"""Catalog browsing: scoped word search, filters, orders, paging and facets."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.identifiers import identifier_form
from quire.functions.text import occurrences, word_and

SCOPES = ("all", "title", "authors", "venue", "doi", "arxiv_id", "abstract")
FACET_SIZE = 50


def live(df: DataFrame) -> DataFrame:
    """Rows that are not deleted."""
    return df.where(F.col("deleted_at").isNull())


def filter_papers(papers: DataFrame, status: str | None = None, paper_types: list[str] | None = None, year_from: int | None = None, year_to: int | None = None) -> DataFrame:
    """Live papers of a status, of any of the types, of the years; what is not given does not filter."""
    out = live(papers)
    if status:
        out = out.where(F.upper("status") == status.strip().upper())
    if wanted := [t.strip().lower() for t in paper_types or [] if t.strip()]:
        out = out.where(F.col("paper_type").isin(wanted))
    if year_from is not None:
        out = out.where(F.col("year") >= year_from)
    if year_to is not None:
        out = out.where(F.col("year") <= year_to)
    return out


def find_by_identifier(papers: DataFrame, identifiers: DataFrame, scheme: str, value: str) -> DataFrame:
    """Live papers with an identifier (paper_id, scheme, normalized_value), the value given as it is written anywhere."""
    key = scheme.strip().lower()
    wanted = identifiers.where((F.col("scheme") == key) & (F.col("normalized_value") == identifier_form(key, F.lit(value))))
    return live(papers).join(wanted.select(F.col("paper_id").alias("id")), "id", "left_semi")


def search_logs(logs: DataFrame, mode: str | None = None, since=None, limit: int = 50, most: int = 200) -> tuple[DataFrame, DataFrame]:
    """The newest logged searches (created_at, id, mode) and, as one row, how many there are in all."""
    out = logs
    if since is not None:
        out = out.where(F.col("created_at") >= F.lit(since))
    if mode:
        out = out.where(F.col("mode") == mode)
    return out.orderBy(F.desc("created_at"), F.desc("id")).limit(max(1, min(most, limit))), out.agg(F.count("*").alias("total"))


def words_of(query: str) -> list[str]:
    return [w.lower() for w in re.split(r"[\s\-]+", query.strip()) if w]


def search_catalog(papers: DataFrame, query: str, scope: str, authors: DataFrame, venues: DataFrame) -> DataFrame:
    """Papers in which each word of the query occurs in the scope, case-insensitively.

    `authors` is (paper_id, name), `venues` (id, name). Under `all`, different words may occur in different
    fields. Names are searched before they are joined, so the joins carry ids only.
    """
    if scope not in SCOPES:
        raise ValueError(f"unknown scope {scope!r}")
    plain = {"title", "doi", "arxiv_id", "abstract"}
    if scope in plain:
        return papers.where(word_and([F.col(scope)], query))
    out = papers
    for k, w in enumerate(words_of(query)):
        hits = [F.coalesce(F.contains(F.lower(c), F.lit(w)), F.lit(False)) for c in sorted(plain)] if scope == "all" else []
        if scope in ("all", "authors"):
            named = authors.where(F.contains(F.lower("name"), F.lit(w))).select(F.col("paper_id").alias("id")).distinct()
            out = out.join(named.withColumn(f"_a{k}", F.lit(True)), "id", "left")
            hits.append(F.coalesce(f"_a{k}", F.lit(False)))
        if scope in ("all", "venue"):
            named = venues.where(F.contains(F.lower("name"), F.lit(w))).select(F.col("id").alias("venue_id")).distinct()
            out = out.join(named.withColumn(f"_v{k}", F.lit(True)), "venue_id", "left")
            hits.append(F.coalesce(f"_v{k}", F.lit(False)))
        found = hits[0]
        for h in hits[1:]:
            found = found | h
        out = out.where(found)
    return out.select(*papers.columns)


def title_score(query: str, title: str = "title") -> Column:
    """Occurrences of the query's words in the title."""
    total = F.lit(0.0)
    for w in words_of(query):
        total = total + occurrences(F.col(title), w)
    return total


def sort_keys(sort: str | None, query: str | None) -> list[Column]:
    """Order of a catalog list; always ends with the id."""
    by = {
        "newest": [F.desc("created_at")],
        "year_desc": [F.desc_nulls_last("year"), F.desc("created_at")],
        "year_asc": [F.asc_nulls_last("year"), F.desc("created_at")],
        "title": [F.lower("title")],
    }
    if sort:
        return [*by[sort], F.asc("id")]
    if query and words_of(query):
        return [F.desc(title_score(query)), F.desc("created_at"), F.asc("id")]
    return [F.desc("created_at"), F.asc("id")]


def page(df: DataFrame, limit: int, offset: int, *order: Column) -> DataFrame:
    """limit is held within 1..200, offset at 0 or more."""
    return df.orderBy(*order).offset(max(0, offset)).limit(max(1, min(200, limit)))


def having_all(bridge: DataFrame, key: str, value: str, wanted: list) -> DataFrame:
    """Keys that have every wanted value (relational division)."""
    some = bridge.where(F.col(value).isin(wanted)).select(key, value).distinct()
    return some.groupBy(key).agg(F.count("*").alias("n")).where(F.col("n") == len(set(wanted))).select(key)


def having_any(df: DataFrame, bridge: DataFrame, key: str, value: str, wanted: list) -> DataFrame:
    """Rows of df with any wanted value, each once."""
    return df.join(bridge.where(F.col(value).isin(wanted)).select(key), key, "left_semi")


def catalog_facets(sources: dict[str, DataFrame], most: int = FACET_SIZE) -> DataFrame:
    """facet, key, n from one (paper, key) frame a facet: distinct papers, first 50 by count and key."""
    both = None
    for name, df in sources.items():
        part = df.select(F.lit(name).alias("facet"), F.col("key").cast("string").alias("key"), "paper").where("key is not null").distinct()
        both = part if both is None else both.unionByName(part)
    counted = both.groupBy("facet", "key").agg(F.count("*").alias("n"))
    w = Window.partitionBy("facet").orderBy(F.desc("n"), "key")
    return counted.withColumn("place", F.row_number().over(w)).where(F.col("place") <= most)


def budget_page(chunks: DataFrame, group: str, order: str, text: str, budget: int, start: int = 0) -> DataFrame:
    """Chunks of each group within a character budget, from its chunk number `start` (from 0) on; the last one is cut to fit.

    Adds place (the chunk's number), truncated, and next_offset: the number of the first chunk that is not shown, from which the next
    page starts; null where nothing is cut off. A null text has no characters.
    """
    w = Window.partitionBy(group).orderBy(order)
    so_far = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = chunks.withColumn("place", (F.row_number().over(w) - 1).cast("int")).where(F.col("place") >= start)
    size = F.char_length(F.coalesce(F.col(text), F.lit("")))
    rows = rows.withColumn("_end", F.sum(size).over(so_far)).withColumn("_start", F.col("_end") - size)
    last = F.max("place").over(Window.partitionBy(group))
    shown = rows.withColumn("_last", last).where(F.col("_start") < budget).withColumn("truncated", F.col("_end") > budget)
    whole = Window.partitionBy(group)
    next_ = F.max("place").over(whole) + 1
    more = F.bool_or("truncated").over(whole) | (next_ <= F.col("_last"))
    cut = F.when(F.col("truncated"), F.substr(F.col(text), F.lit(1), F.lit(budget) - F.col("_start"))).otherwise(F.col(text))
    return shown.withColumns({"next_offset": F.when(more, next_), text: cut}).drop("_start", "_end", "_last")


def context_window(rows: DataFrame, hits: DataFrame, group: str, index: str, before: int, after: int) -> DataFrame:
    """For each hit (group, index) the rows within `before` and `after` of it, at most 20 each way.

    The range becomes equal keys: each hit asks for its few indexes.
    """
    b, a = max(0, min(20, before)), max(0, min(20, after))
    wanted = hits.select(group, F.col(index).alias("hit"), F.explode(F.sequence(F.col(index) - b, F.col(index) + a)).alias(index))
    return wanted.join(rows, [group, index])


def filter_logs(logs: DataFrame, level: str | None = None, logger: str | None = None, request_id: str | None = None, since=None, until=None, text: str | None = None) -> DataFrame:
    """Log rows by level, logger part, request, time range and text; newest first."""
    out = logs
    if level:
        out = out.where(F.upper("level") == level.upper())
    if logger:
        out = out.where(F.contains("logger", F.lit(logger)))
    if request_id:
        out = out.where(F.col("request_id") == request_id)
    if since is not None:
        out = out.where(F.col("ts") >= F.lit(since))
    if until is not None:
        out = out.where(F.col("ts") <= F.lit(until))
    if text:
        out = out.where(F.contains(F.lower("message"), F.lit(text.lower())))
    return out.orderBy(F.desc("ts"))
