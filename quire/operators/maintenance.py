"""Consistency of stores, mirrors of identifiers, drift, reindex plans, degradations, retention, outbox."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.lineage import cut


def _issues(**tests: Column) -> Column:
    """Names of the tests that hold, in order."""
    return F.array_compact(F.array(*(F.when(F.coalesce(t, F.lit(False)), F.lit(n)) for n, t in tests.items())))


def consistency(papers: DataFrame, files: DataFrame, chunks: DataFrame, objects: DataFrame, index: DataFrame, index_readable: bool = True, objects_readable: bool = True) -> DataFrame:
    """paper_id, issues: what database, object store and index disagree on, for papers that have any.

    Each store is reduced to one row a paper, then the three are joined outer. An unreadable index
    means unknown, so it raises nothing but missing_chunks; nothing is said of objects of an unreadable store. objects: key (papers/<id>/<name>); index:
    paper_id, docs, backends array, models array.
    """
    inner = ~F.contains("key", F.lit("extracted/"))
    stored = objects.withColumn("paper_id", F.regexp_extract("key", "^papers/([^/]+)/", 1)).where("paper_id <> ''")
    stored = stored if objects_readable else stored.limit(0)
    stored = stored.groupBy("paper_id").agg(F.collect_set("key").alias("all_keys"), F.collect_set(F.when(inner, F.col("key"))).alias("keys"))
    wanted = files.where("deleted_at is null").groupBy("paper_id").agg(F.collect_set("object_key").alias("expected"))
    cut = chunks.groupBy("paper_id").agg(F.count("*").alias("chunks"), F.collect_set("embedding_model").alias("chunk_models"))
    known = papers.select(F.col("id").alias("paper_id"), "status", "parser_backend", F.col("deleted_at").isNotNull().alias("deleted"), F.lit(True).alias("exists"))
    rows = reduce(lambda a, b: a.join(b, "paper_id", "full_outer"), [known, wanted, cut, stored, index])
    none = F.array().cast("array<string>")
    rows = rows.withColumns(
        {c: F.coalesce(c, none) for c in ("expected", "keys", "all_keys", "chunk_models", "backends", "models")}
        | {c: F.coalesce(c, F.lit(0)) for c in ("chunks", "docs")}
        | {c: F.coalesce(c, F.lit(False)) for c in ("deleted", "exists")}
    )
    here = F.col("exists") & ~F.col("deleted")
    seen = here & F.lit(index_readable)
    stamp = F.array_compact(F.array("parser_backend"))
    issues = _issues(
        unknown_paper=~F.col("exists") & ((F.size("all_keys") > 0) | (F.col("docs") > 0)),
        residue=F.col("deleted") & ((F.size("all_keys") > 0) | (F.lit(index_readable) & (F.col("docs") > 0))),
        missing_object=here & F.lit(objects_readable) & (F.size(F.array_except("expected", "keys")) > 0),
        orphan_object=here & (F.size(F.array_except("keys", "expected")) > 0),
        missing_index=seen & (F.col("chunks") > 0) & (F.col("docs") == 0),
        chunk_count_mismatch=seen & (F.col("chunks") > 0) & (F.col("docs") > 0) & (F.col("docs") != F.col("chunks")),
        orphan_index=seen & (F.col("chunks") == 0) & (F.col("docs") > 0),
        missing_chunks=here & (F.col("chunks") == 0) & (F.upper("status") == "INDEXED"),
        stamp_mismatch=seen & (F.col("docs") > 0) & (F.sort_array("backends") != stamp),
        model_mismatch=here & (F.size(F.array_union("chunk_models", "models")) >= 2),
    )
    return rows.select("paper_id", issues.alias("issues")).where(F.size("issues") > 0)


def mirror_audit(papers: DataFrame, identifiers: DataFrame) -> DataFrame:
    """paper_id, scheme, drift: where a paper's own columns and its identifier rows disagree."""
    mirror = papers.where("deleted_at is null").select(
        F.col("id").alias("paper_id"), F.explode(F.array(F.struct(F.lit("doi").alias("scheme"), F.col("doi").alias("mirror")), F.struct(F.lit("arxiv").alias("scheme"), F.col("arxiv_id").alias("mirror")))).alias("m")
    ).select("paper_id", "m.scheme", "m.mirror").where("mirror is not null")
    rows = identifiers.select("paper_id", "scheme", "normalized_value")
    live = papers.where("deleted_at is null").select(F.col("id").alias("paper_id"))
    drifts = [
        rows.where("normalized_value is null").withColumn("drift", F.lit("missing_normalized_value")),
        rows.join(papers.select(F.col("id").alias("paper_id")), "paper_id", "left_anti").withColumn("drift", F.lit("orphan_identifier")),
    ]
    twice = rows.where("normalized_value is not null").groupBy("scheme", "normalized_value").agg(F.min("paper_id").alias("paper_id"), F.count("*").alias("n")).where("n > 1")
    drifts.append(twice.select("paper_id", "scheme").withColumn("drift", F.lit("duplicate_identifier")))
    own = rows.join(live, "paper_id", "left_semi").where(F.col("scheme").isin("doi", "arxiv"))
    by_key = own.groupBy("paper_id", "scheme").agg(F.collect_set("normalized_value").alias("values"))
    both = mirror.join(by_key, ["paper_id", "scheme"], "full_outer")
    drift = (
        F.when(F.col("values").isNull(), "mirror_without_identifier")
        .when(F.col("mirror").isNull(), "identifier_without_mirror")
        .when(~F.array_contains("values", F.col("mirror")), "value_mismatch")
    )
    drifts.append(both.withColumn("drift", drift).where("drift is not null").select("paper_id", "scheme", "drift"))
    return reduce(lambda a, b: a.unionByName(b), [d.select("paper_id", "scheme", "drift") for d in drifts])


def census(rows: DataFrame, stamp: str, configured: str, missing: str = "unknown") -> DataFrame:
    """stamp, n, stale: rows by stamp, blank ones under `missing`; stale where it isn't the configured one."""
    name = F.coalesce(F.when(F.trim(F.col(stamp)) != "", F.col(stamp)), F.lit(missing))
    return rows.groupBy(name.alias("stamp")).agg(F.count("*").alias("n")).withColumn("stale", F.col("stamp") != configured)


def census_with_remainder(known: DataFrame, total: DataFrame) -> DataFrame:
    """Counts (stamp, n) and what is left of the total (one row, column total) as `unknown`."""
    rest = known.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("s")).crossJoin(total).select(F.lit("unknown").alias("stamp"), (F.col("total") - F.col("s")).alias("n"))
    return known.select("stamp", "n").unionByName(rest.where("n > 0"))


REASONS = ("embedding_drift", "parser_drift", "open_degradations", "missing_chunks")


def reindex_plan(
    papers: DataFrame, chunks: DataFrame, degradations: DataFrame, model: str, parser: str,
    explicit: list[str] | None = None, everything: bool = False, reasons: list[str] | None = None,
) -> DataFrame:
    """paper_id, reasons: live papers to index anew, oldest first.

    Explicit ids come first, then everything, then named reasons, then all detected ones. A drift of
    the embedding model concerns every live paper. Unknown reasons raise.
    """
    live = papers.where("deleted_at is null").select(F.col("id").alias("paper_id"), "parser_backend", "created_at")
    if explicit:
        return live.where(F.col("paper_id").isin(explicit)).select("paper_id", F.array(F.lit("explicit")).alias("reasons"), "created_at").orderBy("created_at", "paper_id")
    if everything:
        return live.select("paper_id", F.array(F.lit("all")).alias("reasons"), "created_at").orderBy("created_at", "paper_id")
    if unknown := set(reasons or ()) - set(REASONS):
        raise ValueError(f"unknown reasons: {sorted(unknown)}")
    drifted = chunks.where(~F.col("embedding_model").eqNullSafe(F.lit(model))).limit(1).select(F.lit(1).alias("one"))
    found = {
        "embedding_drift": live.select("paper_id").join(F.broadcast(drifted)).select("paper_id"),  # one row or none
        "parser_drift": live.where(F.coalesce(F.when(F.trim("parser_backend") != "", F.col("parser_backend")), F.lit("unknown")) != parser).select("paper_id"),
        "open_degradations": degradations.where("resolved_at is null").select("paper_id").distinct(),
        "missing_chunks": live.select("paper_id").join(chunks.select("paper_id"), "paper_id", "left_anti"),
    }
    parts = [found[r].withColumn("reason", F.lit(r)) for r in REASONS if not reasons or r in reasons]
    chosen = reduce(lambda a, b: a.unionByName(b), parts).groupBy("paper_id").agg(F.sort_array(F.collect_set("reason")).alias("reasons"))
    return live.select("paper_id", "created_at").join(chosen, "paper_id").orderBy("created_at", "paper_id")


def degradation_ledger(events: DataFrame) -> DataFrame:
    """One row a (paper_id, stage, code): occurrences, first_seen, last_seen and the latest detail."""
    return events.groupBy("paper_id", "stage", "code").agg(
        F.count("*").alias("occurrences"), F.min("at").alias("first_seen"), F.max("at").alias("last_seen"), F.max_by("detail", F.struct("at", "detail")).alias("detail")
    )


def upsert_degradations(ledger: DataFrame, events: DataFrame) -> DataFrame:
    """The ledger after more events: counts add up, a repeated row opens again."""
    new = degradation_ledger(events).withColumn("resolved_at", F.lit(None).cast("timestamp"))
    both = ledger.select(*new.columns).withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    return both.groupBy("paper_id", "stage", "code").agg(
        F.sum("occurrences").alias("occurrences"),
        F.min("first_seen").alias("first_seen"),
        F.max("last_seen").alias("last_seen"),
        F.max_by("detail", "_new").alias("detail"),
        F.max_by("resolved_at", "_new").alias("resolved_at"),
    )


def resolve_stage(ledger: DataFrame, stage: str, keep: list[str], at: Column) -> DataFrame:
    """Open rows of the stage are resolved at `at`, but for codes that are kept."""
    ends = (F.col("stage") == stage) & F.col("resolved_at").isNull() & ~F.col("code").isin(keep or [""])
    return ledger.withColumn("resolved_at", F.when(ends, at).otherwise(F.col("resolved_at")))


#: Days that finished work and logs are kept.
AGES = {"completed": 90, "failed": 180, "search_log": 90, "figures": 180}


def expired_jobs(jobs: DataFrame, now: Column, active: DataFrame | None = None, ages: dict[str, int] = AGES) -> DataFrame:
    """Finished jobs past their age, with whether an active task still refers to them."""
    done = F.coalesce("finished_at", "updated_at")
    old = lambda status, days: (F.upper("status") == status) & (done < now - F.make_interval(days=F.lit(days)))
    out = jobs.where(old("COMPLETED", ages["completed"]) | old("FAILED", ages["failed"]))
    if active is None:
        return out.withColumn("referenced", F.lit(False))
    marks = active.select("id").distinct().withColumn("_r", F.lit(True))
    return out.join(marks, "id", "left").withColumn("referenced", F.coalesce("_r", F.lit(False))).drop("_r")


def expired_rows(rows: DataFrame, at: str, days: int, now: Column) -> DataFrame:
    return rows.where(F.col(at) < now - F.make_interval(days=F.lit(days)))


def unreferenced(rows: DataFrame, key: str, *references: DataFrame) -> DataFrame:
    """Rows that no reference (one column of keys each) mentions."""
    for ref in references:
        rows = rows.join(ref.select(F.col(ref.columns[0]).alias(key)).distinct(), key, "left_anti")
    return rows


class ScanLimit(RuntimeError):
    """A scan would return more rows than its limit."""


def bounded(rows: DataFrame, limit: int) -> DataFrame:
    """The rows, if there are at most `limit`; else an error, as a report cut off in silence would mislead.

    They are worked out once and kept, so what was counted is what is returned.
    """
    kept = cut(rows.limit(limit + 1))
    if kept.count() > limit:
        raise ScanLimit(f"more than {limit} rows; narrow the scope")
    return kept


def orphan_records(rows: DataFrame, key: str, now: Column, days: int, *references: DataFrame) -> DataFrame:
    """Rows older than so many days that nothing refers to, the oldest first."""
    return unreferenced(expired_rows(rows, "created_at", days, now), key, *references).orderBy("created_at", key)


def capped_report(problems: DataFrame, kind: str, most: int, *order: str) -> DataFrame:
    """The first `most` problems of each kind, in order, each with the exact number of all of its kind."""
    w = Window.partitionBy(kind).orderBy(*order)
    totals = problems.groupBy(kind).agg(F.count("*").alias("total"))  # one row a kind
    first = problems.withColumn("place", F.row_number().over(w)).where(F.col("place") <= most)
    return first.join(F.broadcast(totals), kind)


def collectable_objects(objects: DataFrame, jobs: DataFrame, now: Column, retry_hours: int = 72) -> DataFrame:
    """Staged objects that neither a live job nor one that may be retried refers to."""
    running = ~F.upper("status").isin("COMPLETED", "FAILED")
    retry = (F.upper("status") == "FAILED") & (F.coalesce("finished_at", "updated_at") >= now - F.make_interval(hours=F.lit(retry_hours)))
    return objects.join(jobs.where(running | retry).select(F.get_json_object("payload", "$.object_key").alias("key")), "key", "left_anti")


def open_cleanups(jobs: DataFrame, now: Column) -> DataFrame:
    """Cleanup jobs whose payload says that they may still be confirmed at this time (ISO text, compared as text)."""
    expires = F.get_json_object("payload", "$.expires_at")
    return jobs.where((F.col("kind") == "cleanup") & (expires > F.date_format(now, "yyyy-MM-dd'T'HH:mm:ss")))


def enqueue(outbox: DataFrame, updates: DataFrame) -> DataFrame:
    """The outbox after updates (paper_id, enqueued_at): a new revision replaces a paper's row."""
    new = updates.groupBy("paper_id").agg(F.max("enqueued_at").alias("enqueued_at"))
    both = outbox.join(new.withColumnRenamed("enqueued_at", "_at"), "paper_id", "full_outer")
    changed = F.col("_at").isNotNull()
    return both.select(
        "paper_id",
        (F.coalesce("revision", F.lit(0)) + changed.cast("int")).cast("long").alias("revision"),
        F.when(changed, 0).otherwise(F.col("attempts")).alias("attempts"),
        F.coalesce("_at", "enqueued_at").alias("enqueued_at"),
    )


def settle(outbox: DataFrame, flushed: DataFrame, ok: bool) -> DataFrame:
    """After a flush of rows (paper_id, revision): done ones go if unchanged meanwhile, failed ones count up."""
    sent = flushed.select("paper_id", F.col("revision").alias("_sent"))
    both = outbox.join(sent, "paper_id", "left")
    if ok:
        return both.where(F.col("_sent").isNull() | (F.col("_sent") != F.col("revision"))).drop("_sent")
    return both.withColumn("attempts", F.col("attempts") + F.col("_sent").isNotNull().cast("int")).drop("_sent")


def priority_order(jobs: DataFrame) -> DataFrame:
    """Queue order: interactive before batch, then first come; a job waits once."""
    once = jobs.withColumn("_n", F.row_number().over(Window.partitionBy("id").orderBy("enqueued_at"))).where("_n = 1").drop("_n")
    return once.orderBy(F.when(F.col("kind") == "interactive", 0).otherwise(1), "enqueued_at", "id")
