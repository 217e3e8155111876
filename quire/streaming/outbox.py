"""The metadata outbox as a stream: updates are applied at least once, the latest revision wins."""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def latest_revisions(updates: DataFrame) -> DataFrame:
    """Of each paper the row with the highest revision."""
    columns = [c for c in updates.columns if c != "paper_id"]
    best = updates.groupBy("paper_id").agg(F.max_by(F.struct(*columns), "revision").alias("r"))
    return best.select("paper_id", "r.*")


def stream_outbox(updates: DataFrame, apply: Callable[[DataFrame, int], None], checkpoint: str, every: str = "5 seconds") -> StreamingQuery:
    """Feed micro-batches, reduced to the latest revisions, to `apply` (an idempotent upsert)."""

    def batch(df: DataFrame, epoch: int) -> None:
        apply(latest_revisions(df), epoch)

    return updates.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(processingTime=every).start()


# ---- pending updates as state

#: What arrives for a paper: an update, or the answer to an attempt of writing a revision.
UPDATE, DONE, FAILED = "update", "done", "failed"
#: Pending papers that one flush writes.
FLUSH_ROWS = 20


def pending_updates(events: DataFrame) -> DataFrame:
    """paper_id, revision, attempts, open: a paper's pending state whenever it changes, from a stream of (paper_id, revision, kind).

    The state of a paper is kept by key. An update sets its revision, if it is newer than all before, and starts counting attempts anew. The
    answer `done` ends it only if the revision is still the one that was written: one that came in during the flush stays
    open. The answer `failed` counts an attempt at the present revision; answers about older ones change nothing. Events of one
    batch count in the order update, failed, done within a revision, so repeated events do no harm.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        revision, attempts, is_open = state.get if state.exists else (-1, 0, False)
        before = (revision, attempts, is_open)
        rows = pd.concat(frames)
        rows["at"] = rows.kind.map({UPDATE: 0, FAILED: 1, DONE: 2})
        for r in rows.dropna(subset=["revision", "at"]).sort_values(["revision", "at"], kind="stable").itertuples():
            if r.kind == UPDATE and r.revision > revision:
                revision, attempts, is_open = int(r.revision), 0, True
            elif r.kind == FAILED and r.revision == revision and is_open:
                attempts += 1
            elif r.kind == DONE and r.revision == revision:
                is_open = False
        state.update((revision, attempts, is_open))
        if (revision, attempts, is_open) != before:
            yield pd.DataFrame([(key[0], revision, attempts, is_open)], columns=["paper_id", "revision", "attempts", "open"])

    rows = events.where(F.col("paper_id").isNotNull()).select("paper_id", F.col("revision").cast("long").alias("revision"), "kind")
    kind = rows.schema["paper_id"].dataType.simpleString()
    return rows.groupBy("paper_id").applyInPandasWithState(
        step, f"paper_id {kind}, revision long, attempts int, open boolean", "revision long, attempts int, open boolean", "update", GroupStateTimeout.NoTimeout
    )


def flush_in_batches(pending: DataFrame, write: Callable[[list[tuple]], bool], answer: Callable[[DataFrame], None], rows: int = FLUSH_ROWS) -> None:
    """Write open papers (paper_id, revision, open) in batches of `rows`, by id, and hand the answers (paper_id, revision, kind) to `answer`.

    write gets a list of (paper_id, revision) and says whether all of it was written; where it raises, none was. Batches go through an iterator,
    a partition at a time, so pending papers are never all in the driver.
    """
    spark = pending.sparkSession
    todo = pending.where("open").select("paper_id", "revision").orderBy("paper_id").toLocalIterator()
    while some := list(itertools.islice(todo, rows)):
        batch = [(r["paper_id"], r["revision"]) for r in some]
        try:
            ok = write(batch)
        except (RuntimeError, OSError, ValueError):
            ok = False
        kind = pending.schema["paper_id"].dataType.simpleString()
        answer(spark.createDataFrame([(*b, DONE if ok else FAILED) for b in batch], f"paper_id {kind}, revision long, kind string"))


# ---- extensions: the reference has no event time


def _timed(events: DataFrame, late: str) -> DataFrame:
    """Watermarks need an instant, so a stream's zoneless times are read in the session's zone."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late) if events.isStreaming else events


def windowed_counts(events: DataFrame, width: str = "1 hour", slide: str | None = None, late: str = "10 minutes", by: str = "event_type") -> DataFrame:
    """Counts and sums by event-time window and type; rows later than `late` are dropped on streams."""
    window = F.window("ts", width, slide) if slide else F.window("ts", width)
    timed = _timed(events, late)
    return timed.groupBy(window.alias("w"), by).agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), by, "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes", by: str = "user_id") -> DataFrame:
    """Sessions of each user: event times closer than `gap`."""
    timed = _timed(events, late)
    return timed.groupBy(F.session_window("ts", gap).alias("w"), by).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), by, "n")
