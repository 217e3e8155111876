"""Operator 1, mixing sources to target weights by Pfair scheduling. Native: DataFrame expressions only.

Time is counted in slots; a slot takes half a block. A source's target line says how many halves it
should have had by any slot: it rises with the source's share of the weights of all sources that
are not used up, so it bends where a source runs out. Half j of a source is released when its line
reaches j and due when it reaches j + 1; of the released halves, the one that is due first runs.

That is done on two levels. The run is cut into windows, and window by window the halves that are
due in it are taken, then released ones by their deadlines until it is full: every line is met to
less than a half at each end of a window, and nothing adds up over windows. A source may have no
half in a window. Inside a window its halves get releases and deadlines anew, by their number, and
slots by earliest deadline first: less than another half. So no source is ever a whole block
(two halves) away from its target line. The first level works on sums by source (a few numbers a window);
the second is a fold over each window's row, all windows at once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.common import deal, find_splitters, join_small, kept_row, longs, plan_table, shuffle_partitions

#: A schedule of more halves than this is joined by shuffle instead of broadcast.
BROADCAST_ROWS = 200_000


def target_lines(halves: np.ndarray, weights: np.ndarray) -> tuple[list[int], list[np.ndarray]]:
    """Slots at which target lines bend, and all lines' values there; straight between.

    Lines rise in proportion to the weights of what is left. A source that would run out within a slot
    bends the lines at the slot's end.
    """
    left, line, at = halves.astype(float), np.zeros(len(halves)), 0
    ends, values = [0], [line.copy()]
    total = int(halves.sum())
    while at < total:
        live = left > 1e-9
        stop = None
        room = 0.0  # of the slot in which a source runs out
        while True:
            if not live.any():
                step = 0.0
            else:
                rate = np.where(live, weights, 0.0) / weights[live].sum()
                step = float((left[live] / rate[live]).min())
            if stop is None:
                stop = min(total, int(np.ceil(at + step - 1e-9)))
                room = float(stop - at)
            step = min(step, room)
            if not live.any() or step <= 0:
                break
            left = np.maximum(0.0, left - rate * step)
            left[left < 1e-9 * (1 + halves)] = 0.0
            room -= step
            live = left > 0
            if room <= 1e-12:
                break
        at = max(at + 1, stop)
        line = halves - left
        ends.append(at)
        values.append(line.copy())
    values[-1] = halves.astype(float)
    return ends, values


def windows(halves: np.ndarray, weights: np.ndarray, length: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each window its first slot, the halves done before it and those in it, by source."""
    ends, values = target_lines(halves, weights)
    done = np.zeros(len(halves), np.int64)
    for start, end, low, high in zip(ends, ends[1:], values, values[1:]):
        slope = (high - low) / (end - start)
        for at in range(start, end, length):
            stop = min(at + length, end)
            line = low + slope * (stop - start)
            due = np.floor(line + 1e-9).astype(np.int64)
            now = np.minimum(np.maximum(done, due), halves)
            short = stop - int(now.sum())
            if short > 0:
                open_ = np.flatnonzero((now == due) & (now < halves) & (slope > 0))
                deadline = (due[open_] + 1 - line[open_]) / slope[open_]
                first = open_[np.lexsort((open_, deadline))[:short]]
                now[first] += 1
            for i in np.argsort(now - line, kind="stable")[: max(0, stop - int(now.sum()))]:
                now[i] += 1  # rounding of the lines only
            yield at, done, now - done
            done = now


def _fold() -> Column:
    """Earliest deadline first over the slots of one window with columns `counts` and `slots`.

    Half j of c may run from slot floor(j * L / c) and must run before slot ceil((j + 1) * L / c) of the
    window's L. The result is the sequence of places in `counts`.
    """
    released = (
        "transform(counts, (c, i) -> if(s.done[i] < c and (s.done[i] * slots) div c <= t, "
        "named_struct('deadline', ((s.done[i] + 1) * slots + c - 1) div c, 'src', i), null))"
    )
    return F.expr(
        "aggregate(sequence(0L, slots - 1), "
        "named_struct('done', transform(counts, c -> 0L), 'seq', cast(array() as array<int>)), "
        f"(s, t) -> transform(array(array_min(filter({released}, x -> x is not null)).src), p -> named_struct("
        "'done', transform(s.done, (d, i) -> if(i = p, d + 1, d)), 'seq', concat(s.seq, array(p))))[0], s -> s.seq)"
    )


def schedule(spark: SparkSession, rows: np.ndarray, weights: np.ndarray, half_rows: int, window: int) -> tuple[DataFrame, int]:
    """A row for each half: src, half, window, slot, first (position of its first row); and how many halves."""
    halves = -(-rows // half_rows)
    length = max(window, 16 * len(rows) if len(rows) > window // 16 else window)

    def plan() -> Iterator[dict]:
        for k, (start, done, counts) in enumerate(windows(halves, weights, length)):
            some = np.flatnonzero(counts)
            yield {
                "window": k, "start": start, "slots": int(counts.sum()), "first": int(np.minimum(rows, done * half_rows).sum()),
                "src": some.tolist(), "counts": counts[some].tolist(), "done": done[some].tolist(), "rows": rows[some].tolist(),
            }

    kind = "window long, start long, slots long, first long, src array<int>, counts array<long>, done array<long>, rows array<long>"
    table = plan_table(spark, plan(), kind, "windows").repartition(shuffle_partitions(spark), "window")
    placed = table.select("*", F.posexplode(_fold()).alias("in_window", "at"))
    nth = "done[at] + row_number() over (partition by window, at order by in_window) - 1"
    placed = placed.select("window", "start", "first", "in_window", F.expr("src[at]").alias("src"), F.expr(nth).alias("half"), F.expr("rows[at]").alias("n"))
    size = f"least({half_rows}L, n - half * {half_rows})"
    before = f"coalesce(sum({size}) over (partition by window order by in_window rows between unbounded preceding and 1 preceding), 0)"
    made = placed.select("src", "half", "window", (F.col("start") + F.col("in_window")).alias("slot"), (F.col("first") + F.expr(before)).alias("first"))
    return made, int(halves.sum())


def pfair_mix(
    docs: DataFrame,
    weights: dict[str | None, float] | None = None,
    block_rows: int = 32,
    window: int = 256,
    power: float = 0.7,
    source: str = "source",
    row_id: str = "doc_id",
) -> DataFrame:
    """Order all rows so that no source is ever a whole block away from its target share.

    weights: target weight of each source value (null is a source too), used as given. Without them
    a source with n rows weighs n ** power. Sources missing in `weights` get the least given weight.
    Where a source has run out, the others go on in their proportions; no row is dropped or
    repeated. Within a source, rows come in the order of a hash of `row_id`; rows that repeat or
    share an id, or have none, are spread by their place in the input, so `docs` must be a table that reads
    the same each time (files, or a checkpoint). Texts are only carried. Adds the columns block long (of
    the source), window long, slot long (of the half block, over all) and position long (of the row,
    gapless from 0); columns named like these four are replaced, any other name is free. An empty
    table returns no rows. Any number of sources: what the driver holds is a few numbers for each source
    and window.
    """
    spark = docs.sparkSession
    half_rows = max(1, block_rows // 2)
    made = {"block": "long", "window": "long", "slot": "long", "position": "long"}
    row, unpacked = kept_row(docs, made)
    table = docs.select(row, F.col(f"`{source}`").cast("string").alias("source"), F.col(f"`{row_id}`").alias("id"), F.monotonically_increasing_id().alias("nth"))
    counts = {s: n for s, n in table.groupBy("source").count().collect()}  # one row a source
    if not counts:
        return docs.select(*(F.col(f"`{c}`") for c in docs.columns if c not in made), *(F.lit(None).cast(t).alias(c) for c, t in made.items()))
    names = sorted(counts, key=lambda s: (s is not None, s))
    if weights is None:
        wanted = [float(counts[s]) ** power for s in names]
    else:
        if not weights or min(weights.values()) <= 0:
            raise ValueError("weights must be positive")
        wanted = [float(weights.get(s, min(weights.values()))) for s in names]
    rows = np.array([counts[s] for s in names], np.int64)
    slots, n_halves = schedule(spark, rows, np.array(wanted), half_rows, window)

    # Rank of each row in (source, hash of the id): exact splitters, one exchange.
    bits = max(1, (len(names) - 1).bit_length())
    numbers = plan_table(spark, ({"source": s, "src": k} for k, s in enumerate(names)), "source string, src int", "sources")
    numbers = F.broadcast(numbers) if len(names) <= BROADCAST_ROWS else numbers
    table = table.join(numbers, table["source"].eqNullSafe(numbers["source"])).drop("source")
    low = F.shiftrightunsigned(F.xxhash64("id", "nth"), 1 + bits)
    table = table.select("row", "src", F.shiftleft(F.col("src").cast("long"), 63 - bits).bitwiseOR(low).alias("key"))
    parts = shuffle_partitions(spark)
    cut = find_splitters(table, F.col("key"), F.lit(1), parts, 0.05)
    starts = np.concatenate([[0], np.cumsum(rows)[:-1]]).tolist()
    dealt = deal(table.withColumn("part", cut.part(F.col("key"))), "part", parts, ["key"])
    nth_row = F.element_at(longs([0, *cut.below]), F.col("part") + 1) + F.col("at") - F.element_at(longs(starts), F.col("src") + 1)
    ranked = dealt.select("row", "src", nth_row.alias("nth")).withColumn("half", F.expr(f"nth div {half_rows}"))
    placed = join_small(ranked, slots, ["src", "half"], n_halves, BROADCAST_ROWS)
    return placed.select(
        *unpacked,
        F.expr("half div 2").alias("block"),
        F.col("window"),
        F.col("slot"),
        (F.col("first") + F.col("nth") % half_rows).alias("position"),
    )


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mixed order of all documents: sources weigh their row count to the power 0.7."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source")
    return pfair_mix(docs).select("doc_id", "source", "block", "window", "slot", "position")


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the same documents in mixed order, first file to last, first row to last.

    All columns keep their values, whatever their names. Null sources are a source of their own; null
    and repeated ids, repeated rows and long texts are carried as they are. An empty table gives no rows.
    """
    row, unpacked = kept_row(docs)
    mixed = pfair_mix(docs.select(row, F.col("source"), F.col("doc_id")))
    parts = shuffle_partitions(spark)
    rows = max(1, docs.count())
    placed = mixed.select("row", "position", F.expr(f"cast(position * {parts} div {rows} as int)").alias("part"))
    return placed.repartitionById(parts, F.col("part")).sortWithinPartitions("position").select(*unpacked)
