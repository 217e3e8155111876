"""Running sums within keys of any size: sorted ranges that are summed apart, and a carry between them."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import materialize, shuffle_partitions


def running_sums(df: DataFrame, key: str, order: Sequence[str], values: Sequence[str], keep: Sequence[str], name: str, cuts: Sequence[str] | None = None) -> DataFrame:
    """key, keep and, in place of each of `values`, its sum over the key's rows up to this one in `order`.

    key, keep and values are long columns, the key and values without nulls; sums wrap around at 64 bits. The
    rows are cut into even ranges of (key, order), so a key with any share of all rows is spread over
    tasks. Each range is summed by its task and written; of each range only its last row comes to the driver, which
    adds up what the ranges of one key hand on. Rows that tie in `order` come in any order. `cuts` names the
    columns that ranges are cut by, if not `order`: a sample of them comes to the driver, so they should be short.
    """
    columns = [key, *keep, *values]
    n = len(values)
    ranges = df.repartitionByRange(shuffle_partitions(df.sparkSession), key, *(order if cuts is None else cuts)).sortWithinPartitions(key, *order)
    ranges = ranges.select(*columns, F.spark_partition_id().cast("long").alias("part"))
    schema = ", ".join(f"`{c}` long" for c in columns)

    def within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, base, held, single = None, np.zeros((n, 1), np.int64), None, True
        for batch in filter(len, batches):
            keys = batch.column(0).to_numpy()
            change = keys[1:] != keys[:-1]
            runs = np.concatenate([[0], np.cumsum(change)])
            total = np.cumsum([batch.column(len(columns) - n + j).to_numpy() for j in range(n)], axis=1)
            before = np.concatenate([np.zeros((n, 1), np.int64), total[:, np.flatnonzero(change)]], axis=1)
            if last is not None and keys[0] == last:
                before[:, 0] -= base[:, 0]
            single = single and not change.any() and (last is None or keys[0] == last)
            total = total - before[:, runs]
            last, base = keys[-1], total[:, -1:]
            if held is not None:
                yield closed(held, False, False)
            held = batch, total
        if held is not None:
            yield closed(held, True, single)

    def closed(held: tuple, end: bool, single: bool) -> pa.RecordBatch:
        batch, total = held
        tail = np.zeros(len(batch), bool)
        tail[-1] = end
        whole = tail & single
        arrays = [batch.column(j) for j in range(len(columns) - n)] + [pa.array(t) for t in total]
        return pa.RecordBatch.from_arrays(arrays + [batch.column(len(columns)), pa.array(tail), pa.array(whole)], names=[*columns, "part", "tail", "whole"])

    summed = materialize(ranges.mapInArrow(within, f"{schema}, part long, tail boolean, whole boolean"), name)
    tails = {r["part"]: r for r in summed.where("tail").select("part", key, *values, "whole").collect()}  # a row a task
    carry: dict[int, tuple[int, list[int]]] = {}
    reached: tuple[int, list[int]] | None = None
    for part, row in sorted(tails.items()):
        if reached is not None:
            carry[part] = reached
        sums = [row[v] for v in values]
        if row["whole"] and reached is not None and reached[0] == row[key]:
            sums = [a + b for a, b in zip(sums, reached[1])]
        reached = row[key], sums
    if not carry:
        return summed.select(*columns)
    size = max(carry) + 1
    keys_on, sums_on = np.zeros(size, np.int64), np.zeros((n, size), np.int64)
    carries = np.zeros(size, bool)
    for part, (k, sums) in carry.items():
        carries[part], keys_on[part] = True, k
        sums_on[:, part] = [(s + (1 << 63)) % (1 << 64) - (1 << 63) for s in sums]

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in filter(len, batches):
            part = batch.column(len(columns)).to_numpy()
            on = carries[part] & (keys_on[part] == batch.column(0).to_numpy())
            arrays = [batch.column(j) for j in range(len(columns) - n)]
            arrays += [pa.array(batch.column(len(columns) - n + j).to_numpy() + np.where(on, sums_on[j][part], 0)) for j in range(n)]
            yield pa.RecordBatch.from_arrays(arrays, names=columns)

    return summed.select(*columns, "part").mapInArrow(add, schema)
