"""A vector index at rest: vectors in cells around centroids, searched for many queries at once.

Centroids are fitted by iterated aggregation over all vectors. Each cell is a folder, so a query reads the
cells that it probes. The nearest cells give an upper bound of the k-th distance; by the triangle inequality a cell, or a
single vector, whose distance from its centroid differs too much from the query's cannot come below it. With exact=True
all other cells are then read, so the result is that of comparing every pair.
"""

from __future__ import annotations

import functools
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.sources.manifests import latest, opened_or_built, publish

CELLS, PROBES, TURNS = 64, 8, 6
#: Bytes of query vectors that are broadcast at once; more queries go in blocks.
QUERY_BYTES = 1 << 24
#: Distances may be off by so much, by rounding.
SLACK = 1e-9


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(-1, width)


def _squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances between the rows of a and those of b."""
    return np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * (a @ b.T), 0)


@dataclass(frozen=True)
class VectorIndex:
    spark: SparkSession
    root: str
    width: int
    centroids: np.ndarray
    #: Of each cell the largest distance of a vector from its centroid, and the number of its vectors.
    radius: np.ndarray
    counts: np.ndarray

    @classmethod
    def build(cls, vectors: DataFrame, root: str, id_: str, vector: str, attributes: list[str] = (), cells: int = CELLS, turns: int = TURNS) -> VectorIndex:
        """Index the vectors of most common length without missing or non-finite numbers; rows without an id are left out.

        The first centroids are the vectors whose ids have the least hashes. Each turn sums the vectors around each centroid
        within the tasks; the sums, cells times width numbers a task, are added up and the means are the next centroids.
        """
        spark = vectors.sparkSession
        numbers = F.col(vector).cast("array<double>")
        rows = vectors.where(F.col(id_).isNotNull()).select(F.col(id_).alias("id"), numbers.alias("vector"), *attributes)
        rows = rows.where(F.size("vector") > 0).where(F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
        common = rows.groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), "n").first()
        if common is None:
            raise ValueError("no vectors to index")
        width = common["n"]
        rows = rows.where(F.size("vector") == width)
        first = rows.orderBy(F.xxhash64("id"), "id").limit(cells).select("vector").collect()
        centroids = np.unique(np.array([r["vector"] for r in first]), axis=0)
        for _ in range(turns):
            centroids = cls._moved(rows, centroids, width)
        top, data = root, f"build-{uuid.uuid4().hex}"  # no other build touches these files
        root = f"{top}/{data}"
        cls._write(rows, root, centroids, width, attributes)
        about = spark.read.parquet(f"{root}/cells").groupBy("cell").agg(F.max("reach"), F.count("*")).collect()  # a row a cell
        radius, counts = np.zeros(len(centroids)), np.zeros(len(centroids))
        for cell, reach, n in about:
            radius[cell], counts[cell] = reach, n
        publish(spark, top, 1, {"data": data, "width": width, "centroids": centroids.tolist(), "radius": radius.tolist(), "counts": counts.tolist()})
        return cls.open(spark, top)

    @classmethod
    def open(cls, spark: SparkSession, root: str) -> VectorIndex:
        found = latest(spark, root)
        if found is None:
            raise ValueError(f"no index at {root}")
        about = found[1]
        return cls(spark, f"{root}/{about['data']}", about["width"], *(np.array(about[c], np.float64) for c in ("centroids", "radius", "counts")))

    @classmethod
    def open_or_build(cls, spark: SparkSession, root: str, vectors: DataFrame, id_: str, vector: str, **how) -> VectorIndex:
        return opened_or_built(spark, root, lambda: cls.open(spark, root), lambda: cls.build(vectors, root, id_, vector, **how))

    @staticmethod
    def _moved(rows: DataFrame, centroids: np.ndarray, width: int) -> np.ndarray:
        shared = rows.sparkSession.sparkContext.broadcast(centroids)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            near = shared.value
            sums, counts = np.zeros((len(near), width)), np.zeros(len(near), np.int64)
            for batch in filter(len, batches):
                x = _matrix(batch.column(0), width)
                cell = _squared(x, near).argmin(1)
                np.add.at(sums, cell, x)
                counts += np.bincount(cell, minlength=len(near))
            some = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(counts[some]), pa.array(list(sums[some]), pa.list_(pa.float64()))], names=["cell", "n", "sums"])

        parts = rows.select("vector").mapInArrow(run, "cell long, n long, sums array<double>")
        added = parts.select("cell", "n", F.posexplode("sums")).groupBy("cell", "pos").agg(F.sum("n").alias("n"), F.sum("col").alias("s"))
        moved = centroids.copy()
        for r in added.select("cell", "pos", (F.col("s") / F.col("n")).alias("mean")).collect():  # cells times width numbers
            moved[r["cell"], r["pos"]] = r["mean"]
        return np.unique(moved, axis=0)

    @staticmethod
    def _write(rows: DataFrame, root: str, centroids: np.ndarray, width: int, attributes: list[str]) -> None:
        shared = rows.sparkSession.sparkContext.broadcast(centroids)
        names = ["id", "vector", *attributes]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            near = shared.value
            for batch in filter(len, batches):
                d = _squared(_matrix(batch.column(1), width), near)
                cell = d.argmin(1)
                reach = np.sqrt(d[np.arange(len(d)), cell])
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell.astype(np.int32)), pa.array(reach)], names=[*names, "cell", "reach"])

        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*names).schema.fields)
        placed = rows.select(*names).mapInArrow(run, f"{schema}, cell int, reach double")
        # Ranges of (cell, distance): a cell with any share of the vectors is spread over files.
        parts = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
        placed.repartitionByRange(parts, "cell", "reach", "id").sortWithinPartitions("cell", "reach").write.mode("overwrite").partitionBy("cell").parquet(f"{root}/cells")

    # ---- search

    def search(self, queries: DataFrame, k: int, query_id: str = "query_id", vector: str = "vector", where: Column | None = None, probes: int = PROBES, exact: bool = True) -> DataFrame:
        """query_id, rank from 1, id, score: each query's k nearest by L2, score 1 / (1 + d^2), ties by id.

        where: a condition on the index's attributes, applied before any distance. Queries without an id or of another width are
        left out; ids of queries are long. Queries are worked on in blocks of bounded size; a block's cells are read once for all of them.
        """
        usable = queries.where(F.col(query_id).isNotNull()).select(F.col(query_id).cast("long").alias("q"), F.col(vector).cast("array<double>").alias("v")).where(F.size("v") == self.width)
        blocks = max(1, -(-usable.count() * self.width * 8 // QUERY_BYTES))
        found = [self._block(usable.where(F.pmod(F.xxhash64("q"), F.lit(blocks)) == b), k, where, probes, exact) for b in range(blocks)]
        return functools.reduce(DataFrame.unionByName, found)

    def _block(self, queries: DataFrame, k: int, where: Column | None, probes: int, exact: bool) -> DataFrame:
        held = queries.orderBy("q").collect()  # bounded by QUERY_BYTES
        ids = np.array([r["q"] for r in held], np.int64)
        q = np.array([r["v"] for r in held], np.float64).reshape(-1, self.width)
        distance = np.sqrt(_squared(q, self.centroids))
        chosen = np.zeros(distance.shape, bool)
        if len(ids):
            nearest = np.argsort(distance, axis=1, kind="stable")[:, :probes]
            np.put_along_axis(chosen, nearest, True, axis=1)
        if exact:
            bound = np.full(len(ids), np.inf)
            for r in self._near(ids, q, distance, chosen, bound, k, where).groupBy("query_id").agg(F.max("rank").alias("n"), F.max("d2").alias("d2")).collect():
                if r["n"] == k:
                    bound[np.searchsorted(ids, r["query_id"])] = r["d2"] ** 0.5
            bound = bound * (1 + SLACK) + SLACK
            chosen = distance - self.radius[None, :] <= bound[:, None]
            return self._near(ids, q, distance, chosen, bound, k, where).drop("d2")
        return self._near(ids, q, distance, chosen, np.full(len(ids), np.inf), k, where).drop("d2")

    def _near(self, ids: np.ndarray, q: np.ndarray, distance: np.ndarray, chosen: np.ndarray, bound: np.ndarray, k: int, where: Column | None) -> DataFrame:
        """The k nearest of each query among the cells chosen for it, no farther than its bound: query_id, rank, id, score, d2."""
        width = self.width
        shared = self.spark.sparkContext.broadcast((ids, q, distance, chosen, bound))
        cells = [int(c) for c in np.flatnonzero(chosen.any(axis=0) & (self.counts > 0))]
        table = self.spark.read.parquet(f"{self.root}/cells").where(F.col("cell").isin(cells) if cells else F.lit(False))
        table = table if where is None else table.where(where)
        kind = table.schema["id"].dataType.simpleString()

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, q, distance, chosen, bound = shared.value
            for batch in filter(len, batches):
                cell, reach = batch.column(2).to_numpy(), batch.column(3).to_numpy()
                x = _matrix(batch.column(1), width)
                for c in np.unique(cell):
                    rows, asking = np.flatnonzero(cell == c), np.flatnonzero(chosen[:, c])
                    if not len(asking):
                        continue
                    d2 = _squared(q[asking], x[rows])
                    # What the triangle inequality leaves, and of that each query's k nearest in this batch, ties kept.
                    keep = (np.abs(distance[asking, c][:, None] - reach[rows][None, :]) <= bound[asking][:, None]) & (d2 <= (bound[asking] ** 2)[:, None])
                    if len(rows) > k:
                        keep &= d2 <= np.partition(np.where(keep, d2, np.inf), k - 1, axis=1)[:, k - 1 : k]
                    a, b = np.nonzero(keep)
                    yield pa.RecordBatch.from_arrays([pa.array(ids[asking[a]]), batch.column(0).take(pa.array(rows[b])), pa.array(d2[a, b])], names=["query_id", "id", "d2"])

        near = table.select("id", "vector", F.col("cell").cast("int").alias("cell"), "reach").mapInArrow(run, f"query_id long, id {kind}, d2 double")
        rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.round("d2", 12), "id")).cast("int")
        return near.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "id", (1 / (1 + F.col("d2"))).alias("score"), "d2")

