"""Operator 9, exact top-k search: tiled matrix products with a selection in each tile.

Vectors are cut into blocks (shards) of a bounded number of rows and queries into tiles. Each task
multiplies query tiles with its shards one product at a time, keeps each query's k best of the
product, merges them with what it has for that tile, and hands on k rows a query. Spark merges
these lists in two more levels, before and after one exchange by query.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.llm.common import materialize, shuffle_partitions

#: Query tiles are broadcast only up to this many bytes of vectors; beyond, they go by shuffle.
BROADCAST_BYTES = 16 << 20

_BLOCK = "dim int, shard long, ids binary, vectors binary"
_TILE = "dim int, tile long, q_ids binary, q_rows binary, q_vectors binary"
_HIT = "q_row long, query_id long, vec_id long, v_row long, score decimal(38,0)"


def _scaled(column: pa.Array, scale: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lengths, validity and all integer components of an array<float> column."""
    column = column.cast(pa.list_(pa.float64())) if column.type.value_type != pa.float64() else column
    lengths = np.diff(column.offsets.to_numpy())
    start = column.offsets[0].as_py() if len(column) else 0
    flat = column.values.slice(start, int(lengths.sum()))
    x = flat.to_numpy(zero_copy_only=False)  # nulls become nan
    owner = np.repeat(np.arange(len(column)), lengths)
    good = np.ones(len(column), bool)
    good[owner[~np.isfinite(x)]] = False
    if column.null_count:
        good &= column.is_valid().to_numpy(zero_copy_only=False)
    return lengths, good, np.floor(scale * np.where(np.isfinite(x), x, 0.0))


def vector_blocks(vectors: DataFrame, scale: int = 256, rows: int = 2048, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """Blocks of up to `rows` vectors of one length as packed float64 integers, as a written table.

    Vectors that are null, hold a null or non-finite component, or have a null id take no part.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        count: dict[int, int] = {}
        made = 0

        def block(dim: int) -> pa.RecordBatch:
            nonlocal made
            ids = np.concatenate([i for i, _ in held[dim]])
            data = np.concatenate([v for _, v in held[dim]])
            held[dim], count[dim] = [], 0
            made += 1
            return pa.RecordBatch.from_arrays(
                [pa.array([dim], pa.int32()), pa.array([made], pa.int64()), pa.array([ids.tobytes()]), pa.array([data.tobytes()])],
                names=["dim", "shard", "ids", "vectors"],
            )

        for batch in batches:
            ids = batch.column(0)
            lengths, good, flat = _scaled(batch.column(1), scale)
            if ids.null_count:
                good &= ids.is_valid().to_numpy(zero_copy_only=False)
            ids = ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            starts = np.concatenate([[0], np.cumsum(lengths)])
            for dim in np.unique(lengths[good]).tolist():
                at = np.flatnonzero(good & (lengths == dim))
                for k in range(0, len(at), rows):
                    some = at[k : k + rows]
                    held.setdefault(dim, []).append((ids[some], flat[starts[some][:, None] + np.arange(dim)].reshape(len(some), dim)))
                    count[dim] = count.get(dim, 0) + len(some)
                    if count[dim] >= rows:
                        yield block(dim)
        for dim in [d for d, n in count.items() if n]:
            yield block(dim)

    packed = vectors.select(F.col(vec_id).cast("long").alias("i"), F.col(embedding).alias("v")).mapInArrow(run, _BLOCK)
    # The task and the block's number in it give each block an id that is fixed by being written.
    return materialize(packed.withColumn("shard", F.spark_partition_id().cast("long") * (1 << 24) + F.col("shard")), "blocks")


def _tiles(blocks: DataFrame, modulus: int, rows: int = 1024) -> DataFrame:
    """The rows of blocks whose id is divisible by `modulus`, in tiles of up to `rows` queries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple]] = {}

        def tile(dim: int) -> pa.RecordBatch:
            parts = held.pop(dim)
            cols = [np.concatenate([p[k] for p in parts]) for k in range(3)]
            name = int(cols[1][0])  # a row number: no other tile holds it
            return pa.RecordBatch.from_arrays(
                [pa.array([dim], pa.int32()), pa.array([name], pa.int64()), *(pa.array([c.tobytes()]) for c in cols)],
                names=["dim", "tile", "q_ids", "q_rows", "q_vectors"],
            )

        for batch in batches:
            for dim, shard, ids, data in zip(*(c.to_pylist() for c in batch.columns)):
                ids = np.frombuffer(ids, np.int64)
                at = np.flatnonzero(ids % modulus == 0)
                if len(at):
                    v = np.frombuffer(data, np.float64).reshape(len(ids), dim)[at]
                    held.setdefault(dim, []).append((ids[at], (shard << 20) + at, v))
                    if sum(len(p[0]) for p in held[dim]) >= rows:
                        yield tile(dim)
        for dim in list(held):
            yield tile(dim)

    return blocks.mapInArrow(run, _TILE)


def best_of(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Per row the columns of the k highest scores, ties to the smaller id; and how many are real.

    `ids` ascend. Scores are integers in float64; -inf means no candidate.
    """
    n = scores.shape[1]
    k = min(k, n)
    most = np.abs(np.where(np.isfinite(scores), scores, 0)).max(initial=0)
    if most * n < 2**52:  # one exact number orders by score, then by place
        keyed = scores * n + (n - 1 - np.arange(n))
        top = np.argpartition(-keyed, k - 1, axis=1)[:, :k] if k < n else np.broadcast_to(np.arange(n), scores.shape)
        order = np.argsort(-np.take_along_axis(keyed, top, 1), axis=1, kind="stable")
        top = np.take_along_axis(top, order, 1)
    else:
        top = np.argsort(-scores, axis=1, kind="stable")[:, :k]
    return top, np.isfinite(np.take_along_axis(scores, top, 1)).sum(axis=1)


def _exact_product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Integer inner products. Beyond what float64 holds exactly, Python integers are used."""
    bound = np.abs(a).max(initial=0) * np.abs(b).max(initial=0) * max(1, a.shape[1])
    if bound < 2**53:
        return a @ b.T
    whole = lambda m: np.array([[int(x) for x in row] for row in m], object).reshape(m.shape)
    return whole(a) @ whole(b).T


def top_k(
    vectors: DataFrame, modulus: int = 50, k: int = 5, scale: int = 256, vec_id: str = "vec_id", embedding: str = "embedding"
) -> DataFrame:
    """query_id, rank from 1, vec_id, score: each query's k highest integer inner products.

    Components x count as floor(scale * x). Queries are the rows whose id is divisible by `modulus`,
    candidates all rows but the query's own. Ties go to the smaller id. Vectors of different
    lengths are never compared; see vector_blocks for those that take no part. A repeated row is a
    candidate, and a query, of its own. Empty tables and tables without queries give no rows.
    Scores beyond a long raise an error in the final cast.
    """
    spark = vectors.sparkSession
    blocks = vector_blocks(vectors, scale, vec_id=vec_id, embedding=embedding)
    tiles = materialize(_tiles(blocks, modulus), "tiles")
    size = tiles.agg(F.sum(F.octet_length("q_vectors"))).first()[0] or 0
    parts = shuffle_partitions(spark)
    spread = blocks.repartition(parts, "shard")
    if size <= BROADCAST_BYTES:
        pairs = spread.join(F.broadcast(tiles), "dim")
    else:  # each block meets each tile; tiles are copied once a group of blocks
        spread = blocks.withColumn("group", F.pmod(F.xxhash64("shard"), F.lit(parts)).cast("int"))
        copies = tiles.withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
        pairs = spread.join(copies, ["dim", "group"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[dict[int, list[tuple]]]] = {}

        def out() -> Iterator[pa.RecordBatch]:
            rows = [(q, qid, v, row, score) for best in held.values() for (q, qid), hits in best.items() for score, v, row in hits]
            held.clear()
            if rows:
                q, qid, v, row, score = zip(*rows)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(q, pa.int64()), pa.array(qid, pa.int64()), pa.array(v, pa.int64()), pa.array(row, pa.int64()), pa.array(score, pa.decimal128(38, 0))],
                    names=["q_row", "query_id", "vec_id", "v_row", "score"],
                )

        n_held = 0
        for batch in batches:
            names = batch.schema.names
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                r = dict(zip(names, row))
                dim = r["dim"]
                ids = np.frombuffer(r["ids"], np.int64)
                data = np.frombuffer(r["vectors"], np.float64).reshape(len(ids), dim)
                rows = (r["shard"] << 20) + np.arange(len(ids))
                order = np.lexsort((rows, ids))
                ids, data, rows = ids[order], data[order], rows[order]
                q_ids, q_rows = np.frombuffer(r["q_ids"], np.int64), np.frombuffer(r["q_rows"], np.int64)
                queries = np.frombuffer(r["q_vectors"], np.float64).reshape(len(q_ids), dim)
                best = held.setdefault(r["tile"], {})
                for at in range(0, len(q_ids), 256):
                    scores = _exact_product(queries[at : at + 256], data)
                    own = {int(x): j for j, x in enumerate(rows)} if np.isin(q_rows[at : at + 256], rows).any() else {}
                    exact = scores.dtype != object
                    if exact:
                        for i, q in enumerate(q_rows[at : at + 256].tolist()):
                            if q in own:
                                scores[i, own[q]] = -np.inf
                        top, real = best_of(scores, ids, k)
                    for i, (q, qid) in enumerate(zip(q_rows[at : at + 256].tolist(), q_ids[at : at + 256].tolist())):
                        if exact:
                            js = top[i, : real[i]].tolist()
                        else:
                            js = sorted((j for j in range(len(ids)) if own.get(q) != j), key=lambda j: (-scores[i, j], j))[:k]
                        new = [(int(scores[i, j]), int(ids[j]), int(rows[j])) for j in js]
                        old = best.get((q, qid))
                        best[q, qid] = new if old is None else sorted(old + new, key=lambda h: (-h[0], h[1], h[2]))[:k]
                        n_held += old is None
            if n_held > 100_000:
                yield from out()
                n_held = 0
        yield from out()

    hits = pairs.mapInArrow(run, _HIT)
    order = Window.partitionBy("q_row").orderBy(F.desc("score"), "vec_id", "v_row")
    return (
        hits.withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= k)
        .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", F.col("score").cast("long").alias("score"))
    )


def op9_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest by integer inner product for every 50th vector, against all vectors."""
    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))


#: The whole product by SQL over exploded components.
OP9_SQL = """
WITH ok AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), pairs AS (
  SELECT q.r AS q_row, q.vec_id AS query_id, c.vec_id AS vec_id,
    CAST(coalesce(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])), 0) AS BIGINT) AS score
  FROM ok q JOIN ok c ON q.vec_id % 50 = 0 AND q.r <> c.r AND len(q.v) = len(c.v)
), ranked AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY q_row ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
  FROM pairs
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""
