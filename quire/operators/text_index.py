"""An inverted index at rest: postings in blocks, by term, with a score bound for each block.

Terms are dealt into buckets, which are folders, so a query reads the buckets of its terms only. Within a
bucket the lists are sorted by term and hold blocks of up to 128 documents, those with the most to add first; a list
of very many documents is kept in segments by document, so no task ever holds a whole one. For the best k, the first
blocks give a lower bound of the k-th score, and blocks that cannot reach it with the best of all other
terms added are not read. Texts are never read by a query.
"""

from __future__ import annotations

import json
import math
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.functions.fields import once
from quire.functions.text import index_terms, query_terms
from quire.operators.retrieval import K1, B
from quire.sources.manifests import latest, opened_or_built, publish
from quire.sources.tables import bucket_of

BLOCK = 128
BUCKETS = 32
#: Documents of a segment.
SEGMENT = 1_000_000
#: Words whose postings one task sorts and writes, about.
SLICE = 1_000_000


def _counts(words: Column) -> Column:
    """Each distinct word with its occurrences, as structs (term, tf): the runs of the sorted words."""

    def runs(s: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(1), F.size(s)), lambda i: (i == 1) | (F.get(s, i - 1) != F.get(s, i - 2)))
        return F.when(F.size(s) > 0, once(starts, lambda at: F.transform(at, lambda p, j: F.struct(F.get(s, p - 1).alias("term"), (F.coalesce(F.get(at, j + 1), F.size(s) + 1) - p).alias("tf")))))

    return once(F.sort_array(words), runs)


@dataclass(frozen=True)
class TextIndex:
    spark: SparkSession
    #: The folder of this build's tables.
    root: str
    doc_id: str
    fields: tuple[str, ...]
    buckets: int
    docs: int
    #: Terms of each field in all documents.
    terms: dict[str, int]
    #: Highest impact of any posting is below K1 + 1; impacts were taken with these.
    k1: float
    b: float
    #: Of the postings.
    schema: T.StructType

    # ---- building

    @classmethod
    def build(
        cls, docs: DataFrame, root: str, doc_id: str, fields: list[str], attributes: list[str] = (), buckets: int = BUCKETS, segment: int = SEGMENT, k1: float = K1, b: float = B
    ) -> TextIndex:
        """Index the text columns `fields` of docs, as version 1 in the folder root.

        Each build writes into a folder of its own, which the manifest names, so no other build touches its files; Conflict if another was first.
        attributes: columns that queries filter by. Null texts have no terms; rows without an id are left out; each id comes once.
        """
        spark, top = docs.sparkSession, root
        data = f"build-{uuid.uuid4().hex}"
        root = f"{top}/{data}"
        rows = docs.where(F.col(doc_id).isNotNull()).select(
            F.col(doc_id).alias("doc_id"), *(F.col(a) for a in attributes), *(index_terms(F.col(f)).alias(f"_w{i}") for i, f in enumerate(fields))
        )
        about = rows.select("doc_id", *attributes, *(F.size(f"_w{i}").alias(f"_len{i}") for i in range(len(fields))))
        about.write.mode("overwrite").parquet(f"{root}/documents")
        n, *sizes = spark.read.parquet(f"{root}/documents").agg(F.count("*"), *(F.coalesce(F.sum(f"_len{i}"), F.lit(0)) for i in range(len(fields)))).first()

        # A text's terms are counted in its row, so postings are exchanged once; numbers that follow from others are worked out after.
        each = F.explode(F.array(*(F.struct(F.lit(i).alias("field"), F.col(f"_w{i}").alias("words")) for i in range(len(fields)))))
        entries = rows.select("doc_id", each.alias("f")).select("doc_id", "f.field", F.size("f.words").alias("length"), F.explode(_counts(F.col("f.words"))).alias("e"))
        mean = F.create_map(*(F.lit(x) for i, s in enumerate(sizes) for x in (i, s / n if n and s else 1.0)))
        impact = F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("length") / mean[F.col("field")]))
        segments, words = max(1, -(-n // segment)), sum(map(int, sizes))
        # A bucket's terms are dealt to slices, as many as keep what one task sorts at the same size however large the index.
        slices = max(1, -(-words // (buckets * segments * SLICE)))
        part = F.pmod(F.xxhash64("doc_id"), F.lit(segments)) * slices + F.pmod(F.xxhash64("term", F.lit(1)), F.lit(slices))
        dealt = entries.select("doc_id", "field", "length", "e.*").withColumns({"bucket": bucket_of(F.col("term"), buckets), "segment": part.cast("int")})
        # One exchange by (bucket, segment); ranking, blocks and files all follow that partitioning.
        group = ["bucket", "segment", "field", "term"]
        tasks = min(buckets * segments * slices, max(1, 4 * words // SLICE))
        dealt = dealt.repartition(tasks, "bucket", "segment").withColumn("impact", impact)
        place = F.row_number().over(Window.partitionBy(*group).orderBy(F.desc("impact"), "doc_id")) - 1
        placed = dealt.withColumn("block", F.floor(place / BLOCK).cast("int"))
        blocks = placed.groupBy(*group, "block").agg(
            F.collect_list(F.struct("doc_id", "tf", "length")).alias("postings"), F.max("impact").alias("best"), F.count("*").cast("int").alias("n")
        )
        blocks.sortWithinPartitions("bucket", "term", "field", F.desc("best")).write.mode("overwrite").partitionBy("bucket").parquet(f"{root}/postings")
        publish(spark, top, 1, {"data": data, "doc_id": doc_id, "fields": list(fields), "buckets": buckets, "docs": n, "terms": dict(zip(fields, map(int, sizes))), "k1": k1, "b": b, "schema": blocks.schema.json()})
        return cls.open(spark, top)

    @classmethod
    def open(cls, spark: SparkSession, root: str) -> TextIndex:
        found = latest(spark, root)
        if found is None:
            raise ValueError(f"no index at {root}")
        about = found[1]
        return cls(spark, f"{root}/{about['data']}", about["doc_id"], tuple(about["fields"]), about["buckets"], about["docs"], about["terms"], about["k1"], about["b"], T.StructType.fromJson(json.loads(about["schema"])))

    @classmethod
    def open_or_build(cls, spark: SparkSession, root: str, docs: DataFrame, doc_id: str, fields: list[str], attributes: list[str] = (), **how) -> TextIndex:
        """The index in the folder root, built there if no build has been completed; of builds at one time the first to be complete counts."""
        return opened_or_built(spark, root, lambda: cls.open(spark, root), lambda: cls.build(docs, root, doc_id, fields, attributes, **how))

    # ---- reading

    def documents(self) -> DataFrame:
        """doc_id and the attributes, and each field's length as _len0, _len1, ...: narrow rows without texts."""
        return self.spark.read.parquet(f"{self.root}/documents")

    def blocks(self, words: list[str]) -> DataFrame:
        """The blocks of these terms: their buckets are the only folders read."""
        table = self.spark.read.schema(self.schema).parquet(f"{self.root}/postings")
        inside = F.lit(False)
        for w in words:
            inside = inside | (F.col("bucket") == bucket_of(F.lit(w), self.buckets))
        return table.where(inside & F.col("term").isin(list(words)))

    def scores(self, query: str, boosts: dict[str, float] | None = None, allowed: DataFrame | None = None) -> DataFrame:
        """doc_id, score of all documents with a term of the query: BM25, the largest of the boosted fields.

        allowed: rows of documents() that the search is about; numbers of documents and lengths are then theirs alone.
        """
        words = query_terms(query)
        boosts = boosts or {self.fields[0]: 1.0}
        if not words:
            return self.documents().select("doc_id", F.lit(0.0).alias("score")).limit(0)
        entries = self._entries(self.blocks(words), boosts)
        numbers = {f: self.fields.index(f) for f in boosts}
        if allowed is None:
            df = entries.groupBy("field", "term").agg(F.count("*").alias("df"))
            docs, sizes = F.lit(self.docs), {i: F.lit(self.terms[f]) for f, i in numbers.items()}
        else:
            entries = entries.join(allowed.select("doc_id"), "doc_id", "left_semi")
            df = entries.groupBy("field", "term").agg(F.count("*").alias("df"))
            df = df.crossJoin(F.broadcast(allowed.agg(F.count("*").alias("docs"), *(F.sum(f"_len{i}").alias(f"all{i}") for i in numbers.values()))))  # one row
            docs, sizes = F.col("docs"), {i: F.col(f"all{i}") for i in numbers.values()}
        all_terms = F.coalesce(*(F.when(F.col("field") == i, size) for i, size in sizes.items()))
        # A row for each term and field of the query.
        counts = df.select("field", "term", F.log(1 + (docs - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"), (all_terms / docs).alias("mean"))
        norm = F.col("tf") + self.k1 * (1 - self.b + self.b * F.col("length") / F.col("mean"))
        part = F.col("idf") * F.col("tf") * (self.k1 + 1) / norm
        return self._best_field(entries.join(F.broadcast(counts), ["field", "term"]).withColumn("part", part), words, boosts)

    def top(self, query: str, k: int, boosts: dict[str, float] | None = None) -> DataFrame:
        """doc_id, score, rank from 1 of the k best over all documents, ties by doc_id, from the blocks that can hold them."""
        words = query_terms(query)
        boosts = boosts or {self.fields[0]: 1.0}
        chosen = self._reachable(words, k, boosts) if words else None
        if chosen is None:
            return self.scores("", boosts).withColumn("rank", F.lit(0))
        blocks, idf = chosen
        best = self._best_field(self._parts(self._entries(blocks, boosts), idf), words, boosts).orderBy(F.desc("score"), "doc_id").limit(k)
        return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "doc_id")).cast("int"))  # k rows

    def _reachable(self, words: list[str], k: int, boosts: dict[str, float]) -> tuple[DataFrame, dict] | None:
        """The blocks that may hold one of the k best, and the weight of each (field, term)."""
        blocks = self.blocks(words)
        heads = blocks.groupBy("field", "term").agg(F.sum("n").alias("df"), F.max("best").alias("best"), F.max("block").alias("last")).collect()  # a row a term and field
        heads = [h for h in heads if self.fields[h.field] in boosts]
        if not heads:
            return None
        idf = {(h.field, h.term): math.log(1 + (self.docs - h.df + 0.5) / (h.df + 0.5)) for h in heads}
        if max(h["last"] for h in heads) == 0:
            return blocks, idf
        first = self._best_field(self._parts(self._entries(blocks.where("block = 0"), boosts), idf), words, boosts)
        sums = sorted(r[0] for r in first.select("score").orderBy(F.desc("score")).limit(k).collect())
        if len(sums) < k:
            return blocks, idf
        bound = sums[0] * (1 - 1e-9)
        all_best = {f: sum(idf[h.field, h.term] * h.best for h in heads if h.field == f) for f in {h.field for h in heads}}
        keep = F.lit(False)
        for h in heads:
            boost = boosts[self.fields[h.field]]
            least = (bound / boost - all_best[h.field]) / idf[h.field, h.term] + h.best
            keep = keep | ((F.col("field") == h.field) & (F.col("term") == h.term) & (F.col("best") >= least))
        return blocks.where(keep), idf

    def _entries(self, blocks: DataFrame, boosts: dict[str, float]) -> DataFrame:
        wanted = [self.fields.index(f) for f in boosts]
        return blocks.where(F.col("field").isin(wanted)).select("field", "term", F.explode("postings").alias("p")).select("field", "term", "p.*")

    def _parts(self, entries: DataFrame, idf: dict) -> DataFrame:
        """Entries with their part of the score, all numbers known."""
        weight, mean = F.lit(None).cast("double"), F.lit(None).cast("double")
        for (field, term), w in idf.items():
            weight = F.coalesce(F.when((F.col("field") == field) & (F.col("term") == term), F.lit(w)), weight)
        for i, f in enumerate(self.fields):
            mean = F.coalesce(F.when(F.col("field") == i, F.lit(max(1, self.terms[f]) / max(1, self.docs))), mean)
        norm = F.col("tf") + self.k1 * (1 - self.b + self.b * F.col("length") / mean)
        return entries.withColumn("part", weight * F.col("tf") * (self.k1 + 1) / norm)

    def _best_field(self, parts: DataFrame, words: list[str], boosts: dict[str, float]) -> DataFrame:
        """The largest of the boosted fields. Parts are added in the order of the words, so equal documents have equal scores to the last bit."""
        numbers = {f: self.fields.index(f) for f in boosts}
        cells = [(i, j) for i in numbers.values() for j in range(len(words))]
        of = {(i, j): F.sum(F.when((F.col("field") == i) & (F.col("term") == words[j]), F.col("part"))).alias(f"s{i}_{j}") for i, j in cells}
        summed = parts.groupBy("doc_id").agg(*of.values())
        best: list[Column] = []
        for f, i in numbers.items():
            each = [F.col(f"s{i}_{j}") for j in range(len(words))]
            total = F.lit(0.0)
            for c in each:
                total = total + F.coalesce(c, F.lit(0.0))
            best.append(F.when(F.coalesce(*each).isNotNull(), total) * boosts[f])
        return summed.select("doc_id", (best[0] if len(best) == 1 else F.greatest(*best)).alias("score"))
