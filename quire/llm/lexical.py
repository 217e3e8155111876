"""Operator 13, ranked lexical search by TPUT over postings that are partitioned by term.

A document's part in a score depends, but for a weight of the term, on the term's count and the document's length
only, so each term's list is sorted once by that impact; ranges of (term, impact) are cut evenly, and a list of any
length is spread over files. All queries are then answered in three phases. First the heads of the lists, k
entries each, give partial sums, of which the k-th is a lower bound of a query's k-th score. A document that
stays below an even share of that bound in each of the query's lists cannot reach it: secondly every
list is fetched down to that one share. Sums of what was fetched, with the share for what was not, bound
each document from above. Third, for documents whose upper bound reaches the k-th of the new sums, all their entries are
looked up, and the exact scores ranked.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.llm.common import clear_written, join_small, materialize, shuffle_partitions, written
from quire.llm.shingles import word_hashes

#: Rows up to which terms, thresholds and candidates are broadcast.
BROADCAST_ROWS = 200_000
#: Bytes of text taken at once.
SLICE = 1 << 21

#: Letters and digits of ASCII and all else beyond it make up terms; other bytes part them.
_TERM = np.full(256, 0x20, np.uint8)
for _a, _b in ((ord("0"), ord("9")), (ord("A"), ord("Z")), (ord("a"), ord("z")), (0x80, 0xFF)):
    _TERM[_a : _b + 1] = np.arange(_a, _b + 1)


def term_counts(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """Slices of texts: place of the first, terms of each text, and of each term its text and its hash; A-Z are lower-cased."""
    texts = texts.fill_null("") if texts.null_count else texts
    wide = "<i8" if pa.types.is_large_string(texts.type) else "<i4"
    _, places, raw = texts.buffers()
    offsets = np.frombuffer(places, wide)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    k = 0
    while k < len(texts):
        stop = max(k + 1, int(np.searchsorted(offsets, offsets[k] + SLICE, "right")) - 1)
        terms, owner = word_hashes(_TERM[data[offsets[k] : offsets[stop]]], offsets[k : stop + 1] - offsets[k])
        yield k, np.bincount(owner, minlength=stop - k), owner, terms.view(np.int64)
        k = stop


def _grouped(owner: np.ndarray, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (owner, term), and how often each occurs."""
    order = np.lexsort((terms, owner))
    owner, terms = owner[order], terms[order]
    first = np.flatnonzero(np.concatenate([[True], (owner[1:] != owner[:-1]) | (terms[1:] != terms[:-1])])) if len(owner) else owner
    return owner[first], terms[first], np.diff(np.concatenate([first, [len(owner)]]))


def _query_terms(items: DataFrame) -> DataFrame:
    """(item, term, mult): the distinct terms of each item and how often each occurs in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in filter(len, batches):
            for k, n, owner, terms in term_counts(batch.column(1)):
                owner, terms, mult = _grouped(owner, terms)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(owner + k)), pa.array(terms), pa.array(mult)], names=["item", "term", "mult"])

    rows = items.where("item_id is not null").select(F.col("item_id").cast("long").alias("item"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "item long, term long, mult long").groupBy("item", "term").agg(F.sum("mult").alias("mult"))


def _presence(keys: DataFrame, key: str, bits: int) -> np.ndarray:
    """A map of 2**bits bits, filled where the keys are; at most 2**bits / 32 sums come to the driver."""
    low = F.pmod(key, F.lit(1 << bits))
    words = keys.groupBy(F.shiftright(low, 5).alias("w")).agg(F.expr(f"bit_or(shiftleft(1L, cast(pmod({key}, 32) as int)))").alias("b")).toArrow()
    found = np.zeros(max(1, (1 << bits) // 32), np.uint32)
    found[words.column("w").to_numpy()] = words.column("b").to_numpy().astype(np.uint32)
    return found


def _read(docs: DataFrame, wanted: np.ndarray, bits: int) -> DataFrame:
    """A row (row, doc_id, n) for each document, n its terms, and rows (row, n, term, tf) for its terms that the map holds.

    row tells documents apart, those of one doc_id as well.
    """
    shared = docs.sparkSession.sparkContext.broadcast(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = shared.value
        names = ["row", "doc_id", "n", "term", "tf"]
        for batch in filter(len, batches):
            rows = batch.column(0).to_numpy()
            for k, n, owner, terms in term_counts(batch.column(2)):
                here, none = rows[k : k + len(n)], pa.nulls(len(n), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(here), batch.column(1).slice(k, len(n)), pa.array(n), none, none], names=names)
                low = terms & ((1 << bits) - 1)
                held = (wanted[low >> 5] >> (low & 31).astype(np.uint32)) & np.uint32(1) == 1
                owner, terms, tf = _grouped(owner[held], terms[held])
                none = pa.nulls(len(owner), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(here[owner]), none, pa.array(n[owner]), pa.array(terms), pa.array(tf)], names=names)

    texts = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(run, "row long, doc_id long, n long, term long, tf long")


def _kth(sums: DataFrame, k: int) -> DataFrame:
    """(item, bound): each item's k-th highest sum, 0 where there are fewer."""
    place = F.row_number().over(Window.partitionBy("item").orderBy(F.col("s").desc()))
    best = sums.select("item", "s", place.alias("place")).where(F.col("place") <= k)
    return best.groupBy("item").agg(F.coalesce(F.max(F.when(F.col("place") == k, F.col("s"))), F.lit(0).cast("long")).alias("bound"))


def ranked_search(docs: DataFrame, items: DataFrame, k: int = 20) -> DataFrame:
    """item_id, rank, doc_id, score: the k highest-scoring documents (doc_id, text) of each item (item_id, text).

    Terms are runs of ASCII letters and digits and of all characters beyond ASCII, A-Z lower-cased, compared by a
    64-bit hash. With N documents that have terms, L terms in all, n in a document, df documents with a term and tf of
    it in one, a term weighs w = floor(1000 * ln((2 N + 2) / (2 df + 1))) and a document m = 75 + 25 n N div L; each
    occurrence in the item adds w * (10**9 tf div (1000 tf + 12 m)). Only scores above 0 are ranked, ties by
    doc_id, null last. Rows of one doc_id are documents of their own; repeated ones rank one after
    another. Rows of one item_id are one item, with the terms of all; those without an id are left out, as are items without
    terms or hits. Null and empty texts have no terms. Long texts are read whole, other columns ignored; empty
    tables give no rows.
    """
    spark, others = docs.sparkSession, set(written())
    queries = materialize(_query_terms(items), "queries")
    terms = materialize(queries.select("term").distinct(), "terms")
    n_terms, n_queries = terms.count(), queries.count()
    bits = min(26, max(16, (64 * n_terms).bit_length()))
    read = materialize(_read(docs, _presence(terms, "term", bits), bits), "read")
    documents = read.where("term is null").select("row", "doc_id", "n")
    held = documents.where("n > 0").agg(F.count("*").alias("docs"), F.sum("n").alias("terms")).first()
    n_docs, all_terms = held["docs"], max(1, held["terms"] or 0)

    entries = read.where("term is not null")
    df = entries.groupBy("term").agg(F.count("*").alias("df"))
    weight = F.floor(1000 * F.log((2.0 * n_docs + 2) / (2.0 * F.col("df") + 1))).cast("long")
    weights = materialize(terms.join(df, "term").select("term", "df", weight.alias("w")).where("w > 0"), "weights")
    impact = F.expr(f"(1000000000L * tf) div (1000L * tf + 12L * (75L + (25L * n * {n_docs}L) div {all_terms}L))")
    lists = join_small(entries, weights.select("term"), ["term"], n_terms, BROADCAST_ROWS).select("term", "row", impact.alias("g"))
    order = ["term", F.col("g").desc(), "row"]
    lists = materialize(lists.repartitionByRange(shuffle_partitions(spark), *order).sortWithinPartitions(*order), "lists")
    queries = materialize(queries.join(weights, "term").select("item", "term", (F.col("mult") * F.col("w")).alias("x"), "df"), "weighted")

    # Phase 1: heads.
    place = F.row_number().over(Window.partitionBy("term").orderBy(F.col("g").desc(), "row"))
    heads = materialize(lists.withColumn("place", place).where(F.col("place") <= k).drop("place"), "heads")
    part = F.sum(F.col("x") * F.col("g")).alias("s")
    bound = _kth(heads.join(queries, "term").groupBy("item", "row").agg(part), k)
    share = F.greatest(F.lit(1), F.ceil(F.col("bound") / F.col("lists"))).cast("long")
    shares = queries.groupBy("item").agg(F.count("*").alias("lists")).join(bound, "item").select("item", "bound", share.alias("share"))

    # Phase 2: every list down to the query's share. What is unseen of a list adds less than that, and no more than the end of its head.
    last = heads.groupBy("term").agg(F.min("g").alias("last"))
    cut = queries.join(shares, "item").join(last, "term").withColumn("least", F.expr("(share + x - 1) div x"))
    unseen = F.when(F.col("df") > k, F.least(F.col("share") - 1, F.col("x") * F.col("last"))).otherwise(F.lit(0))
    cut = materialize(cut.select("item", "term", "x", "least", "last", "bound", unseen.alias("unseen")), "cut")
    floor = cut.groupBy("term").agg(F.min(F.least("least", "last")).alias("floor"))
    fetched = join_small(lists, floor, ["term"], n_terms, BROADCAST_ROWS).where("g >= floor").select("term", "row", "g")
    # The entries of a document meet in one task, and its sums for all queries need no further exchange.
    by_row = fetched.repartition(shuffle_partitions(spark), "row")
    seen = join_small(by_row, cut, ["term"], n_queries, BROADCAST_ROWS).where("g >= least or g >= last")
    sums = seen.groupBy("item", "row").agg(part, F.sum("unseen").alias("known"))
    most = cut.groupBy("item").agg(F.sum("unseen").alias("open"), F.max("bound").alias("bound"))
    reach = F.col("s") + F.col("open") - F.col("known")
    bounded = join_small(sums, most, ["item"], n_queries, BROADCAST_ROWS).withColumn("reach", reach).where("reach >= bound and reach > 0")
    bounded = materialize(bounded.select("item", "row", "s", "reach"), "bounded")

    # Phase 3: exact scores of the candidates.
    chosen = bounded.join(_kth(bounded, k), "item").where("reach >= bound").select("item", "row")
    chosen = materialize(chosen, "candidates")
    rows = materialize(chosen.select("row").distinct(), "rows")
    n_rows = rows.count()
    looked = join_small(lists, rows, ["row"], n_rows, BROADCAST_ROWS)
    scores = looked.join(chosen, "row").join(queries, ["item", "term"]).groupBy("item", "row").agg(F.sum(F.col("x") * F.col("g")).alias("score"))
    ids = join_small(documents.select("row", "doc_id"), rows, ["row"], n_rows, BROADCAST_ROWS)
    rank = F.row_number().over(Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last(), "row"))
    ranked = scores.join(ids, "row").where("score > 0").withColumn("rank", rank).where(F.col("rank") <= k)
    found = materialize(ranked.select(F.col("item").alias("item_id"), "rank", "doc_id", "score"), "ranked")
    *done, _ = (f for f in written() if f not in others)
    clear_written(spark, done)
    return found


def op13_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best documents of every benchmark item."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return ranked_search(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text"))


#: The same ranking by scoring every document that holds a term of the item.
OP13_SQL = r"""
WITH terms AS (
  SELECT row_number() OVER () AS r, doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents
), tf AS (
  SELECT r, doc_id, term, count(*) AS tf FROM terms GROUP BY ALL
), docs AS (
  SELECT r, CAST(sum(tf) AS BIGINT) AS n FROM tf GROUP BY r
), corpus AS (
  SELECT count(*) AS nn, CAST(sum(n) AS BIGINT) AS ll FROM docs
), weights AS (
  SELECT term, CAST(floor(1000 * ln(CAST(2 * nn + 2 AS DOUBLE) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w
  FROM tf, corpus GROUP BY term, nn
), wanted AS (
  SELECT item_id, term, count(*) AS mult FROM (
    SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark WHERE item_id IS NOT NULL)
  GROUP BY ALL
), scores AS (
  SELECT item_id, tf.r, tf.doc_id,
    CAST(sum(mult * w * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + (25 * n * nn) // ll)))) AS BIGINT) AS score
  FROM wanted JOIN weights USING (term) JOIN tf USING (term) JOIN docs ON docs.r = tf.r, corpus GROUP BY ALL
), ranked AS (
  SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS INTEGER) AS rank, doc_id, score
  FROM scores WHERE score > 0
)
SELECT * FROM ranked WHERE rank <= 20
"""
