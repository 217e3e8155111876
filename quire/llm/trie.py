"""Operator 12, the prefix trie of conversations.

Every distinct sequence of first turns is a node, and the smallest conversation that starts with it owns
it. Who owns a node at some depth owns all nodes of its own further down, so a conversation's own nodes are a chain
from its first owned depth to its end. That depth is found by binary search, for all conversations at once:
a batch of probes looks up the digests of prefixes, and of all probes of one digest only the smallest
conversation can be its owner, which is read from the table of each digest's least conversation. The chains,
each hung on a node of another, are the tree. Sums over subtrees are made bottom-up: over the tree of
chains with pointers that double their reach, then along each chain from its end.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.common import _written, materialize, shared_dir, shuffle_partitions
from quire.llm.running import running_sums

#: Depths that a batch probes: three levels of the binary search.
PROBES = 8
#: Characters of role and text by which turns of equal number are cut into ranges.
CUT_CHARS = 200
#: Ids that are joined into one piece before a node's digest is taken.
PIECE = 1 << 16

WORD = "[^\\x20\\x09-\\x0D]+"


def _bucketed(df: DataFrame, keys: list[str]) -> DataFrame:
    """df written into the shared folder in buckets of `keys`, and read back: joins on the keys move the other side only."""
    spark = df.sparkSession
    name = f"quire_{uuid.uuid4().hex}"
    folder = f"{shared_dir(spark)}/{name}"
    _written.append(folder)
    buckets = shuffle_partitions(spark)
    rows = df.repartition(buckets, *keys)
    rows.write.bucketBy(buckets, *keys).sortBy(*keys).option("compression", "zstd").option("path", f"{folder}/table").saveAsTable(name)
    table = spark.table(name)
    spark.sql(f"DROP TABLE {name}")  # only the name: the files are not the catalog's
    return table


def numbered_turns(turns: DataFrame) -> DataFrame:
    """(conv, place, h1, h2, words): a row for each turn, with its place from 1, a 128-bit hash of role and text, and the text's words.

    Turns are ordered by turn, null first; ties by role and text. Null roles and texts are empty. Rows without
    a conv_id are left out; other columns are ignored.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    rows = turns.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv"), "turn", role.alias("role"), text.alias("text"))
    rows = rows.select(
        "*",
        *(F.xxhash64(F.lit(k), "role", "text").alias(f"h{k}") for k in (1, 2)),
        F.regexp_count("text", F.lit(WORD)).cast("long").alias("words"),
        F.lit(1).cast("long").alias("place"),
        *(F.substring(c, 1, CUT_CHARS).alias(f"{c}_cut") for c in ("role", "text")),
    )
    return running_sums(rows, "conv", ["turn", "role", "text"], ["place"], ["h1", "h2", "words"], "numbered", ["turn", "role_cut", "text_cut"])


def _prefixes(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """(conv, depth, words, k1, k2): a 128-bit digest of each prefix, the sum of its turns' hashes with their places."""
    tagged = turns.select("conv", F.col("place").alias("depth"), "words", *(F.xxhash64("h1", "h2", "place", F.lit(k)).alias(f"k{k}") for k in (1, 2)))
    zero = F.lit(0).cast("long")
    empty = convs.select("conv", zero.alias("depth"), zero.alias("words"), zero.alias("k1"), zero.alias("k2"))
    return running_sums(tagged, "conv", ["depth"], ["k1", "k2"], ["depth", "words"], "prefixes").unionByName(empty)


def _first_owned(prefixes: DataFrame, minima: DataFrame, convs: DataFrame) -> DataFrame:
    """(conv, first): the least depth from 1 whose node conv owns, or its end plus one.

    convs: (conv, end). What is below `low` is not owned, what is at `high` is, if it is there.
    """
    found, state = None, convs.select("conv", F.lit(1).cast("long").alias("low"), (F.col("end") + 1).alias("high"))
    probed = F.array_distinct(F.transform(F.sequence(F.lit(0), F.lit(PROBES - 1)), lambda j: F.expr("low") + F.floor((F.col("high") - F.col("low")) * j / PROBES)))
    while True:
        open_ = state.where("low < high").withColumn("probes", probed)
        probes = open_.select("conv", F.explode("probes").alias("depth")).join(prefixes, ["conv", "depth"])
        least = probes.groupBy("k1", "k2").agg(F.min(F.struct("conv", "depth")).alias("p")).select("k1", "k2", "p.conv", "p.depth")
        owned = least.join(minima.select("k1", "k2", F.col("owner").alias("conv")), ["k1", "k2", "conv"])
        reached = owned.groupBy("conv").agg(F.min("depth").alias("at"))
        high = F.coalesce("at", "high")
        low = F.coalesce(F.array_max(F.filter("probes", lambda p: p < high)) + 1, F.col("low"))
        state = materialize(open_.join(reached, "conv", "left").select("conv", low.alias("low"), high.alias("high")), "search")
        settled = state.where("low >= high").select("conv", F.col("high").alias("first"))
        found = settled if found is None else found.unionByName(settled)
        if not state.where("low < high").limit(1).count():
            return found.unionByName(convs.where("end = 0").select("conv", F.lit(1).cast("long").alias("first")))


def _subtree_sums(chains: DataFrame) -> DataFrame:
    """chains (conv, above, saved, leaves) with the sums over all chains below, itself included.

    After k turns a chain has the sums of those up to 2**k - 1 below and points 2**k up, so the turns are few
    however deep the tree is.
    """
    while chains.where("above is not null").limit(1).count():
        below = chains.where("above is not null").groupBy("above").agg(F.sum("saved").alias("more_saved"), F.sum("leaves").alias("more_leaves"))
        ahead = chains.select(F.col("conv").alias("above"), F.col("above").alias("next"))
        summed = chains.join(ahead, "above", "left").join(below.withColumnRenamed("above", "conv"), "conv", "left")
        plus = lambda c: (F.col(c) + F.coalesce(f"more_{c}", F.lit(0))).alias(c)
        chains = materialize(summed.select("conv", F.col("next").alias("above"), plus("saved"), plus("leaves")), "chains")
    return chains.drop("above")


def _end_digests(ends: DataFrame) -> DataFrame:
    """(k1, k2, sha): of each node where conversations end, the hash of their ids, ascending, joined by commas.

    ends: (k1, k2, conv), a written table. Tasks turn sorted ranges into long pieces of text; a node's pieces are hashed in order, one after another.
    """

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in filter(len, batches):
            k1, k2, conv = (batch.column(c).to_numpy() for c in range(3))
            new = np.concatenate([[True], (k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1])])
            at = np.flatnonzero(new | (np.arange(len(batch)) % PIECE == 0))
            texts = [",".join(map(str, part.tolist())).encode() for part in np.split(conv, at[1:])]
            yield pa.RecordBatch.from_arrays([pa.array(c[at]) for c in (k1, k2, conv)] + [pa.array(texts, pa.binary())], names=["k1", "k2", "low", "ids"])

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, digest = None, None
        for batch in filter(len, batches):
            done: list[tuple] = []
            for k1, k2, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                if node == (k1, k2):
                    digest.update(b",")
                else:
                    if node is not None:
                        done.append((*node, digest.hexdigest()))
                    node, digest = (k1, k2), hashlib.sha256()
                digest.update(ids.as_buffer())
            if done:
                yield _named(done)
        if node is not None:
            yield _named([(*node, digest.hexdigest())])

    def _named(rows: list[tuple]) -> pa.RecordBatch:
        a, b, sha = zip(*rows)
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(sha)], names=["k1", "k2", "sha"])

    parts = shuffle_partitions(ends.sparkSession)
    cut = ends.select("k1", "k2", "conv").repartitionByRange(parts, "k1", "k2", "conv").sortWithinPartitions("k1", "k2", "conv")
    long = cut.mapInArrow(pieces, "k1 long, k2 long, low long, ids binary")
    return long.repartition(parts, "k1", "k2").sortWithinPartitions("k1", "k2", "low").select("k1", "k2", "ids").mapInArrow(digests, "k1 long, k2 long, sha string")


def trie_of(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """The nodes of the trie of turns (conv, place from 1, h1, h2, words); convs (conv) lists all conversations, those without turns too.

    One row a node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256. conv_id is the least
    member. The root has depth 0 and no parent. Without conversations there is no row.
    """
    prefixes = _bucketed(_prefixes(turns, convs), ["conv", "depth"])
    minima = prefixes.groupBy("k1", "k2").agg(
        F.min("conv").alias("owner"), F.count("*").alias("n_convs"), F.min("depth").alias("depth"), F.min("words").alias("words")
    )
    minima = _bucketed(minima, ["k1", "k2"])
    last = prefixes.groupBy("conv").agg(F.max(F.struct("depth", "k1", "k2")).alias("e"))
    ends = materialize(last.select("conv", F.col("e.depth").alias("end"), "e.k1", "e.k2"), "ends")
    root = ends.agg(F.min("conv")).first()[0]
    first = _first_owned(prefixes, minima, ends)
    # The owner of the root owns all of its path.
    first = first.withColumn("first", F.when(F.col("conv") == F.lit(root), F.lit(0)).otherwise(F.col("first")))
    chains = ends.select("conv", "end").join(first, "conv").where("first <= end")
    hung = chains.withColumn("depth", F.col("first") - 1).join(prefixes.drop("words"), ["conv", "depth"], "left").drop("depth")
    hung = materialize(hung, "hung")  # conv, end, first, and the digest of the node above
    kids = hung.groupBy("k1", "k2").agg(F.count("*").alias("kids")).where("k1 is not null")
    kids = materialize(kids.join(minima.select("k1", "k2", F.col("owner").alias("above")), ["k1", "k2"]), "kids")
    # A node may have a third of all chains below it: adaptive execution splits such joins.
    hung = materialize(hung.join(kids.drop("kids"), ["k1", "k2"], "left"), "above")
    nodes = minima.join(kids.drop("above"), ["k1", "k2"], "left").join(hung.select(F.col("conv").alias("owner"), "first", "end", "above"), "owner")
    children = F.coalesce("kids", F.lit(0)) + (F.col("depth") < F.col("end")).cast("long")
    nodes = nodes.withColumns({"n_children": children, "saved": (F.col("n_convs") - 1) * F.col("words"), "leaves": (children == 0).cast("long")})
    parent = F.when(F.col("depth") > F.col("first"), F.col("owner")).otherwise(F.col("above"))
    nodes = materialize(nodes.select("k1", "k2", "owner", "depth", parent.alias("parent"), "n_convs", "n_children", "saved", "leaves"), "nodes")
    own = nodes.groupBy("owner").agg(F.sum("saved").alias("saved"), F.sum("leaves").alias("leaves")).withColumnRenamed("owner", "conv")
    sums = _subtree_sums(materialize(hung.select("conv", "above").join(own, "conv"), "chains"))
    below = hung.where("k1 is not null").join(sums, "conv").groupBy("k1", "k2").agg(F.sum("saved").alias("more_saved"), F.sum("leaves").alias("more_leaves"))
    plus = lambda c: (F.col(c) + F.coalesce(f"more_{c}", F.lit(0))).alias(c)
    whole = nodes.join(below, ["k1", "k2"], "left").select(
        "owner", "k1", "k2", "depth", "parent", "n_convs", "n_children", plus("saved"), plus("leaves"), (-F.col("depth")).alias("up")
    )
    keep = ["k1", "k2", "depth", "parent", "n_convs", "n_children"]
    whole = running_sums(materialize(whole, "whole"), "owner", ["up"], ["saved", "leaves"], keep, "summed")
    digests = materialize(_end_digests(ends), "digests")
    return whole.join(digests, ["k1", "k2"], "left").select(
        F.col("owner").alias("conv_id"),
        "depth",
        F.col("parent").alias("parent_conv_id"),
        "n_convs",
        "n_children",
        F.col("leaves").alias("n_leaves"),
        F.col("saved").alias("saved_tokens"),
        F.coalesce("sha", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"),
    )


def prefix_trie(turns: DataFrame) -> DataFrame:
    """The nodes (see trie_of) of the conversations of turns: conv_id, turn, role, text, and columns that are ignored.

    Order and nulls as in numbered_turns: repeated rows are turns of their own. saved_tokens counts, over a node's
    subtree, the words that conversations beyond the first repeat of each node's last text.
    """
    numbered = numbered_turns(turns)
    return trie_of(numbered, numbered.select("conv").distinct())


def rebuilt_turns(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The turns of rebuilt conversations, as numbered_turns gives them, and the list of all conversations (conv).

    Conversation c starts with the first h turns of conversation c - c % 20, as many as it has, and goes on with
    its own turns after its first h; h is the CRC-32 of its decimal id, modulo 4.
    """
    numbered = numbered_turns(turns)
    lengths = numbered.groupBy("conv").agg(F.max("place").alias("length"))
    bases = lengths.where("conv % 20 = 0").select(F.col("conv").alias("base"), F.col("length").alias("base_length"))
    about = lengths.select("conv", (F.col("conv") - F.col("conv") % 20).alias("base"), (F.crc32(F.col("conv").cast("string").cast("binary")) % 4).alias("h"))
    about = about.join(bases, "base", "left").select("conv", "base", "h", F.least("h", F.coalesce("base_length", F.lit(0))).alias("taken"))
    about = materialize(about, "about")
    heads = numbered.where("conv % 20 = 0 and place <= 3").withColumnRenamed("conv", "base")
    first = about.join(heads, "base").where("place <= taken").select("conv", "place", "h1", "h2", "words")
    own = numbered.join(about.select("conv", "h", "taken"), "conv").where("place > h")
    rest = own.select("conv", (F.col("place") - F.col("h") + F.col("taken")).alias("place"), "h1", "h2", "words")
    return materialize(first.unionByName(rest), "rebuilt"), about.select("conv")


def op12_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All nodes of the trie of rebuilt conversations."""
    return trie_of(*rebuilt_turns(spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")))


#: The same nodes in SQL: each prefix as a chain of hashes, each node's sums over the nodes that its members own.
OP12_SQL = r"""
WITH turns AS (
  SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS p
  FROM conversations WHERE conv_id IS NOT NULL
), convs AS (
  SELECT c, c - c % 20 AS base, xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(CAST(c AS VARCHAR), ''),
      lambda ch: list_concat([CAST(ascii(ch) AS BIGINT)], [-1, -1, -1, -1, -1, -1, -1, -1]::BIGINT[])))),
    lambda acc, x: CASE WHEN x >= 0 THEN xor(acc, x) ELSE xor(acc >> 1, 3988292384 * (acc & 1)) END), 4294967295) % 4 AS h
  FROM (SELECT DISTINCT c FROM turns)
), bases AS (
  SELECT v.c, v.h, v.base, least(v.h, coalesce(l.p, 0)) AS taken FROM convs v LEFT JOIN (SELECT c, max(p) AS p FROM turns GROUP BY c) l ON l.c = v.base
), rebuilt AS (
  SELECT b.c, t.p AS d, t.role, t.text FROM bases b JOIN turns t ON t.c = b.base AND t.p <= b.taken
  UNION ALL SELECT b.c, t.p - b.h + b.taken, t.role, t.text FROM bases b JOIN turns t ON t.c = b.c AND t.p > b.h
), prefixes AS (
  SELECT c, d, sha256(string_agg(sha256(role) || sha256(text), '') OVER (PARTITION BY c ORDER BY d)) AS k,
    length(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS words
  FROM rebuilt
  UNION ALL SELECT c, 0, '', 0 FROM convs
), nodes AS (
  SELECT k, d, min(c) AS c, count(*) AS n, min(words) AS words FROM prefixes GROUP BY k, d
), lasts AS (
  SELECT c, max(d) AS d FROM prefixes GROUP BY c
), tree AS (
  SELECT n.*, q.k AS up, u.c AS parent FROM nodes n
  LEFT JOIN prefixes q ON q.c = n.c AND q.d = n.d - 1 LEFT JOIN nodes u ON u.k = q.k AND u.d = n.d - 1
), kids AS (
  SELECT up AS k, count(*) AS kids FROM tree WHERE d > 0 GROUP BY up
), sized AS (
  SELECT t.*, coalesce(kids, 0) AS kids FROM tree t LEFT JOIN kids USING (k)
), sums AS (
  SELECT a.k, sum((s.n - 1) * s.words) AS saved, count(*) FILTER (s.kids = 0) AS leaves
  FROM sized s JOIN prefixes a ON a.c = s.c AND a.d <= s.d GROUP BY a.k
), ends AS (
  SELECT p.k, sha256(string_agg(CAST(p.c AS VARCHAR), ',' ORDER BY p.c)) AS sha FROM prefixes p JOIN lasts l ON l.c = p.c AND l.d = p.d GROUP BY p.k
)
SELECT s.c AS conv_id, s.d AS depth, s.parent AS parent_conv_id, s.n AS n_convs, CAST(s.kids AS BIGINT) AS n_children,
  CAST(leaves AS BIGINT) AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens, coalesce(e.sha, sha256('')) AS ends_sha256
FROM sized s JOIN sums USING (k) LEFT JOIN ends e USING (k)
"""
