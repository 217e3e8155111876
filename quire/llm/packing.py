"""Operator 5, packing along a space-filling curve.

Each document's tokens are hashed into a count vector and projected to three dimensions; its place
on a Hilbert curve through that cube is its sort key. Documents are range-sorted by key, laid end
to end along the curve and cut every 4096 tokens, so that a sequence holds neighbours and only the
last one is padded.

Keys are hashed, so exact token counts below candidate boundaries give even ranges and the number of
tokens before each range; one exchange then suffices.

Documents that are already in a mixed order are packed along the curve within runs of consecutive
documents only: the run's number leads the key, so every run of sequences keeps the mix.
"""

from __future__ import annotations

import functools
import hashlib
import os
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.common import find_splitters, join_small, materialize, shuffle_partitions

TOKENIZER = "word_bpe_49k.json"
#: The file for which the short cuts of WordIds were proven; any other is only used whole.
TOKENIZER_SHA256 = "53fa9d558ea625daafcd57cd61e7be7b3c7043ea584b22d09575cf5ea9131b0a"
#: Id put after each document.
END_ID = 2
DIMS, HILBERT_BITS, BUCKETS = 3, 13, 256
#: Documents of a mixed order in one run, and the bits of a key that number runs.
RUN_ROWS, RUN_BITS = 4096, 24


class WordIds(dict):
    """Word -> its token ids as bytes. It remembers two generations of a bounded number of words.

    The tokenizer lower-cases each character by itself, drops white space and never joins a full
    stop or comma with a letter or digit before it. So a text can be parted at ASCII spaces, line
    ends and before such marks, and in Latin-1 texts be lower-cased first: far fewer words are new.
    Texts in which a mark follows another mark are only parted at spaces and line ends. All that
    was proven for one tokenizer file; with any other, whole texts go to the tokenizer.
    """

    def __init__(self, path: str, kind: str, most: int = 300_000):
        super().__init__()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        whole = Tokenizer.from_file(path)
        self.encode, self.model = whole.encode, whole.model
        self.code = {"<u2": "H", "<u4": "I"}[kind]
        self.most, self.old = most, {}
        # Single words take a short cut past the tokenizer's text steps only if it is known to agree.
        probe = [w for w in ("a", "word", "straße", "être", "niño") if self.short(w) != self.encode(w, add_special_tokens=False).ids]
        self.shortcut = not probe
        self.known = _digest(path) == TOKENIZER_SHA256

    def short(self, word: str) -> list[int]:
        """Ids of a lower-case word of Latin-1 letters, straight from the merges."""
        written = word if word.isascii() else word.encode().decode("latin-1").translate(_BYTE_CHARS)
        return [t.id for t in self.model.tokenize(written)]

    def __missing__(self, word: str) -> bytes:
        found = self.old.get(word)
        if found is None:
            if self.shortcut and word.isalpha() and word.islower() and _latin(word):
                ids = self.short(word)
            else:
                ids = self.encode(word, add_special_tokens=False).ids
            found = array(self.code, ids).tobytes()
        if len(word) <= 64:
            if len(self) >= self.most:
                self.old = dict(self)
                self.clear()
            self[word] = found
        return found

    def of(self, text: str) -> bytes:
        if not self.known:
            return array(self.code, self.encode(text, add_special_tokens=False).ids).tobytes()
        if _plain(text):
            text = text.lower().replace(".", " .").replace(",", " ,")
        return b"".join(map(self.__getitem__, text.replace("\n", " ").split(" ")))


@functools.cache
def _digest(path: str) -> str:
    with open(path, "rb") as f:
        return hashlib.file_digest(f, "sha256").hexdigest()


def _latin(text: str) -> bool:
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


def _kinds() -> bytes:
    """Latin-1 bytes by kind: m for a full stop or comma, p for other marks, a for the rest."""
    rest = lambda c: c.isalpha() or c.isnumeric() or c in " \t\n\v\f\r\x85\xa0"
    return bytes(ord("m" if c in ".," else "a" if rest(c) else "p") for c in map(chr, range(256)))


_KINDS = _kinds()


def _plain(text: str) -> bool:
    """Is it Latin-1, with no full stop or comma right after a character that is no letter, digit or space?"""
    try:
        kinds = text.encode("latin-1").translate(_KINDS)
    except UnicodeEncodeError:
        return False
    return b"pm" not in kinds and b"mm" not in kinds


def _byte_chars() -> dict[int, int]:
    """How byte-level vocabularies write bytes: printable ones as themselves, the rest from 256 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    other = [b for b in range(256) if b not in plain]
    return {b: b for b in plain} | {b: 256 + k for k, b in enumerate(other)}


_BYTE_CHARS = _byte_chars()


def _mix(x: np.ndarray) -> np.ndarray:
    """A fixed 32-bit hash of whole numbers."""
    x = x.astype(np.uint64)
    for factor in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9):
        with np.errstate(over="ignore"):
            x = (x ^ (x >> np.uint64(31))) * np.uint64(factor)
    return (x >> np.uint64(32)).astype(np.int64)


def projection() -> np.ndarray:
    """BUCKETS x DIMS signs from a hash."""
    return np.where(_mix(np.arange(1, BUCKETS * DIMS + 1)).reshape(BUCKETS, DIMS) & 1, 1.0, -1.0)


def hilbert(points: np.ndarray, bits: int) -> np.ndarray:
    """Places of points (rows of non-negative integers below 2**bits) on the Hilbert curve.

    Works from the highest bit down: each level's bits select a part of the cube and reflect or
    exchange the axes of what is inside it; the collected bits, read as a Gray code, are the place.
    """
    x = points.astype(np.int64).copy()
    dims = x.shape[1]
    level = 1 << (bits - 1)
    while level > 1:
        below = level - 1
        for d in range(dims):
            on = (x[:, d] & level) != 0
            swap = np.where(on, 0, (x[:, 0] ^ x[:, d]) & below)
            x[:, 0] = np.where(on, x[:, 0] ^ below, x[:, 0] ^ swap)
            x[:, d] ^= swap
        level >>= 1
    for d in range(1, dims):
        x[:, d] ^= x[:, d - 1]
    flip = np.zeros(len(x), np.int64)
    level = 1 << (bits - 1)
    while level > 1:
        flip = np.where(x[:, -1] & level, flip ^ (level - 1), flip)
        level >>= 1
    x ^= flip[:, None]
    place = np.zeros(len(x), np.int64)
    for b in range(bits - 1, -1, -1):
        for d in range(dims):
            place = (place << 1) | ((x[:, d] >> b) & 1)
    return place


def curve_keys(counts: np.ndarray) -> np.ndarray:
    """Hilbert places of count vectors, by direction: an empty vector is the centre."""
    scale = np.sqrt((counts**2).sum(axis=1, keepdims=True))
    unit = counts / np.where(scale > 0, scale, 1)
    u = 0.5 * (1 + np.tanh(unit @ projection()))
    return hilbert(np.minimum((u * (1 << HILBERT_BITS)).astype(np.int64), (1 << HILBERT_BITS) - 1), HILBERT_BITS)


def tokenized(docs: DataFrame, path: str, end_id: int = END_ID, run: str | None = None) -> DataFrame:
    """doc_id, key, n tokens and ids binary of every row, as a written table.

    The key is the place on the curve and a tie; or, with a column `run`, that number, a coarser
    place and a tie.
    """
    kind = "<u2" if _small(path) else "<u4"

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordIds(path, kind)
        end = np.array([end_id], kind).tobytes()
        for batch in batches:
            all_ids, texts, runs = batch.columns
            for at in range(0, len(texts), 500):
                some = [words.of(t or "") + end for t in texts.slice(at, 500).to_pylist()]
                counts = np.zeros((len(some), BUCKETS))
                for k, b in enumerate(some):
                    counts[k] = np.bincount(_mix_table()[np.frombuffer(b, kind)], minlength=BUCKETS)
                n = np.array([len(b) // np.dtype(kind).itemsize for b in some], np.int64)
                yield pa.RecordBatch.from_arrays(
                    [all_ids.slice(at, 500), runs.slice(at, 500), pa.array(curve_keys(counts)), pa.array(n), pa.array(some, pa.binary())],
                    names=["doc_id", "run", "place", "n", "ids"],
                )

    lead = F.lit(0).cast("long") if run is None else F.col(run).cast("long")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", lead.alias("run"))
    rows = rows.mapInArrow(encode, "doc_id long, run long, place long, n long, ids binary")
    # Copies share a place; a hash of the id and the row's number parts them.
    bits = DIMS * HILBERT_BITS if run is None else DIMS * (HILBERT_BITS - 4)
    low = 63 - bits - (0 if run is None else RUN_BITS)
    tie = F.shiftrightunsigned(F.xxhash64("doc_id", F.monotonically_increasing_id()), 64 - low)
    place = F.shiftright("place", DIMS * HILBERT_BITS - bits)
    key = F.shiftleft("run", bits + low).bitwiseOR(F.shiftleft(place, low)).bitwiseOR(tie)
    return materialize(rows.select("doc_id", key.alias("key"), "n", "ids"), "tokens")


def in_runs(docs: DataFrame, run_rows: int = RUN_ROWS) -> DataFrame:
    """doc_id, text, run: the rows of a table in runs of consecutive ones, by its files' names and places in them.

    Rows that don't come from files are taken in the order in which Spark numbers them. Runs get
    longer where there would be more than 2**24.
    """
    try:
        rows = docs.select("doc_id", "text", F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("at"))
    except AnalysisException:
        number = F.monotonically_increasing_id()
        rows = docs.select("doc_id", "text", F.shiftright(number, 33).cast("string").alias("file"), number.bitwiseAND((1 << 33) - 1).alias("at"))
        by_name = int
    else:
        by_name = str
    counts = dict(rows.groupBy("file").count().collect())  # one row a file
    total, before = 0, []
    for file in sorted(counts, key=by_name):
        before.append((file, total))
        total += counts[file]
    if not before:
        return rows.select("doc_id", "text", F.lit(0).cast("long").alias("run"))
    starts = docs.sparkSession.createDataFrame(before, "file string, start long")
    span = max(run_rows, -(-total // (1 << RUN_BITS)))
    placed = join_small(rows, starts, ["file"], len(before), 100_000)
    return placed.select("doc_id", "text", F.expr(f"(start + at) div {span}").alias("run"))


_buckets: list[np.ndarray] = []


def _mix_table() -> np.ndarray:
    if not _buckets:
        _buckets.append(_mix(np.arange(1 << 17)) % BUCKETS)
    return _buckets[0]


def _small(path: str) -> bool:
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path).get_vocab_size() <= 1 << 16


def pack(docs: DataFrame, path: str, length: int = 4096, end_id: int = END_ID, run: str | None = None) -> DataFrame:
    """One row a piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, all long.

    Every row of docs (doc_id, text; other columns are ignored) gives its tokens and `end_id`; each
    of them is in exactly one piece. Sequences are full but for the last. Null and empty texts give
    the end id alone. Rows with a null or repeated doc_id are packed one by one. An empty table
    gives no rows. A document of any length is cut into as many pieces as it needs. With a column
    `run` (whole numbers below 2**24), runs follow each other and the curve orders documents within one.
    """
    spark = docs.sparkSession
    kind = "<u2" if _small(path) else "<u4"
    table = tokenized(docs, path, end_id, run)
    parts = shuffle_partitions(spark)
    cut = find_splitters(table, F.col("key"), F.col("n"), parts, 0.05)
    bounds, base = np.array(cut.bounds, np.int64), [0, *cut.below]
    dealt = (
        table.withColumn("part", cut.part(F.col("key")))
        .repartitionById(parts, F.col("part"))
        .sortWithinPartitions("key", "doc_id", "n")
        .select("doc_id", "key", "n", "ids")
    )

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = None
        for batch in batches:
            if not len(batch):
                continue
            if at is None:
                at = base[int(np.searchsorted(bounds, batch.column(1)[0].as_py(), "right"))]
            rows: list[tuple] = []
            for doc_id, n, ids in zip(*(batch.column(k).to_pylist() for k in (0, 2, 3))):
                wide = np.frombuffer(ids, kind).astype("<u4")
                start = 0
                while start < n:
                    offset = at % length
                    size = min(n - start, length - offset)
                    rows.append((doc_id, start, size, zlib.crc32(wide[start : start + size].tobytes()), n, at // length, offset))
                    start += size
                    at += size
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names=PIECE)

    return dealt.mapInArrow(cut_up, ", ".join(f"{c} long" for c in PIECE))


PIECE = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of 4096 tokens."""
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), tokenizer_path())


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the pieces of the packed documents, along the curve within runs of the mixed order.

    Null and empty texts are their end id alone; null and repeated ids and repeated rows are packed one by
    one; long texts are cut; other columns, whatever their names, are ignored. An empty table gives no rows.
    """
    return pack(in_runs(docs), tokenizer_path(), run="run")
