"""Operator 8, URL filters: a sorted array of 64-bit digests, memory-mapped and binary-searched.

A rule is a host and a path prefix; it fits the host itself and all its subdomains. All rules are
compiled into one file: sorted xxhash64 keys of "host + path", places of the full strings, verdicts
and the strings. A url's candidate keys are its host suffixes (of those no longer than the longest
rule's host) times the prefixes of its path that have a length that some rule has. Candidates of a whole batch are probed by one vectorised binary search,
longest first, and a found key counts only if the stored string equals the candidate.
"""

from __future__ import annotations

import hashlib
import mmap
import os
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession

from quire.llm.common import shared_dir

#: Fixed values of the query: the rules as (verdict, host, path).
RULES = (
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
)

_MAGIC = b"QURLRUL2"
_UPPER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}


def compile_rules(rules: Iterable[tuple[str, str, str]]) -> bytes:
    """The rule file. Later rules for the same host and path win; hosts are lower-cased (A-Z)."""
    known: dict[tuple[str, str], str] = {}
    for verdict, host, path in rules:
        if verdict not in ("allow", "block"):
            raise ValueError(f"unknown verdict {verdict!r}")
        known[host.translate(_UPPER), path] = verdict
    lengths = sorted({len(path) for _, path in known})
    texts = [(f"{host}{path}".encode(), verdict) for (host, path), verdict in known.items()]
    digests = np.array([xxhash.xxh64_intdigest(t) for t, _ in texts], np.uint64)
    order = np.argsort(digests, kind="stable")
    texts = [texts[i] for i in order]
    ends = np.cumsum([len(t) for t, _ in texts], dtype=np.int64) if texts else np.zeros(0, np.int64)
    head = np.array([len(texts), len(lengths), max((len(host) for host, _ in known), default=0)], np.int64)
    block = np.array([v == "block" for _, v in texts], np.uint8)
    return b"".join(
        [_MAGIC, head.tobytes(), np.array(lengths, np.int64).tobytes(), digests[order].tobytes(), ends.tobytes(), block.tobytes(), *(t for t, _ in texts)]
    )


class RuleFile:
    """A compiled rule file, memory-mapped: workers of one machine share its pages."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.map = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
        if self.map[:8] != _MAGIC:
            raise ValueError("not a rule file")
        n, m, self.longest_host = np.frombuffer(self.map, np.int64, 3, 8).tolist()
        at = 32
        self.lengths = np.frombuffer(self.map, np.int64, m, at).tolist()
        at += 8 * m
        self.digests = np.frombuffer(self.map, np.uint64, n, at)
        at += 8 * n
        self.ends = np.frombuffer(self.map, np.int64, n, at)
        at += 8 * n
        self.block = np.frombuffer(self.map, np.uint8, n, at)
        self.strings = int(at + n)

    def text(self, k: int) -> bytes:
        start = int(self.ends[k - 1]) if k else 0
        return self.map[self.strings + start : self.strings + int(self.ends[k])]

    def find(self, candidates: list[bytes], digests: np.ndarray | None = None) -> np.ndarray:
        """The rule number of each candidate string, or -1."""
        found = np.full(len(candidates), -1, np.int64)
        if not len(self.digests) or not candidates:
            return found
        if digests is None:
            digests = np.fromiter(map(xxhash.xxh64_intdigest, candidates), np.uint64, len(candidates))
        at = np.searchsorted(self.digests, digests)
        hit = np.flatnonzero(self.digests[np.minimum(at, len(self.digests) - 1)] == digests)
        for c in hit.tolist():  # equal digests: compare the full strings of all rules that have this key
            k = int(at[c])
            while k < len(self.digests) and self.digests[k] == digests[c]:
                if self.text(k) == candidates[c]:
                    found[c] = k
                    break
                k += 1
        return found

    def suffixes(self, host: str) -> Iterator[str]:
        """The host and its parents, as far as a rule may have them, the shortest first."""
        end = len(host)
        while (at := host.rfind(".", max(0, len(host) - self.longest_host - 1), end)) >= 0:
            yield host[at + 1 :]
            end = at
        if len(host) <= self.longest_host:
            yield host

    def judge(self, parts: list[tuple[str, str]]) -> list[tuple[str | None, str | None]]:
        """(rule, verdict) of the longest fitting rule of each (host, path), or (None, None)."""
        candidates: list[bytes] = []
        owners: list[int] = []
        for i, (host, path) in enumerate(parts):
            suffixes = list(self.suffixes(host))
            for length in self.lengths:
                if length <= len(path):
                    prefix = path[:length]
                    for suffix in suffixes:
                        candidates.append(f"{suffix}{prefix}".encode())
                        owners.append(i)
        out: list[tuple[str | None, str | None]] = [(None, None)] * len(parts)
        best = [-1] * len(parts)
        found = self.find(candidates)
        for c in np.flatnonzero(found >= 0).tolist():
            i, text = owners[c], candidates[c].decode()
            if len(text) > best[i]:
                best[i] = len(text)
                out[i] = (text, "block" if self.block[found[c]] else "allow")
        return out


def split_url(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path of a url; both empty for null or without ://."""
    _, sign, rest = (url or "").partition("://")
    if not sign:
        return "", ""
    end = min((k for k in map(rest.find, "/?#") if k >= 0), default=len(rest))
    host, rest = rest[:end], rest[end:]
    end = min((k for k in map(rest.find, "?#") if k >= 0), default=len(rest))
    return host.translate(_UPPER), rest[:end]


def ship(spark: SparkSession, compiled: bytes) -> str:
    """Put the rule file into the shared folder and have Spark send it to each executor; its name."""
    name = f"rules-{hashlib.sha256(compiled).hexdigest()[:24]}.bin"
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/{name}")
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(path):
        out = fs.create(path, True)
        for at in range(0, len(compiled), 1 << 20):
            out.write(bytearray(compiled[at : at + (1 << 20)]))
        out.close()
    spark.sparkContext.addFile(fs.makeQualified(path).toString())
    return name


def judge_urls(pages: DataFrame, rules: Iterable[tuple[str, str, str]], default: str = "allow", url: str = "url") -> DataFrame:
    """Keep every row and add host, path, rule (null where none fits) and verdict.

    The longest rule string wins; a url that no rule fits gets `default`. Null urls and urls without
    :// have an empty host and path, and so the default. Columns named like the added ones are
    replaced. Repeated rows are judged each; an empty table gives no rows, no rules give defaults.
    """
    spark = pages.sparkSession
    name = ship(spark, compile_rules(rules))
    made = ["host", "path", "rule", "verdict"]
    keep = [c for c in pages.columns if c not in made]
    at = keep.index(url)
    fields = [f for f in pages.schema.fields if f.name in keep]
    schema = type(pages.schema)(fields)
    for c in made:
        schema = schema.add(c, "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file = RuleFile(os.path.join(SparkFiles.getRootDirectory(), name))
        for batch in batches:
            parts = [split_url(u) for u in batch.column(at).to_pylist()]
            rule = file.judge(parts)
            cols = [[h for h, _ in parts], [p for _, p in parts], [r for r, _ in rule], [v or default for _, v in rule]]
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(c, pa.string()) for c in cols)], names=[*batch.schema.names, *made])

    return pages.select(*(f"`{c}`" for c in keep)).mapInArrow(run, schema)


def op8_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host, path, fitting rule and verdict of every page."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return judge_urls(pages, RULES).select("page_id", "host", "path", "rule", "verdict")


#: The same verdicts in SQL: each rule tested by itself, the longest fitting one taken.
OP8_SQL = """
WITH parts AS (
  SELECT page_id,
    CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest
  FROM pages
), split AS (
  SELECT page_id,
    translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') AS path
  FROM parts
), judged AS (
  SELECT page_id, host, path,
    CASE
      WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/en/7') THEN 'example.com/en/7'
      WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/en/') THEN 'com/en/'
      WHEN (host = 'example.net' OR host LIKE '%.example.net') AND starts_with(path, '/de/8') THEN 'example.net/de/8'
      WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/de/') THEN 'net/de/'
      WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/es/') THEN 'org/es/'
    END AS rule
  FROM split
)
SELECT page_id, host, path, rule,
  CASE WHEN rule IN ('com/en/', 'example.net/de/8', 'org/es/') THEN 'block' ELSE 'allow' END AS verdict
FROM judged
"""
