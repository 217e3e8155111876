"""Versions of tables in a folder: data is written first, then a numbered manifest that names it.

Readers take the highest manifest, so they see a whole version or the one before, in this session or any
other; old versions stay readable. A manifest is created only where its number is free: of two writers that start
from one version, the second is refused.
"""

from __future__ import annotations

import hashlib
import json
import re
import time
from collections.abc import Callable
from typing import TypeVar

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession

T = TypeVar("T")
_NAME = re.compile(r"manifest-(\d{8})\.json$")


class Conflict(RuntimeError):
    """Another writer has published the version that this one was about to."""


def _path(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def children(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder, sorted; none if it is not there."""
    where, fs = _path(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(where)) if fs.exists(where) else []


def fingerprint(spark: SparkSession, path: str) -> str:
    """A short name for the state of a file or folder: the names, lengths and times of its files."""
    where, fs = _path(spark, path)
    found, files = [], fs.listFiles(where, True)
    while files.hasNext():
        s = files.next()
        found.append((s.getPath().toString(), s.getLen(), s.getModificationTime()))
    return hashlib.sha256(json.dumps(sorted(found)).encode()).hexdigest()[:16]


def manifest(spark: SparkSession, root: str, number: int) -> dict | None:
    """The content of a manifest; null if it is not there or not complete yet."""
    where, fs = _path(spark, f"{root}/manifest-{number:08d}.json")
    if not fs.exists(where):
        return None
    stream = fs.open(where)
    try:
        return json.loads(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    except ValueError:
        return None
    finally:
        stream.close()


def latest(spark: SparkSession, root: str) -> tuple[int, dict] | None:
    """The highest complete manifest, with its number."""
    numbers = sorted((int(m[1]) for m in map(_NAME.match, children(spark, root)) if m), reverse=True)
    for number in numbers:
        if (content := manifest(spark, root, number)) is not None:
            return number, content
    return None


#: A manifest that is still not complete after so many seconds was left by a writer that is gone.
ABANDONED_AFTER = 60


def publish(spark: SparkSession, root: str, number: int, content: dict) -> None:
    """Make a version current; Conflict if its number is taken. What a writer left half done makes room after a while."""
    where, fs = _path(spark, f"{root}/manifest-{number:08d}.json")
    if fs.exists(where) and manifest(spark, root, number) is None and time.time() - fs.getFileStatus(where).getModificationTime() / 1000 > ABANDONED_AFTER:
        fs.delete(where, False)
    try:
        out = fs.create(where, False)
    except Py4JJavaError as fault:
        if fs.exists(where):
            raise Conflict(f"{root} already has version {number}") from fault
        raise
    out.write(json.dumps(content).encode())
    out.close()


def opened_or_built(spark: SparkSession, root: str, open_: Callable[[], T], build: Callable[[], T]) -> T:
    """What the folder root holds, built if there is no complete version. A build that another writer overtook gives way to that one's."""
    if latest(spark, root) is not None:
        return open_()
    try:
        return build()
    except Conflict:
        for _ in range(2 * ABANDONED_AFTER):  # the other writer's manifest may not be complete yet
            if latest(spark, root) is not None:
                return open_()
            time.sleep(1)
        raise
