"""Keyed tables that are changed by rewriting the touched buckets only."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.sources.manifests import children, latest, manifest, publish

BUCKETS = 64
#: The partition columns of the files; names that a table's own columns must not have.
VERSION, BUCKET = "_version", "_bucket"


def bucket_of(key: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


@dataclass(frozen=True)
class KeyedTable:
    """A table of one row a key, in buckets by the key's hash; see create and open.

    A change reads and writes the buckets of its keys. Each version's manifest says which version each bucket was
    last written in, so versions share the files of buckets that did not change.
    """

    spark: SparkSession
    root: str
    key: str
    buckets: int
    schema: T.StructType
    version: int
    #: Folder that each bucket that has rows was last written in. Each writer has its own, so one that is refused harms no other.
    written: dict[int, str]

    @classmethod
    def create(cls, df: DataFrame, root: str, key: str, buckets: int = BUCKETS) -> KeyedTable:
        """Write df as version 1. Rows without a key are refused, of repeated keys as well."""
        spark = df.sparkSession
        rows, distinct, without = df.select(F.count("*"), F.count_distinct(key), F.count_if(F.col(f"`{key}`").isNull())).first()
        if without or rows != distinct:
            raise ValueError(f"{key} must be there and unique: {rows} rows, {distinct} keys, {without} without one")
        return cls._publish(spark, root, 1, key, buckets, df.schema, cls._write(df, root, 1, key, buckets))

    @classmethod
    def open(cls, spark: SparkSession, root: str, version: int | None = None) -> KeyedTable:
        """The table as its newest manifest, or that of a version, describes it."""
        number, content = (version, manifest(spark, root, version)) if version is not None else latest(spark, root) or (0, None)
        if content is None:
            raise ValueError(f"no table at {root}")
        schema = T.StructType.fromJson(json.loads(content["schema"]))
        return cls(spark, root, content["key"], content["buckets"], schema, number, {int(b): v for b, v in content["written"].items()})

    @classmethod
    def _publish(cls, spark, root, version, key, buckets, schema, written) -> KeyedTable:
        publish(spark, root, version, {"key": key, "buckets": buckets, "schema": schema.json(), "written": written})
        return cls(spark, root, key, buckets, schema, version, written)

    @staticmethod
    def _write(df: DataFrame, root: str, version: int, key: str, buckets: int) -> dict[int, str]:
        """Write rows into a new folder; the buckets that it holds, with its name."""
        folder = f"{version}-{uuid.uuid4().hex}"
        rows = df.withColumn(BUCKET, bucket_of(F.col(f"`{key}`"), buckets)).repartition(BUCKET).sortWithinPartitions(BUCKET, key)
        rows.write.partitionBy(BUCKET).parquet(f"{root}/data/{VERSION}={folder}")
        names = children(df.sparkSession, f"{root}/data/{VERSION}={folder}")
        return {int(name.partition("=")[2]): folder for name in names if name.startswith(BUCKET)}

    def _files(self, buckets: Iterable[int] | None = None) -> DataFrame:
        some = self.written if buckets is None else {b: self.written[b] for b in buckets if b in self.written}
        if not some:
            return self.spark.createDataFrame([], self.schema).withColumn(BUCKET, F.lit(0))
        paths = [f"{self.root}/data/{VERSION}={v}/{BUCKET}={b}" for b, v in sorted(some.items())]
        schema = T.StructType([*self.schema.fields, T.StructField(VERSION, T.StringType()), T.StructField(BUCKET, T.IntegerType())])
        return self.spark.read.schema(schema).option("basePath", f"{self.root}/data").parquet(*paths).drop(VERSION)

    def read(self) -> DataFrame:
        return self._files().select(*self.schema.names)

    def lookup(self, keys: list) -> DataFrame:
        """The rows of these keys: only their buckets are read, and of these the parts whose keys may fit."""
        if not keys:
            return self.read().limit(0)
        kind = self.schema[self.key].dataType
        places = [F.lit(k).cast(kind) for k in keys]
        hashed = self.spark.range(1).select(F.array(*(bucket_of(p, self.buckets) for p in places))).first()[0]
        rows = self._files(sorted(set(hashed)))
        return rows.where(F.col(f"`{self.key}`").isin(places)).select(*self.schema.names)

    def _changed(self, keys: DataFrame, change: Callable[[DataFrame], DataFrame]) -> KeyedTable:
        touched = [b for (b,) in keys.select(bucket_of(F.col(f"`{self.key}`"), self.buckets)).distinct().collect()]  # at most one a bucket
        number = self.version + 1
        new = self._write(change(self._files(touched).select(*self.schema.names)), self.root, number, self.key, self.buckets)
        left = {b: v for b, v in self.written.items() if b not in set(touched)}
        return self._publish(self.spark, self.root, number, self.key, self.buckets, self.schema, left | new)

    def upsert(self, rows: DataFrame) -> KeyedTable:
        """Rows with new keys are added, with known keys replaced. Each key may come once."""
        new = rows.select(*(F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in self.schema.fields))
        self._once(new)
        return self._changed(new, lambda old: old.join(new.select(self.key), self.key, "left_anti").select(*self.schema.names).unionByName(new))

    def update(self, rows: DataFrame, columns: list[str]) -> KeyedTable:
        """These columns of rows with known keys are replaced; unknown keys are ignored."""
        self._once(rows)
        new = rows.select(self.key, F.lit(True).alias("_hit"), *(F.col(f"`{c}`").alias(f"_{c}") for c in columns))
        pick = lambda c: F.when(F.col("_hit"), F.col(f"_{c}")).otherwise(F.col(c)).cast(self.schema[c].dataType).alias(c) if c in columns else F.col(c)
        return self._changed(rows, lambda old: old.join(new, self.key, "left").select(*map(pick, self.schema.names)))

    def delete(self, keys: DataFrame) -> KeyedTable:
        gone = keys.select(self.key).distinct()
        return self._changed(gone, lambda old: old.join(gone, self.key, "left_anti").select(*self.schema.names))

    def _once(self, rows: DataFrame) -> None:
        if rows.where(F.col(f"`{self.key}`").isNull()).limit(1).count() or rows.groupBy(self.key).count().where("count > 1").limit(1).count():
            raise ValueError(f"a change needs each {self.key} once")
