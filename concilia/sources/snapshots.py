"""A member table kept as versions, of which a change rewrites only what it touches.

Rows are dealt into buckets by id. A version is a list that says in which folder each bucket
lies; a change set says which buckets it needs, these are read, changed and written to a
new folder, and the next version refers to the others where they are. Nothing written is
changed again: readers of a version are never disturbed, and two writers of one version
cannot both succeed.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from concilia.operators.changes import apply_wide


@dataclass(frozen=True)
class Store:
    """Where the versions lie, what the rows are, and into how many buckets they are dealt.

    A bucket should be some hundred megabytes: what is listed, per version, is one row per
    bucket, and that list is all the driver reads.
    """

    path: str
    schema: T.StructType
    buckets: int
    key: str = "id"

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(F.col(self.key)), F.lit(self.buckets)).cast("int")

    def _listed(self, version: int) -> str:
        return f"{self.path}/versions/{version:08d}"


def _places(spark: SparkSession, store: Store, version: int) -> dict[int, str]:
    """The folder of each bucket that has rows; one entry per bucket at most."""
    listed = spark.read.schema("bucket int, folder string").parquet(store._listed(version))
    return {row.bucket: row.folder for row in listed.collect()}


def _write(store: Store, rows: DataFrame) -> dict[int, str]:
    """Writes rows, which have a column ``bucket``, to a new folder."""
    folder = f"{store.path}/data/{uuid.uuid4().hex}"
    rows.repartition("bucket").write.partitionBy("bucket").parquet(folder)
    spark = rows.sparkSession
    there = spark.read.schema(T.StructType([*store.schema.fields, T.StructField("bucket", T.IntegerType())])).parquet(folder).select("bucket").distinct()
    return {row.bucket: folder for row in there.collect()}


def _list(spark: SparkSession, store: Store, version: int, places: dict[int, str]) -> int:
    """Publishes a version: fails if it is there already."""
    rows = spark.createDataFrame(sorted(places.items()), "bucket int, folder string").coalesce(1)
    rows.write.mode("errorifexists").parquet(store._listed(version))
    return version


def create(store: Store, rows: DataFrame) -> int:
    """The first version, 1, of a table."""
    return _list(rows.sparkSession, store, 1, _write(store, rows.withColumn("bucket", store.bucket())))


def _rows(spark: SparkSession, store: Store, places: dict[int, str]) -> DataFrame:
    paths = [f"{folder}/bucket={bucket}" for bucket, folder in places.items()]
    return spark.read.schema(store.schema).parquet(*paths) if paths else spark.createDataFrame([], store.schema)


def read(spark: SparkSession, store: Store, version: int) -> DataFrame:
    """The whole table as of a version."""
    return _rows(spark, store, _places(spark, store, version))


def find(spark: SparkSession, store: Store, version: int, ids: DataFrame) -> DataFrame:
    """The rows of some ids, from the buckets they are in."""
    wanted = {row.b for row in ids.select(store.bucket().alias("b")).distinct().collect()}
    places = {b: f for b, f in _places(spark, store, version).items() if b in wanted}
    return _rows(spark, store, places).join(ids.select(store.key).distinct(), store.key, "left_semi")


def rewrite(
    spark: SparkSession, store: Store, version: int, keys: DataFrame, change: Callable[[DataFrame], DataFrame], to: int | None = None
) -> int:
    """The version ``to`` (the next one by default): ``change`` of the rows in the buckets of
    ``keys``; other buckets stay where they are."""
    places = _places(spark, store, version) if version else {}
    touched = {row.b for row in keys.select(store.bucket().alias("b")).distinct().collect()}
    old = _rows(spark, store, {b: places[b] for b in touched & set(places)})
    new = _write(store, change(old).withColumn("bucket", store.bucket()))
    kept = {b: f for b, f in places.items() if b not in touched}
    return _list(spark, store, version + 1 if to is None else to, {**kept, **new})


def apply(spark: SparkSession, store: Store, version: int, changes: DataFrame, day: Column, moment: Column) -> int:
    """The next version: rows whose key ``changes`` has take its ``new_`` values.

    ``changes`` has one row per key; it should be written, as it is read twice. Without
    changes the version stays.
    """
    if changes.isEmpty():
        return version
    return rewrite(spark, store, version, changes, lambda old: apply_wide(old, changes, day, moment))


def versions(spark: SparkSession, store: Store) -> list[int]:
    """The versions there are, in order; empty before the first."""
    files = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{store.path}/versions/*/_SUCCESS")
    system = files.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return sorted(int(found.getPath().getParent().getName()) for found in system.globStatus(files) or ())
