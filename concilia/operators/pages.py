"""Pages deep inside an ordered listing, without sorting all rows up to them.

A listing is sorted once, by ranges: each range is a folder with its rows in order and
numbered. The index tells how many rows lie before each range, so a page is read from the
ranges it lies in, and within them from the row groups its numbers are in.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from concilia.session import shared_folder


@dataclass(frozen=True)
class RankIndex:
    """An ordered listing: its folder, its columns, and ``(range, rows before, rows)`` of every
    range; ``total`` counts all rows. The driver holds one entry per range."""

    path: str
    schema: T.StructType
    ranges: tuple[tuple[int, int, int], ...]
    total: int


def rank_index(df: DataFrame, order: Sequence[Column], ranges: int = 200) -> RankIndex:
    """Writes the listing in order, below the shared folder.

    ``order`` should decide between any two rows; equal rows share a range. Ranges come
    from a sample of the order, so they are near in size but of no fixed one.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/listing-{uuid.uuid4().hex}"
    dealt = df.repartitionByRange(ranges, *order).sortWithinPartitions(*order)
    numbered = dealt.withColumns({
        "_range": F.spark_partition_id(),
        # Within a partition these numbers go up by one, from the partition's number on.
        "_place": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)),
    })
    numbered.write.partitionBy("_range").parquet(path)
    own = T.StructType([*df.schema.fields, T.StructField("_place", T.LongType()), T.StructField("_range", T.IntegerType())])
    counted = spark.read.schema(own).parquet(path).groupBy("_range").agg(F.count("*").alias("rows")).orderBy("_range").collect()
    found, before = [], 0
    for row in counted:
        found.append((row._range, before, row.rows))
        before += row.rows
    return RankIndex(path, df.schema, tuple(found), before)


def rows_between(spark: SparkSession, index: RankIndex, first: int, last: int) -> DataFrame:
    """The rows of the listing from place ``first`` up to, not including, ``last``, with their
    place as ``_rank``, from the ranges that hold them alone."""
    schema = T.StructType([*index.schema.fields, T.StructField("_place", T.LongType())])
    out = spark.createDataFrame([], T.StructType([*index.schema.fields, T.StructField("_rank", T.LongType())]))
    for number, before, rows in index.ranges:
        low, high = max(first - before, 0), min(last - before, rows)
        if low < high:
            part = spark.read.schema(schema).parquet(f"{index.path}/_range={number}").where(f"_place >= {low} and _place < {high}")
            out = out.unionByName(part.withColumn("_rank", F.col("_place") + before).drop("_place"))
    return out


def page_at(spark: SparkSession, index: RankIndex, number: int, size: int) -> DataFrame:
    """Page ``number`` (from 0) of ``size`` rows; empty beyond the last one."""
    return rows_between(spark, index, number * size, (number + 1) * size)
