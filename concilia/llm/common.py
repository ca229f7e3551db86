"""What the operators share: the shared folder, written stages, word counting."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from concilia.session import shared_folder

#: Words of a text: runs of characters other than ASCII white space.
WORDS = r"[^\x20\x09-\x0D]+"


def staged(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` to a new folder below the shared one and returns it as a table.

    Cuts the lineage: what follows survives lost executors and never repeats the work
    before it. The planner also gets the table's true size, which decides its joins.
    """
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_or_empty(text: str | Column) -> Column:
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def word_count(text: str | Column) -> Column:
    return F.regexp_count(text_or_empty(text), F.lit(WORDS)).cast("long")


def packed(df: DataFrame, **columns: Column) -> DataFrame:
    """The whole row as one struct ``row`` beside the given columns, so that no name clashes."""
    return df.select(F.struct("*").alias("row"), *(c.alias(n) for n, c in columns.items()))


def unpacked(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.select(*(F.col("row").getField(c).alias(c) for c in columns))


def bounded_sample(rows: DataFrame, by: list[str], most: int, seed: int) -> DataFrame:
    """At most ``most`` rows, those with the smallest seeded hash of ``by``.

    Rows are thinned by their hash to about twice as many before they are ordered, so what
    meets in one task depends on ``most``, not on the number of partitions.
    """
    mark = F.xxhash64(*by, F.lit(seed))
    n = rows.count()
    if n > 2 * most:
        rows = rows.where(F.pmod(mark, F.lit(n)) < 2 * most)
    return rows.orderBy(mark, *by).limit(most)
