"""Pick versions: the newest per key, and the two newest that differ in a value.

All of them rank inside a key and keep the first ranks. Spark places a group limit
before the shuffle (``WindowGroupLimit``), so each map task sends at most that many
rows per key: one key holding a third of the table still reaches its reducer as a
handful of rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from concilia.functions.prepare import NORMALISED


def _total_order(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> list[Column]:
    """``order``, then the content of the row, so that equal sequences give a stable pick.

    Rows that still tie agree in every column they could be told apart by. Normalised
    columns follow from the others and need not be compared.
    """
    rest = sorted(set(df.columns) - set(keys) - set(NORMALISED))
    return [*order, *[F.col(c).asc_nulls_last() for c in rest]]


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row per distinct ``keys``: the first in ``order``. Select narrow columns first."""
    window = Window.partitionBy(*keys).orderBy(*_total_order(df, keys, order))
    return (
        df.withColumn("_rank", F.row_number().over(window))
        .filter(F.col("_rank") == 1)
        .drop("_rank")
    )


def latest_version(df: DataFrame, keys: Sequence[str], sequence: str = "r_numseq") -> DataFrame:
    """Newest version per key. Keys must be known; an unknown sequence ranks first."""
    known = df.dropna(subset=list(keys))
    return first_per_key(known, keys, [F.col(sequence).desc_nulls_first()])


def latest_two_distinct(
    df: DataFrame, keys: Sequence[str], value: str, sequence: str, prefix: str
) -> DataFrame:
    """Per key, the newest row of each of its two most recent distinct ``value``\\ s.

    One row per key with structs ``{prefix}1`` and ``{prefix}2`` (NULL when there is one
    value only). Whatever value ``x`` is asked for later, "the newest version whose value
    is not x" is the first struct if its value differs from ``x`` and the second
    otherwise, so no member ever has to be paired with all versions of its key.

    Versions that differ in their sequence only are merged first, by hash aggregation;
    just what is left has to be sorted.
    """
    keys = list(keys)
    content = [c for c in df.columns if c not in keys]
    order = [F.col(sequence).desc_nulls_first()]
    merged = (
        df.dropna(subset=keys)
        .groupBy(*[c for c in df.columns if c != sequence])
        .agg(F.max(sequence).alias("_newest"), F.bool_or(F.col(sequence).isNull()).alias("_any"))
        .withColumn(sequence, F.when(~F.col("_any"), F.col("_newest")))
        .drop("_newest", "_any")
    )
    newest_per_value = first_per_key(merged, keys + [value], order)
    window = Window.partitionBy(*keys).orderBy(*_total_order(df, keys, order))
    ranked = (
        newest_per_value.withColumn("_rank", F.row_number().over(window))
        .filter(F.col("_rank") <= 2)
        .withColumn("_row", F.struct(*content))
    )
    return ranked.groupBy(*keys).agg(
        F.max(F.when(F.col("_rank") == 1, F.col("_row"))).alias(f"{prefix}1"),
        F.max(F.when(F.col("_rank") == 2, F.col("_row"))).alias(f"{prefix}2"),
    )


def high_water_mark(registry: DataFrame, sequence: str = "numseq") -> DataFrame:
    return registry.agg(F.max(sequence).alias("max_numseq"))
