"""Apply changes to a member table, and compare change sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def select_ids(df: DataFrame, selection: DataFrame | None, key: str = "id") -> DataFrame:
    """Only the chosen ids. A selection is a table, so it has no size limit."""
    if selection is None:
        return df
    return df.join(selection.select(key).distinct(), key, "left_semi")


def apply_wide(members: DataFrame, changes: DataFrame, day: Column, moment: Column) -> DataFrame:
    """Members with ``new_field`` values where ``changes`` has the id.

    Presence is a flag of its own: a change may set NULL.
    """
    fields = [name[4:] for name in changes.columns if name.startswith("new_")]
    joined = members.join(changes.withColumn("_hit", F.col("id").isNotNull()), "id", "left")
    hit = F.coalesce("_hit", F.lit(False))
    new = {f: F.when(hit, F.col(f"new_{f}")).otherwise(F.col(f)) for f in fields}
    new["dataultalt"] = F.when(hit, day).otherwise(F.col("dataultalt"))
    new["dtope"] = F.when(hit, moment).otherwise(F.col("dtope"))
    return joined.withColumns(new).select(*members.columns)


def conflicts(changes: DataFrame) -> DataFrame:
    """Fields of a row that several rules would set to different values."""
    value = F.coalesce("new_value", F.lit("\u0000"))
    return (
        changes.groupBy("table_name", "key", "field")
        .agg(F.count_distinct(value).alias("values"), F.count_distinct("rule_id").alias("rules"))
        .filter("values > 1")
    )


def apply_counts(requested: DataFrame, updated: DataFrame) -> DataFrame:
    """How many ids were asked for and how many still qualified, in one row."""
    asked = requested.select("id").distinct().withColumn("hit", F.lit(0))
    done = updated.select("id").withColumn("hit", F.lit(1))
    return asked.unionByName(done).agg(
        F.count_if(F.col("hit") == 0).alias("requested"),
        F.count_if(F.col("hit") == 1).alias("updated"),
    )
