"""Newest registry version per key while loads keep arriving."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from concilia.sources import snapshots


def newest_versions(
    versions: DataFrame, keys: Sequence[str], sequence: str = "r_numseq"
) -> DataFrame:
    """One row per key, updated as newer versions arrive (use update mode).

    The state is one row per key, kept in the state store of the query's checkpoint, and
    merged on the map side first. The order is that of ``latest_version``: an unknown
    sequence ranks first, then the highest. Works on a batch DataFrame as well.
    """
    content = [c for c in versions.columns if c not in keys]
    ranked = F.struct(
        F.col(sequence).isNull().alias("_unknown"),
        F.col(sequence).alias("_sequence"),
        *[F.col(c) for c in content],
    )
    newest = versions.dropna(subset=list(keys)).groupBy(*keys).agg(F.max(ranked).alias("_v"))
    return newest.select(*keys, *[F.col(f"_v.{c}").alias(c) for c in content])


def keep_newest(store: snapshots.Store, sequence: str = "r_numseq"):
    """A ``foreachBatch`` function that keeps the newest version of every key as a table.

    ``store.key`` is the versions' key. Batch ``n`` writes the table's version ``n + 1``:
    only the buckets of the keys in the batch, merged with what they held. A batch that is
    handed over again after a failure finds its version there and does nothing; one that
    failed half way has published nothing and is done anew. So the table holds each batch
    once. An empty batch repeats the list of the version before.
    """
    def upsert(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        there = snapshots.versions(spark, store)
        if number + 1 in there:
            return
        before = max((v for v in there if v <= number), default=0)
        rows = batch.select(*store.schema.names)
        snapshots.rewrite(
            spark, store, before, rows, lambda old: newest_versions(old.unionByName(rows), [store.key], sequence).select(*store.schema.names),
            to=number + 1,
        )

    return upsert


def newest_table(spark, store: snapshots.Store) -> DataFrame:
    """The table as of the last batch."""
    return snapshots.read(spark, store, snapshots.versions(spark, store)[-1])
