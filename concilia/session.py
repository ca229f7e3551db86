"""Session settings the plans count on. All can be changed at run time."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession

SETTINGS = {
    # Partition counts and join strategies are decided from shuffle sizes at run time.
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # Exchanges begin fine and are merged up to the advisory size: what one task sorts or
    # hashes then follows from that size, not from the input divided by a fixed number.
    "spark.sql.adaptive.coalescePartitions.initialPartitionNum": "400",
    # Rows of the two tables take some 35 times their shuffled size where they are sorted.
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "4m",
    # A task that reads files sorts or buffers what it read before it is exchanged.
    "spark.sql.files.maxPartitionBytes": "16m",
    # A side is broadcast by the size it turns out to have, never by that of its files: rows
    # of a few MB of Parquet take many times that where every task keeps them.
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "10m",
    # A hot key on the large side of a lookup is split, even if that costs a later shuffle.
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
}


def adapt(spark: SparkSession) -> SparkSession:
    for name, value in SETTINGS.items():
        spark.conf.set(name, value)
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where it is unset, a local master gets a temporary folder; a cluster is refused, since
    its executors could not see each other's files.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="run-"))
    return spark.sparkContext.getCheckpointDir().rstrip("/")
