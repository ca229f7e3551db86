"""Read the input tables, with explicit schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, types as T

from concilia import schemas
from concilia.plans.context import Reconciliation
from concilia.session import adapt


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Exactly the schema's columns and types; an input may have more columns."""
    return df.select(*[df[f.name].cast(f.dataType).alias(f.name) for f in schema])


def read_tables(
    spark: SparkSession,
    path: str,
    as_of: str,
    as_of_ts: str,
    names: tuple[str, str, str, str] = ("cadusu", "confsib", "cadcont", "pending"),
) -> Reconciliation:
    """Members, registry, contracts and (if there is one) the ledger, from Parquet."""
    adapt(spark)
    members, registry, contracts, ledger = names
    reader = spark.read.schema
    return Reconciliation(
        members=reader(schemas.MEMBERS).parquet(f"{path}/{members}"),
        registry=reader(schemas.REGISTRY).parquet(f"{path}/{registry}"),
        contracts=reader(schemas.CONTRACTS).parquet(f"{path}/{contracts}"),
        ledger=reader(schemas.LEDGER).parquet(f"{path}/{ledger}") if ledger else None,
        as_of=as_of,
        as_of_ts=as_of_ts,
    )


def read_jdbc(
    spark: SparkSession,
    url: str,
    table: str,
    key: str,
    bounds: tuple[int, int],
    partitions: int,
    schema: T.StructType,
    **options: str,
) -> DataFrame:
    """A live database table, read in parallel ranges of its numeric key."""
    low, high = bounds
    df = (
        spark.read.format("jdbc").options(**options)
        .option("url", url).option("dbtable", table)
        .option("partitionColumn", key).option("lowerBound", low).option("upperBound", high)
        .option("numPartitions", partitions).load()
    )
    return conform(df, schema)
