"""Facts about groups of members, without ever collecting a group.

Group facts are aggregated (partial aggregation before the shuffle), giving one row per
group, and looked up by the members that need them. A group holding a third of the table
costs each map task one partial row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from concilia.functions.dates import br_date_text
from concilia.functions.text import company, is_cpf, is_present
from concilia.vocabulary import ACTIVE, HOLDER


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys used more than once, with ``n``."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def mixed_groups(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Groups of two or more rows whose ``value`` is not the same in all, NULL being a value."""
    stats = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.min(value).alias("least"),
        F.max(value).alias("greatest"),
        F.count_if(F.col(value).isNull()).alias("unknown"),
    )
    return stats.filter(differing())


def differing() -> Column:
    mixed = (F.col("unknown") > 0) & (F.col("unknown") < F.col("n"))
    return (F.col("n") > 1) & (~F.col("least").eqNullSafe(F.col("greatest")) | mixed)


def cpf_base(members: DataFrame) -> DataFrame:
    """Active members with a well-formed CPF and a company; adds ``empresa`` and ``cpf``."""
    return members.filter(
        (F.col("situusu") == ACTIVE) & is_cpf("cpfusu") & (F.length("codtit") >= 4)
    ).withColumns({"empresa": company("codtit"), "cpf": F.trim("cpfusu")})


def cpf_group_stats(base: DataFrame) -> DataFrame:
    """Per company and CPF: size, birth range, and the member that keeps the CPF.

    The keeper is the earliest birth (unknown last), then the holder, then the lowest id.
    """
    rank = F.struct(
        F.col("nascusu").isNull().alias("a"),
        F.col("nascusu").alias("b"),
        (~F.coalesce(F.col("codusu") == HOLDER, F.lit(False))).alias("c"),
        F.col("id").alias("id_mantido"),
        F.col("cpfusu").alias("cpf_mantido"),
        F.col("nascusu").alias("nasc_mantido"),
        F.col("nomeusu").alias("nome_mantido"),
    )
    return base.groupBy(
        F.col("empresa").alias("g_empresa"), F.col("cpf").alias("g_cpf")
    ).agg(
        F.count(F.lit(1)).alias("n"),
        F.min("nascusu").alias("least"),
        F.max("nascusu").alias("greatest"),
        F.count_if(F.col("nascusu").isNull()).alias("unknown"),
        F.min(rank).alias("keeper"),
    )


def birth_lists(members: DataFrame) -> DataFrame:
    """Per company and CPF of active members, the distinct births as ``a | b``, in text order.

    Days are made distinct first, so a list is bounded by the calendar, not by the group.
    """
    rows = members.filter(
        (F.col("situusu") == ACTIVE) & is_present("cpfusu") & (F.length("codtit") >= 4)
    ).select(
        company("codtit").alias("b_empresa"),
        F.trim("cpfusu").alias("b_cpf"),
        br_date_text("nascusu").alias("day"),
    )
    return rows.distinct().groupBy("b_empresa", "b_cpf").agg(
        F.array_join(F.sort_array(F.collect_list("day")), " | ").alias("nascimentos_do_cpf")
    )
