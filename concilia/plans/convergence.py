"""Apply all correction plans until nothing changes, and tell where that never happens.

Plans feed each other: a correction may make another rule hit the same member. In a round
every member takes the changes of one plan, the first in catalogue order that would change
it, all decided on one snapshot. A member that comes back to a state it has been in is in a
cycle: it is left there, named, and takes no further part. Each member runs through
different states only, so members come to rest. A contract whose holders differ may still
take their names in turn: once it has a name again that it had, and none of its members has
changed since, it is in a cycle too and keeps that name. So the rounds end.

Rounds change members and contracts, not the registry: what the frames look up of it is
reduced once, before the first round.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from concilia import schemas
from concilia.plans.catalogue import BY_ID
from concilia.plans.context import Reconciliation
from concilia.plans.corrections import CONTRACT_TABLE, MEMBER_TABLE, PLANS, change_set
from concilia.session import shared_folder
from concilia.sources import snapshots

#: All that a plan may set on a member.
FIELDS = tuple(dict.fromkeys(field for plan in PLANS for field in plan.assign))


@dataclass(frozen=True)
class Converged:
    """``members`` and ``contracts`` at the end, ``trail`` (``id, round, rule_id``: which plan
    changed a member when), ``cycles`` (``id, round, since``: in which round a member came
    back to the state it had after round ``since``), the number of rounds with changes, and
    ``contract_cycles`` (``codtit, round, since``: the same of contract names)."""

    members: DataFrame
    contracts: DataFrame
    trail: DataFrame
    cycles: DataFrame
    rounds: int
    contract_cycles: DataFrame


def _state() -> Column:
    """What a plan could change of a member, as one value."""
    return F.sha2(F.to_json(F.struct(*FIELDS), {"ignoreNullFields": "false"}), 256)


class _Scratch:
    """Tables of a run, each in a folder of its own below the shared one."""

    def __init__(self, spark: SparkSession):
        self.spark, self.path = spark, f"{shared_folder(spark)}/converge-{uuid.uuid4().hex}"

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{self.path}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.path}/{name}")


def _chosen(changes: DataFrame) -> DataFrame:
    """Per member the changes of the first plan that changes it."""
    position = F.coalesce(*[F.when(F.col("rule_id") == plan.rule_id, F.lit(i)) for i, plan in enumerate(PLANS)])
    ranked = changes.where(F.col("table_name") == MEMBER_TABLE).withColumn("position", position)
    # A member's changes are bounded by the plans and their fields.
    entry = F.struct("field", "new_value")
    per_plan = ranked.groupBy("key", "position", "rule_id").agg(F.collect_set(entry).alias("entries"))
    first = per_plan.groupBy("key").agg(F.min(F.struct("position", "rule_id", "entries")).alias("p"))
    return first.select(F.col("key").cast("long").alias("id"), "p.rule_id", F.map_from_entries("p.entries").alias("new"))


def _wide(chosen: DataFrame, rows: DataFrame) -> DataFrame:
    """``new_`` values of every field, those that stay included, and the state after."""
    def value(field: str) -> Column:
        kind = rows.schema[field].dataType
        return F.when(F.map_contains_key("new", field), F.col("new")[field].cast(kind)).otherwise(F.col(field))

    after = rows.join(chosen, "id").select("id", "rule_id", _state().alias("before"), *[value(f).alias(f) for f in FIELDS])
    return after.select("id", "rule_id", "before", _state().alias("after"), *[F.col(f).alias(f"new_{f}") for f in FIELDS])


def _names(changes: DataFrame, cycles: DataFrame) -> DataFrame:
    """``codtit, new_name``: the names that contracts outside ``cycles`` take."""
    named = changes.where(F.col("table_name") == CONTRACT_TABLE).groupBy(F.col("key").alias("codtit")).agg(F.min("new_value").alias("new_name"))
    return named.join(cycles.select("codtit"), "codtit", "left_anti")


def _contracts(now: Reconciliation, named: DataFrame) -> DataFrame:
    differs = F.col("new_name").isNotNull() & ~F.col("new_name").eqNullSafe(F.col("nometit"))
    joined = now.contracts.join(named, "codtit", "left").withColumns({
        "nometit": F.when(differs, F.col("new_name")).otherwise(F.col("nometit")),
        "dtope": F.when(differs, now.moment).otherwise(F.col("dtope")),
    })
    return joined.select(*now.contracts.columns)


def _named_again(named: DataFrame, titles: DataFrame, trail: DataFrame, members: DataFrame, number: int) -> DataFrame:
    """``codtit, round, since`` of contracts that take a name they had after round ``since``,
    while none of their members has changed."""
    had = titles.select(F.col("codtit").alias("of"), "round", "name")
    again = named.join(had, F.expr("codtit = of and new_name = name")).groupBy("codtit").agg(F.max("round").alias("since"))
    moved = members.select("id", F.col("codtit").alias("of")).join(trail, "id").groupBy("of").agg(F.max("round").alias("last"))
    still = again.join(moved, F.expr("codtit = of and last > since"), "left_anti")
    return still.select("codtit", F.lit(number).alias("round"), "since")


def _frames(rule_ids: Sequence[str] | None) -> set[str]:
    plans = [plan for plan in PLANS if rule_ids is None or plan.rule_id in rule_ids]
    return {part.frame for plan in plans for part in (*(plan.parts or ()), *BY_ID[plan.rule_id].parts)}


def converge(ctx: Reconciliation, rule_ids: Sequence[str] | None = None, buckets: int = 64) -> Converged:
    """The tables after all plans (or the given ones), applied until nothing changes.

    The ledger is read, not written: a correction that only waiting for the registry keeps
    from being undone shows as a cycle. A round writes the buckets of the members it
    changes, not the table.
    """
    spark = ctx.members.sparkSession
    scratch = _Scratch(spark)
    store = snapshots.Store(f"{scratch.path}/members", schemas.MEMBERS, buckets)
    version, rounds = snapshots.create(store, ctx.members), 0
    now = ctx.with_sides(sorted(_frames(rule_ids)), lambda df, frame: scratch.keep(df, f"side-{frame}"))
    trail = spark.createDataFrame([], "id long, round int, rule_id string")
    cycles = spark.createDataFrame([], "id long, round int, since int")
    states = spark.createDataFrame([], "id long, round int, state string")
    titles = spark.createDataFrame([], "codtit string, round int, name string")
    contract_cycles = spark.createDataFrame([], "codtit string, round int, since int")
    while True:
        members = snapshots.read(spark, store, version)
        now = replace(now, members=members)
        changes = scratch.keep(change_set(now, rule_ids), f"changes-{rounds + 1}")
        free = _chosen(changes).join(cycles.select("id"), "id", "left_anti")
        moves = scratch.keep(_wide(free, members), f"moves-{rounds + 1}")
        named = scratch.keep(_names(changes, contract_cycles), f"names-{rounds + 1}")
        retitled = not named.isEmpty()
        if moves.isEmpty() and not retitled:
            return Converged(members, now.contracts, trail, cycles, rounds, contract_cycles)
        rounds += 1
        version = snapshots.apply(spark, store, version, moves.drop("rule_id", "before", "after"), ctx.day, ctx.moment)
        if retitled:
            now = replace(now, contracts=scratch.keep(_contracts(now, named), f"contracts-{rounds}"))
        # States before a member's first change are known from then on.
        first = moves.join(states.select("id").distinct(), "id", "left_anti")
        states = states.unionByName(first.select("id", F.lit(rounds - 1).alias("round"), F.col("before").alias("state")))
        back = moves.join(states.select(F.col("id").alias("of"), "round", "state"), F.expr("id = of and after = state"))
        back = back.groupBy("id").agg(F.lit(rounds).alias("round"), F.max("round").alias("since"))
        back = scratch.keep(back.select("id", "round", "since"), f"back-{rounds}")
        cycles = scratch.keep(cycles.unionByName(back), f"cycles-{rounds}")
        states = scratch.keep(
            states.unionByName(moves.select("id", F.lit(rounds).alias("round"), F.col("after").alias("state"))), f"states-{rounds}"
        )
        trail = scratch.keep(trail.unionByName(moves.select("id", F.lit(rounds).alias("round"), "rule_id")), f"trail-{rounds}")
        if retitled:
            again = _named_again(named, titles, trail, members, rounds)
            contract_cycles = scratch.keep(contract_cycles.unionByName(again), f"contract-cycles-{rounds}")
            taken = named.select("codtit", F.lit(rounds).alias("round"), F.col("new_name").alias("name"))
            titles = scratch.keep(titles.unionByName(taken), f"titles-{rounds}")
