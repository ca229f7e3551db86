"""The scan of all rules, brought up to date by what has changed.

A state holds the facts of the registry (see ``wide``), the hits of the rules that compare
members with it, and the sequence up to which versions have been read. New versions touch
the keys they name; members that need one of these keys, and members that changed
themselves, are evaluated anew, and their hits replace the stored ones. The registry's older
versions are not read again: what is needed of them is in the facts. Rules on the members
alone (and on groups of members) are evaluated on the member table as it is, without the
registry.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence
from dataclasses import dataclass, replace
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from concilia.functions.predicates import any_of
from concilia.functions.prepare import prepare_registry
from concilia.operators.matching import lookup
from concilia.plans import scan, wide
from concilia.plans.catalogue import RULES, Rule
from concilia.plans.context import Reconciliation, without_waiting
from concilia.session import shared_folder

_FACTS = wide.KEY + ["newest", "low", "high"]


@dataclass(frozen=True)
class State:
    """Where a state lies: folders of facts (a first one and one per step), of hits, and the
    mark and day they belong to. Folders are never changed once written."""

    facts: tuple[str, ...]
    hits: str
    mark: int
    as_of: str

    def text(self) -> str:
        return json.dumps({"facts": self.facts, "hits": self.hits, "mark": self.mark, "as_of": self.as_of})

    @staticmethod
    def of(text: str) -> "State":
        known = json.loads(text)
        return State(tuple(known["facts"]), known["hits"], known["mark"], known["as_of"])


def _shared_parts(rules: Sequence[Rule]) -> list[tuple]:
    return [(rule, part) for rule in rules if rule.unit != "registry" for part in rule.parts if part.frame in wide.FRAMES]


def _alone(rules: Sequence[Rule]) -> list[Rule]:
    """The rules, without their parts that compare with the registry."""
    own = [(rule, tuple(p for p in rule.parts if p.frame not in wide.FRAMES)) for rule in rules if rule.unit != "registry"]
    return [replace(rule, parts=parts, count_parts=None, detail_parts=None) for rule, parts in own if parts]


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def _written(df: DataFrame, name: str) -> str:
    path = _folder(df.sparkSession, name)
    df.write.parquet(path)
    return path


def start(ctx: Reconciliation, rules: Sequence[Rule] = RULES) -> State:
    """The state of these tables, from all of them."""
    spark = ctx.members.sparkSession
    facts = _written(wide.registry_facts(ctx.r), "facts")
    known = wide.merged_facts(spark.read.parquet(facts), _titles(ctx))
    hits = _written(wide.hits(ctx, _shared_parts(rules), facts=known), "hits")
    mark = ctx.registry.agg(F.max("numseq")).first()[0]
    return State((facts,), hits, -(2**63) if mark is None else mark, ctx.as_of)


def _titles(ctx: Reconciliation) -> DataFrame:
    """Facts of contract titles; contracts change in place, so these are never stored."""
    return wide.registry_facts(ctx.r.limit(0), ctx.contracts)


def _newer(ctx: Reconciliation, mark: int) -> DataFrame:
    """Versions above the mark. Those without a sequence cannot be told apart and are read
    again; that changes nothing, since facts only take least and greatest values."""
    return ctx.registry.where((F.col("numseq") > mark) | F.col("numseq").isNull())


def _turned(parts: Sequence[tuple], before: Column, now: Column) -> Column:
    """Whether the day alone may change what a member hits."""
    tests = [F.lit(False)]
    for _, part in parts:
        old, new = (F.coalesce(part.given(day), F.lit(False)) for day in (before, now))
        tests.append(old != new)
        if str(part.when(before)) != str(part.when(now)):
            tests.append(new)
    return any_of(tests)


def advance(
    ctx: Reconciliation, state: State, changed: DataFrame, changed_titles: DataFrame | None = None, rules: Sequence[Rule] = RULES
) -> State:
    """The state of these tables, from an older one and what has changed since.

    ``changed`` has the ``id`` of every member that was added, removed or changed;
    ``changed_titles`` the ``codtit`` of every changed contract. The registry may only have
    grown, by versions with greater sequences (or none).
    """
    spark, parts = ctx.members.sparkSession, _shared_parts(rules)
    new = _newer(ctx, state.mark)
    step = _written(wide.registry_facts(prepare_registry(new)), "facts")
    fresh = spark.read.parquet(step)
    keys = fresh.select(*wide.KEY)
    if changed_titles is not None:
        titles = changed_titles.select(*wide._key(wide.TITLE, F.col("codtit"))).distinct()
        keys = keys.unionByName(titles)
    wanted = wide.probes(ctx, ctx.m, [p for _, p in parts])
    right = keys.select(*[F.col(k).alias(f"t_{k}") for k in wide.KEY])
    touched = lookup(wanted, right, {k: f"t_{k}" for k in wide.KEY}, "left_semi").select("id")
    touched = touched.unionByName(changed.select("id"))
    if state.as_of != ctx.as_of:
        before = F.lit(date.fromisoformat(state.as_of))
        touched = touched.unionByName(ctx.m.where(_turned(parts, before, ctx.day)).select("id"))
    touched = spark.read.parquet(_written(touched.distinct().select(F.col("id").alias("of")), "touched"))
    rows = lookup(ctx.m, touched, {"id": "of"}, "left_semi")
    # Of all stored facts only those that these members need are merged.
    needed = wide.probes(ctx, rows, [p for _, p in parts]).select(*[F.col(k).alias(f"n_{k}") for k in wide.KEY]).distinct()
    stored = spark.read.parquet(*state.facts, step).select(*_FACTS).unionByName(_titles(ctx))
    stored = stored.join(needed, [F.col(k) == F.col(f"n_{k}") for k in wide.KEY], "left_semi")
    again = wide.hits(ctx, parts, members=rows, facts=wide.merged_facts(stored))
    old = lookup(spark.read.parquet(state.hits), touched, {"id": "of"}, "left_anti")
    hits = _written(old.unionByName(again), "hits")
    newest = new.agg(F.max("numseq")).first()[0]
    return State((*state.facts, step), hits, max(state.mark, state.mark if newest is None else newest), ctx.as_of)


def compacted(spark: SparkSession, state: State) -> State:
    """The same state with its facts in one folder."""
    if len(state.facts) == 1:
        return state
    return replace(state, facts=(_written(wide.merged_facts(spark.read.parquet(*state.facts)), "facts"),))


def rule_scan(ctx: Reconciliation, state: State, rules: Sequence[Rule] = RULES) -> DataFrame:
    """``scan.rule_scan`` of the tables a state is about, without reading the registry."""
    hits = ctx.members.sparkSession.read.parquet(state.hits)
    if ctx.ledger is not None:
        hits = without_waiting(ctx, hits)
    found = hits.unionByName(scan.hits(ctx, _alone(rules), counting=False))
    return scan.by_member(found)
