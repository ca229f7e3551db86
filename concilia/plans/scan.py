"""All rules at once.

Rules are grouped by frame, so the whole catalogue costs one pass over the members per
distinct join (not one per rule): every row is tested against all rules of its frame and
contributes one array of rule ids, which is exploded and counted with partial
aggregation. Rows no rule of the frame is about are dropped before the join. The frames
that compare members with the registry are evaluated together, on one reduction of the
registry (see ``wide``).
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

import pyarrow as pa
from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import DataFrame, SparkSession, functions as F

from concilia.functions.predicates import any_of
from concilia.plans import wide
from concilia.plans.catalogue import RULES, Rule, always
from concilia.plans.context import Reconciliation, without_waiting
from concilia.plans.corrections import metadata
from concilia.vocabulary import ACTIVE, INACTIVE


def _unit_key(unit: str):
    """What a hit is about: a member id, a registry sequence, or just a group."""
    return {"member": F.col("id"), "registry": F.col("r_numseq")}.get(
        unit, F.lit(None).cast("long")
    )


def hits(ctx: Reconciliation, rules: Iterable[Rule] = RULES, counting: bool = True) -> DataFrame:
    """``(rule_id, id)``: one row per thing each rule counts (or lists)."""
    frames: dict[tuple[str, str], list] = {}
    for rule in rules:
        parts = (rule.count_parts if counting else None) or rule.parts
        unit = rule.unit if counting or rule.unit == "registry" else "member"
        for part in parts:
            frames.setdefault((part.frame, unit), []).append((rule, part))

    found = []
    # Rules that compare members with the registry share one reduction of it.
    shared = [key for key in frames if key[0] in wide.FRAMES and key[1] == "member"]
    if len(shared) > 1:
        together = [pair for key in shared for pair in frames.pop(key)]
        hit = wide.hits(ctx, together)
        if ctx.ledger is not None and any(rule.awaits_registry for rule, _ in together):
            hit = without_waiting(ctx, hit)
        found.append(hit)
    for (frame, unit), members in frames.items():
        given = [part.given(ctx.day) for _, part in members]
        rows = ctx.frame(frame, any_of(given))
        # Alone on its frame, a part's ``given`` was already the filter.
        tests = [
            part.when(ctx.day) if len(members) == 1
            else test if part.when is always
            else test & part.when(ctx.day)
            for test, (_, part) in zip(given, members)
        ]
        broken = F.array_compact(F.array(*[
            F.when(test, F.lit(rule.id)) for test, (rule, _) in zip(tests, members)
        ]))
        hit = rows.select(_unit_key(unit).alias("id"), F.explode(broken).alias("rule_id"))
        if ctx.ledger is not None and any(rule.awaits_registry for rule, _ in members):
            hit = without_waiting(ctx, hit)
        found.append(hit)
    return reduce(DataFrame.unionByName, found)


def catalogue(spark: SparkSession, rules: Iterable[Rule] = RULES) -> DataFrame:
    """The rules with what can be done about them. Bounded by the catalogue: 38 rows."""
    rows = []
    for position, rule in enumerate(rules):
        rows.append({
            "position": position, "rule_id": rule.id, "severity": rule.severity,
            "category": rule.category, "title": rule.title, "description": rule.description,
            "expected_zero": rule.expected_zero, **metadata(rule.id),
        })
    return spark.createDataFrame(pa.Table.from_pylist(rows, schema=_CATALOGUE))


_CATALOGUE = pa.schema([
    ("position", pa.int32()), ("rule_id", pa.string()), ("severity", pa.string()),
    ("category", pa.string()), ("title", pa.string()), ("description", pa.string()),
    ("expected_zero", pa.bool_()), ("fixable", pa.bool_()), ("fix_label", pa.string()),
    ("fix_summary", pa.string()), ("fix_fields", pa.string()), ("fix_tip", pa.string()),
    ("badge", pa.string()), ("manual_reason", pa.string()),
])


def rule_summary(ctx: Reconciliation, rules: Iterable[Rule] = RULES) -> DataFrame:
    """Every rule with its total, zero included.

    A rule that cannot be planned on these tables (a column is missing) gets total -1 and
    the error text; the others are counted all the same. A rule that fails while it runs
    fails the one job they share: ``rule_summary_apart`` tells which.
    """
    rules = tuple(rules)
    spark = ctx.members.sparkSession
    errors: dict[str, str] = {}
    try:
        found = hits(ctx, rules)
    except AnalysisException:
        usable = []
        for rule in rules:
            try:
                hits(ctx, (rule,))
                usable.append(rule)
            except AnalysisException as error:
                errors[rule.id] = str(error).splitlines()[0]
        found = hits(ctx, usable)
    totals = found.groupBy("rule_id").agg(F.count(F.lit(1)).alias("hits"))
    return _summary(spark, rules, totals, errors)


def rule_summary_apart(ctx: Reconciliation, rules: Iterable[Rule] = RULES) -> DataFrame:
    """The same summary where rules may fail while they run: one that does gets total -1 and
    its error.

    All rules are counted in one job. If it fails, each half is counted by itself, and so
    on: rules that work are counted together, and one bad rule among n costs some 2 log2(n)
    jobs. The driver sees one number per rule.
    """
    rules = tuple(rules)
    spark = ctx.members.sparkSession
    errors: dict[str, str] = {}
    counted: dict[str, int] = {}

    def count(some: tuple[Rule, ...]) -> None:
        try:
            totals = hits(ctx, some).groupBy("rule_id").agg(F.count(F.lit(1)).alias("hits"))
            counted.update((row.rule_id, row.hits) for row in totals.collect())
        except PySparkException as error:
            if len(some) == 1:
                errors[some[0].id] = str(error).splitlines()[0]
            else:
                half = len(some) // 2
                count(some[:half])
                count(some[half:])

    if rules:
        count(rules)
    totals = spark.createDataFrame(list(counted.items()), "rule_id string, hits long")
    return _summary(spark, rules, totals, errors)


def _summary(
    spark: SparkSession, rules: tuple[Rule, ...], totals: DataFrame, errors: dict[str, str]
) -> DataFrame:
    failed = F.lit(None).cast("string")
    for rule_id, text in errors.items():
        failed = F.when(F.col("rule_id") == rule_id, F.lit(text)).otherwise(failed)
    return (
        catalogue(spark, rules)
        .join(totals, "rule_id", "left")
        .withColumn("error", failed)
        .withColumn(
            "total",
            F.when(F.col("error").isNotNull(), F.lit(-1).cast("long")).otherwise(
                F.coalesce("hits", F.lit(0).cast("long"))
            ),
        )
        .withColumn("ok", F.col("total") == 0)
        .drop("hits")
    )


def summary_meta(summary: DataFrame) -> DataFrame:
    """Number of rules, rules with hits, and hits in all."""
    return summary.agg(
        F.count(F.lit(1)).alias("rules"),
        F.count_if(F.col("total") > 0).alias("rules_with_hits"),
        F.sum(F.greatest(F.col("total"), F.lit(0).cast("long"))).alias("hits"),
    )


def rule_scan(ctx: Reconciliation) -> DataFrame:
    """Every member that breaks some rule, with the ids of the rules, in text order.

    A member's array is bounded by the catalogue.
    """
    about_members = [rule for rule in RULES if rule.unit != "registry"]
    return by_member(hits(ctx, about_members, counting=False))


def by_member(found: DataFrame) -> DataFrame:
    """``id, rules`` from ``id, rule_id``."""
    return found.groupBy("id").agg(F.sort_array(F.collect_set("rule_id")).alias("rules"))


def dashboard(ctx: Reconciliation) -> DataFrame:
    """Members, active, inactive and registry rows, in one row."""
    members = ctx.members.agg(
        F.count(F.lit(1)).alias("cadusu"),
        F.count_if(F.col("situusu") == ACTIVE).alias("ativos"),
        F.count_if(F.col("situusu") == INACTIVE).alias("inativos"),
        F.lit(0).cast("long").alias("confsib"),
    )
    registry = ctx.registry.agg(F.count(F.lit(1)).alias("confsib")).select(
        *[F.lit(0).cast("long").alias(n) for n in ("cadusu", "ativos", "inativos")], "confsib"
    )
    return members.unionByName(registry).agg(
        *[F.sum(n).alias(n) for n in ("cadusu", "confsib", "ativos", "inativos")]
    )
