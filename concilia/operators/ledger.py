"""Tracker of corrections that wait for the registry to reflect them.

The ledger is a plain table, one row per member and rule. Each step is a function from
ledger to ledger; the caller writes the result. Life of a row: waiting, then resolved
(by the registry or by hand) or expired; applying the correction again renews it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from concilia.functions.text import nullif_blank
from concilia.operators.matching import distinct_keys, lookup
from concilia.operators.versions import first_per_key, high_water_mark, latest_version
from concilia.vocabulary import (
    EXCLUSION, EXPIRED, REG_ACTIVE, REG_INACTIVE, REINCLUSION, RESOLVED, WAIT_DAYS, WAITING,
)

# Rule -> (registry status that confirms it, movement applied).
AWAITED = {
    "ativo_inativo_confsib_reinclusao": (REG_ACTIVE, REINCLUSION),
    "inativo_cadusu_ativo_confsib": (REG_INACTIVE, EXCLUSION),
}
LABELS = {
    "ativo_inativo_confsib_reinclusao": "Waiting for the registry: re-inclusion",
    "inativo_cadusu_ativo_confsib": "Waiting for the registry: exclusion",
}
KEY = ["cadusu_id", "rule_id"]
COLUMNS = [
    "cadusu_id", "rule_id", "codcco", "posans_aplicado", "status", "applied_at", "wait_until",
    "resolved_at", "note", "baseline_numseq",
]


def by_rule(values: dict[str, str]) -> Column:
    """``rule_id`` to a value, as one CASE expression; NULL for other rules."""
    out = F.lit(None).cast("string")
    for rule_id, value in values.items():
        out = F.when(F.col("rule_id") == rule_id, F.lit(value)).otherwise(out)
    return out


def current(events: DataFrame) -> DataFrame:
    """Current row per member and rule of an append-only event table."""
    return first_per_key(events.select(*COLUMNS), KEY, [F.col("applied_at").desc_nulls_last()])


def newest_of_keys(registry: DataFrame, keys: DataFrame) -> DataFrame:
    """Newest registry version of the given trimmed CCOs only. Prepared registry.

    The registry is reduced to those keys first: a ledger is far smaller than it.
    """
    wanted = distinct_keys(keys, "k_cco")
    rows = registry.select("r_cco", "r_numseq", "r_state")
    return latest_version(lookup(rows, wanted, {"r_cco": "k_cco"}, "left_semi"), ["r_cco"])


def registrations(
    rule_id: str,
    applied: DataFrame,
    registry: DataFrame,
    now: Column,
    wait_days: int = WAIT_DAYS,
    note: str | None = None,
) -> DataFrame:
    """Ledger rows for members a correction was just applied to (``id, codcco, posans``)."""
    if rule_id not in AWAITED:
        return applied.sparkSession.createDataFrame([], _schema())
    rows = applied.select(
        F.col("id").alias("cadusu_id"), nullif_blank("codcco").alias("k_cco"), "posans"
    )
    newest = newest_of_keys(registry, rows)
    joined = lookup(rows, newest, {"k_cco": "r_cco"}, "left", spread_by="cadusu_id")
    return joined.select(
        "cadusu_id",
        F.lit(rule_id).alias("rule_id"),
        F.col("k_cco").alias("codcco"),
        F.coalesce("posans", F.lit(AWAITED[rule_id][1])).alias("posans_aplicado"),
        F.lit(WAITING).alias("status"),
        now.alias("applied_at"),
        F.make_dt_interval(F.lit(int(wait_days))).alias("_wait"),
        F.lit(None).cast("timestamp").alias("resolved_at"),
        F.lit(note or LABELS[rule_id]).alias("note"),
        F.col("r_numseq").alias("baseline_numseq"),
    ).withColumn("wait_until", F.col("applied_at") + F.col("_wait")).select(*COLUMNS)


def _schema():
    from concilia.schemas import LEDGER

    return LEDGER


def register(ledger: DataFrame, new: DataFrame) -> DataFrame:
    """Insert or renew: new rows replace the rows of the same member and rule."""
    kept = ledger.join(new.select(*KEY), KEY, "left_anti")
    return kept.select(*COLUMNS).unionByName(new.select(*COLUMNS))


def _waiting() -> Column:
    return F.col("status") == WAITING


def _close(ledger: DataFrame, hit: Column, status: str, now: Column, note: Column) -> DataFrame:
    hit = F.coalesce(hit, F.lit(False))
    return ledger.withColumns({
        "status": F.when(hit, F.lit(status)).otherwise(F.col("status")),
        "resolved_at": F.when(hit, now).otherwise(F.col("resolved_at")),
        "note": F.when(hit, F.coalesce(note, F.col("note"))).otherwise(F.col("note")),
    })


def expire(ledger: DataFrame, now: Column) -> DataFrame:
    """Waiting rows whose window ended are expired; their members are listed again."""
    return _close(
        ledger, _waiting() & (F.col("wait_until") < now), EXPIRED, now, F.col("note")
    )


def auto_resolve(ledger: DataFrame, registry: DataFrame, now: Column) -> DataFrame:
    """Resolve waiting rows whose CCO shows the expected status in a newer version."""
    marked = ledger.withColumn(
        "k_cco", F.when(_waiting(), nullif_blank("codcco"))
    )
    newest = newest_of_keys(registry, marked)
    joined = lookup(marked, newest, {"k_cco": "r_cco"}, "left", spread_by="cadusu_id")
    expected = by_rule({rule: status for rule, (status, _) in AWAITED.items()})
    base = F.col("baseline_numseq")
    reflected = (
        _waiting()
        & F.col("r_numseq").isNotNull()
        & (F.upper("r_state") == expected)
        & (base.isNull() | (F.col("r_numseq") > base))
    )
    against = F.coalesce(
        F.concat(F.lit(" > baseline="), base.cast("string")), F.lit(" (sem baseline)")
    )
    note = F.concat(
        F.lit("auto: confsib status="), F.col("r_state"), F.lit(" numseq="),
        F.col("r_numseq").cast("string"), against,
    )
    return _close(joined, reflected, RESOLVED, now, note).select(*COLUMNS)


def resolve(
    ledger: DataFrame,
    selection: DataFrame,
    rule_id: str,
    now: Column,
    status: str = RESOLVED,
    note: str | None = None,
) -> DataFrame:
    """Close waiting rows of the chosen members (``id``) by hand."""
    chosen = selection.select(F.col("id").alias("s_id")).distinct()
    joined = lookup(ledger, chosen, {"cadusu_id": "s_id"}, "left", spread_by="cadusu_id")
    hit = _waiting() & (F.col("rule_id") == rule_id) & F.col("s_id").isNotNull()
    return _close(joined, hit, status, now, F.lit(note).cast("string")).select(*COLUMNS)


def refresh(ledger: DataFrame, registry: DataFrame, now: Column) -> DataFrame:
    """What a reader sees: ended windows expired, reflected rows resolved."""
    return auto_resolve(expire(ledger, now), registry, now)


def active_ids(ledger: DataFrame, now: Column, rule_id: str | None = None) -> DataFrame:
    """Members still waiting (window not ended), distinct."""
    rows = ledger.filter(_waiting() & (F.col("wait_until") >= now))
    if rule_id is not None:
        rows = rows.filter(F.col("rule_id") == rule_id)
    return rows.select("cadusu_id").distinct()


def listing(
    ledger: DataFrame,
    rule_id: str | None = None,
    status: str | None = WAITING,
    limit: int | None = None,
) -> DataFrame:
    rows = ledger
    if rule_id:
        rows = rows.filter(F.col("rule_id") == rule_id)
    if status:
        rows = rows.filter(F.col("status") == status)
    ordered = rows.orderBy(
        F.col("applied_at").desc_nulls_last(), F.col("cadusu_id"), F.col("rule_id")
    )
    return ordered.limit(limit) if limit else ordered


def summary(ledger: DataFrame) -> DataFrame:
    """Waiting rows by rule, with the rule's label."""
    return (
        ledger.filter(_waiting())
        .groupBy("rule_id")
        .agg(F.count(F.lit(1)).alias("total"))
        .withColumn("label", F.coalesce(by_rule(LABELS), F.col("rule_id")))
    )


def sync_state(registry: DataFrame, previous: DataFrame) -> DataFrame:
    """Newest registry sequence against the stored mark (``max_numseq``), one row.

    Both sides are one-row aggregates.
    """
    now_max = high_water_mark(registry)
    before = previous.agg(F.max("max_numseq").alias("previous_max_numseq"))
    tagged = now_max.withColumn("previous_max_numseq", F.lit(None).cast("long")).unionByName(
        before.withColumn("max_numseq", F.lit(None).cast("long"))
    )
    return tagged.agg(
        F.max("max_numseq").alias("max_numseq"),
        F.max("previous_max_numseq").alias("previous_max_numseq"),
    ).withColumn(
        "refreshed",
        F.coalesce(F.col("max_numseq") > F.col("previous_max_numseq"), F.lit(False)),
    )
