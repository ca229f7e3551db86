"""Resolve waiting corrections as registry events arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from concilia.vocabulary import EXPIRED, RESOLVED, WAIT_DAYS


def resolve_stream(
    applied: DataFrame, registry_events: DataFrame, wait: str = f"{WAIT_DAYS} days",
    lateness: str = "1 day",
) -> DataFrame:
    """What became of each applied correction: resolved, or expired once its wait is over.

    ``applied``: ``cadusu_id, rule_id, k_cco, expected, applied_at``.
    ``registry_events``: ``r_cco, r_state, loaded_at``.
    A correction that is applied again within its wait has no outcome of its own: the
    renewal decides, as in the ledger. Each application looks for two things in the waiting
    interval, a registry event and a renewal; a left outer interval join finds them, and an
    aggregate per application says which. The watermarks let Spark drop state and decide
    that nothing will come any more. Several matching events give one result.

    What arrives later than ``lateness`` is dropped by the stream, and a correction may then
    be called expired although the registry shows it: ``ledger.auto_resolve`` over the full
    registry, run now and then, resolves such rows.
    """
    event_key = ("k_cco", "expected")
    own_key = ("cadusu_id", "rule_id")

    def key(kind: str, *columns: str):
        return F.concat_ws("\u0001", F.lit(kind), *[F.col(c).cast("string") for c in columns])

    left = applied.withWatermark("applied_at", lateness).select(
        *own_key, "applied_at", F.explode(F.array(
            F.when(F.col("k_cco").isNotNull(), key("event", *event_key)), key("again", *own_key)
        )).alias("l_key"),
    )
    events = registry_events.filter("r_cco is not null").select(
        key("event", "r_cco", "r_state").alias("r_key"), F.col("loaded_at").alias("seen_at")
    )
    again = applied.select(key("again", *own_key).alias("r_key"), F.col("applied_at").alias("seen_at"))
    right = events.unionByName(again).withWatermark("seen_at", lateness)
    joined = left.join(right, F.expr(
        f"l_key = r_key and seen_at > applied_at and seen_at <= applied_at + interval {wait}"
    ), "leftOuter")
    found = F.col("seen_at").isNotNull()
    renewal = F.col("l_key").startswith("again")
    outcome = joined.groupBy(*own_key, "applied_at").agg(
        F.bool_or(found & renewal).alias("renewed"), F.bool_or(found & ~renewal).alias("seen")
    )
    return outcome.filter(~F.col("renewed")).select(
        *own_key, "applied_at",
        F.when(F.col("seen"), F.lit(RESOLVED)).otherwise(F.lit(EXPIRED)).alias("status"),
    )
