"""Does an event follow within a waiting time? Exact, without pairing rows with events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from concilia.operators.matching import lookup


def followed_within(
    waiting: DataFrame,
    events: DataFrame,
    keys: dict[str, str],
    since: str,
    at: str,
    seconds: int,
    spread_by: str,
) -> DataFrame:
    """``waiting`` with ``followed``: some event of the key is in (``since``, ``since`` + wait].

    Time is cut into slots as long as the wait, so the window touches the row's own slot,
    where the last event has to come after ``since``, and the next one, where the first
    event has to come in time. Events are reduced to first and last per key and slot
    (before the shuffle), and each row makes one lookup. A key with very many events is
    spread over its slots.
    """
    micros = int(seconds) * 1_000_000
    moment = F.col(at).cast("timestamp")

    def slot_of(time: Column) -> Column:
        value = F.unix_micros(time)
        return ((value - F.pmod(value, F.lit(micros))) / F.lit(micros)).cast("long")

    slot = slot_of(moment)
    roles = F.array(
        F.struct(slot.alias("slot"), moment.alias("last"),
                 F.lit(None).cast("timestamp").alias("next")),
        F.struct((slot - 1).alias("slot"), F.lit(None).cast("timestamp").alias("last"),
                 moment.alias("next")),
    )
    right = list(keys.values())
    facts = (
        events.dropna(subset=[*right, at])
        .select(*[F.col(k).alias(f"e_{k}") for k in right], F.inline(roles))
        .groupBy(*[f"e_{k}" for k in right], F.col("slot").alias("e_slot"))
        .agg(F.max("last").alias("e_last"), F.min("next").alias("e_next"))
    )
    start = F.col(since).cast("timestamp")
    marked = waiting.withColumn("_slot", slot_of(start))
    joined = lookup(
        marked, facts, {**{k: f"e_{v}" for k, v in keys.items()}, "_slot": "e_slot"}, "left",
        spread_by=spread_by,
    )
    limit = start + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(int(seconds)))
    followed = (F.col("e_last") > start) | (F.col("e_next") <= limit)
    return joined.withColumn("followed", F.coalesce(followed, F.lit(False))).select(
        *waiting.columns, "followed"
    )
