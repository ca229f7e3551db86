"""Waiting corrections with a timer each: resolved, renewed or expired, and reopened.

Keyed state where ``pending.resolve_stream`` joins intervals: a correction that is applied
again while it waits moves its timer, and the earlier application has an outcome of its
own; a registry event that arrives after the wait was called expired reopens it.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from contextlib import contextmanager
from datetime import datetime, timedelta, timezone

from pyspark import cloudpickle
from pyspark.sql import DataFrame, Row, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from concilia.vocabulary import EXPIRED, RESOLVED, WAIT_DAYS

# The processor is sent to executors by value: they need not have this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

RENEWED = "renovado"
OUTCOME = "cadusu_id long, rule_id string, applied_at timestamp, status string, decided_at timestamp, reopened boolean"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_OPEN, _CLOSED, _LAPSED = "open", "closed", "lapsed"


_START = datetime(1970, 1, 1, tzinfo=timezone.utc)


def _moment(micros: int) -> datetime:
    return _START + timedelta(microseconds=micros)


def _timer(micros: int) -> int:
    """Timers and watermarks count milliseconds: the first one not before the moment."""
    return -(-micros // 1000)


class _Waits(StatefulProcessor):
    """The state of one CCO: what has arrived and not been settled yet (``todo``), the newest
    application per member and rule (``waits``), and recent registry events (``seen``).

    Rows are settled in the order of their own time once the watermark has passed their
    arrival, so the order of arrival within the allowed lateness decides nothing.
    """

    def __init__(self, wait_micros: int):
        self.wait = wait_micros

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.todo = handle.getListState("todo", "kind string, at long, clock long, member long, rule string, state string")
        self.waits = handle.getMapState("waits", "member long, rule string", "applied long, until long, expected string, phase string")
        self.seen = handle.getListState("seen", "state string, at long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        clocks = set()
        for row in rows:
            self.todo.appendValue((row.kind, row.at, row.clock_at, row.cadusu_id, row.rule_id, row.state))
            clocks.add(_timer(row.clock_at))
        for clock in clocks:
            self.handle.registerTimer(clock)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        return iter(self._settle(1000 * timerValues.getCurrentWatermarkInMs()))

    def close(self) -> None:
        pass

    def _settle(self, now: int) -> list[Row]:
        out: list[Row] = []
        every = [tuple(row) for row in self.todo.get()]
        ripe = sorted((r for r in every if r[2] <= now), key=lambda r: (r[1], r[0] == "applied", r[3] or 0, r[4] or ""))
        waits = {tuple(k): tuple(v) for k, v in self.waits.iterator()}
        seen = [tuple(row) for row in self.seen.get()]
        before = dict(waits), list(seen)
        for kind, at, _, member, rule, state in ripe:
            self._lapse(waits, at - 1, out)
            if kind == "seen":
                seen.append((state, at))
                for of, (applied, until, expected, phase) in waits.items():
                    if phase != _CLOSED and expected == state and applied < at <= until:
                        out.append(self._row(of, applied, RESOLVED, at, phase == _LAPSED))
                        waits[of] = (applied, until, expected, _CLOSED)
                continue
            of, known = (member, rule), waits.get((member, rule))
            if known and at <= known[0]:
                if at < known[0]:  # an application older than the newest one: decided by what is known
                    out.append(self._older(of, at, known[0], state, seen))
                continue
            if known and known[3] == _OPEN:
                out.append(self._row(of, known[0], RENEWED, at, False))
            until = at + self.wait
            hits = [t for s, t in seen if s == state and at < t <= until]
            if hits:
                out.append(self._row(of, at, RESOLVED, min(hits), False))
            else:
                self.handle.registerTimer(_timer(until))
            waits[of] = (at, until, state, _CLOSED if hits else _OPEN)
        self._lapse(waits, now, out)
        # A lapsed wait can be reopened for as long as it lasted, an event serve as long.
        waits = {of: w for of, w in waits.items() if w[1] + self.wait > now}
        seen = [(s, t) for s, t in seen if t + self.wait > now]
        self._store(waits, seen, before, [r for r in every if r[2] > now] if ripe else None)
        return out

    def _lapse(self, waits: dict, now: int, out: list[Row]) -> None:
        for of, (applied, until, expected, phase) in waits.items():
            if phase == _OPEN and until <= now:
                out.append(self._row(of, applied, EXPIRED, until, False))
                waits[of] = (applied, until, expected, _LAPSED)
                self.handle.registerTimer(_timer(until + self.wait))

    def _older(self, of: tuple, at: int, newer: int, state: str, seen: list) -> Row:
        until = at + self.wait
        hits = [t for s, t in seen if s == state and at < t <= min(until, newer)]
        if hits:
            return self._row(of, at, RESOLVED, min(hits), False)
        return self._row(of, at, RENEWED, newer, False) if newer <= until else self._row(of, at, EXPIRED, until, False)

    def _row(self, of: tuple, applied: int, status: str, decided: int, reopened: bool) -> Row:
        return Row(
            cadusu_id=of[0], rule_id=of[1], applied_at=_moment(applied), status=status, decided_at=_moment(decided), reopened=reopened
        )

    def _store(self, waits: dict, seen: list, before: tuple, todo: list | None) -> None:
        for of in before[0].keys() - waits.keys():
            self.waits.removeKey(of)
        for of, wait in waits.items():
            if before[0].get(of) != wait:
                self.waits.updateValue(of, wait)
        for state, rows, changed in ((self.seen, seen, seen != before[1]), (self.todo, todo, todo is not None)):
            if changed and rows:
                state.put(rows)
            elif changed:
                state.clear()


@contextmanager
def rocksdb(spark: SparkSession):
    """Queries started inside keep their state in RocksDB, which keyed timers need."""
    before = spark.conf.get(_PROVIDER)
    spark.conf.set(_PROVIDER, _ROCKSDB)
    try:
        yield
    finally:
        spark.conf.set(_PROVIDER, before)


def outcomes(
    applied: DataFrame, registry_events: DataFrame, wait_hours: int = 24 * WAIT_DAYS, lateness: str = "1 day"
) -> DataFrame:
    """A row per decision: ``cadusu_id, rule_id, applied_at, status, decided_at, reopened``.

    ``applied``: ``cadusu_id, rule_id, k_cco, expected, applied_at``; ``registry_events``:
    ``r_cco, r_state, loaded_at``; both may have ``arrived_at``, the time their arrival is
    judged by (their own time where there is none). What arrives more than ``lateness`` late
    by that time is dropped.

    Of the first event of the CCO with the expected status and the first renewal within the
    wait the earlier one decides (an event at the moment of a renewal comes first): resolved
    or renewed. If there is neither, the wait has expired; an event whose own time lies in the
    wait but which arrives later decides anew, with ``reopened``. The newest row of an
    application is the valid one. Corrections without a CCO have a key of their own each
    and can only be renewed or expire. Start the query inside ``rocksdb``, in append mode.
    """
    def rows(df: DataFrame, kind: str, key, at: str, member, rule, state: str) -> DataFrame:
        clock = F.coalesce("arrived_at", at) if "arrived_at" in df.columns else F.col(at)
        return df.select(
            key.alias("key"), F.lit(kind).alias("kind"), F.unix_micros(at).alias("at"), F.unix_micros(clock).alias("clock_at"),
            member.alias("cadusu_id"), rule.alias("rule_id"), F.col(state).alias("state"), clock.alias("clock"),
        )

    alone = F.concat(F.lit("\u0001"), F.col("cadusu_id").cast("string"))
    left = rows(
        applied, "applied", F.coalesce("k_cco", alone), "applied_at", F.col("cadusu_id").cast("long"), F.col("rule_id"), "expected"
    )
    nobody = F.lit(None)
    right = rows(
        registry_events.filter("r_cco is not null"), "seen", F.col("r_cco"), "loaded_at", nobody.cast("long"), nobody.cast("string"), "r_state"
    )
    arriving = left.unionByName(right).withWatermark("clock", lateness)
    return arriving.groupBy("key").transformWithState(
        statefulProcessor=_Waits(wait_hours * 3_600_000_000), outputStructType=OUTCOME, outputMode="Append", timeMode="EventTime"
    )
