"""Waits with timers: every order of arrival, renewals, reopening, restart."""

import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from concilia.streaming import renewals

DAY = datetime(2024, 1, 1)
ROW = "kind string, cadusu_id long, rule_id string, k_cco string, state string, at timestamp, arrived_at timestamp"


def hours(n):
    return DAY + timedelta(hours=n)


def run(spark, folder, batches, lateness="0 seconds"):
    """Outcomes of files that arrive one after the other, each in a run of its own."""
    out = []
    for number, rows in enumerate(batches):
        spark.createDataFrame(rows, ROW).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        arriving = spark.readStream.schema(ROW).parquet(f"{folder}/in")
        applied = arriving.where("kind = 'applied'").select(
            "cadusu_id", "rule_id", "k_cco", F.col("state").alias("expected"), F.col("at").alias("applied_at"), "arrived_at"
        )
        seen = arriving.where("kind = 'seen'").select(
            F.col("k_cco").alias("r_cco"), F.col("state").alias("r_state"), F.col("at").alias("loaded_at"), "arrived_at"
        )
        decided = renewals.outcomes(applied, seen, wait_hours=10, lateness=lateness)
        with renewals.rocksdb(spark):
            query = (
                decided.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state")
                .trigger(availableNow=True).start()
            )
        query.awaitTermination()
        out = spark.read.schema(decided.schema).parquet(f"{folder}/out").collect()
    return sorted((r.cadusu_id, int((r.applied_at - DAY).total_seconds() // 3600), r.status, r.reopened) for r in out)


def applied(member, at, cco="C", arrived=None):
    return ("applied", member, "r", cco, "A", hours(at), hours(at if arrived is None else arrived))


def seen(at, cco="C", state="A", arrived=None):
    return ("seen", None, None, cco, state, hours(at), hours(at if arrived is None else arrived))


END = ("seen", None, None, "end", "A", hours(500), hours(500))


def test_outcomes(spark, folder):
    rows = [
        applied(1, 0), seen(5),  # resolved
        applied(2, 0, "D"), seen(11, "D"),  # too late: expired
        applied(3, 0, "E"), applied(3, 6, "E"), seen(15, "E"),  # renewed, then resolved
        applied(4, 0, "F"), seen(3, "F", "I"),  # another status
        applied(5, 0, None), applied(5, 9, None),  # no CCO
        applied(6, 2, "G"), seen(2, "G"), seen(12, "G"),  # not at the moment itself, but at the last one
        applied(7, 0, "H"), applied(7, 0, "H"),  # twice the same
        END,
    ]
    random.Random(1).shuffle(rows)
    assert run(spark, folder, [rows]) == [
        (1, 0, "resolvido", False), (2, 0, "expirado", False), (3, 0, "renovado", False), (3, 6, "resolvido", False),
        (4, 0, "expirado", False), (5, 0, "renovado", False), (5, 9, "expirado", False), (6, 2, "resolvido", False),
        (7, 0, "expirado", False),
    ]


def test_a_late_event_reopens_and_a_restart_goes_on(spark, folder):
    late = seen(8, arrived=14)
    first = run(spark, folder, [[applied(1, 0), seen(12, "x")]])
    assert first == [(1, 0, "expirado", False)]
    rest = run(spark, folder, [[late], [seen(16, "x")]])
    assert rest == [(1, 0, "expirado", False), (1, 0, "resolvido", True)]


def test_an_application_that_arrives_after_its_event(spark, folder):
    assert run(spark, folder, [[seen(3), seen(4, "x")], [applied(1, 1, arrived=5), seen(30, "x")]]) == [(1, 1, "resolvido", False)]
