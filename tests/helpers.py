"""Small tables with only the columns a test cares about."""

from __future__ import annotations

from datetime import date

from concilia import schemas
from concilia.plans.context import Reconciliation

AS_OF = "2001-10-31"
BASE_MEMBER = {
    "codtit": "0001-0001", "codusu": "00", "nomeusu": "ANA LIMA", "mae": "EVA LIMA",
    "situusu": "ATIVO", "posans": "4-ATUALIZADO", "codcco": "C1", "codans": "0001-0001-00",
    "cpfusu": "12345678901", "cns": "700", "sexousu": "F", "nascusu": date(1980, 1, 2),
    "dataini": date(2000, 3, 4),
}
BASE_VERSION = {
    "numseq": 1, "status": "A", "codcco": "C1", "codusu": "0001-0001-00",
    "nomeusu": "ANA LIMA", "cpfusu": "12345678901", "cns": "700", "sexousu": "F",
    "nascusu": "1980-01-02", "dataini": "04/03/2000", "datafim": "",
}


def table(spark, schema, rows):
    full = [tuple(row.get(f.name) for f in schema) for row in rows]
    return spark.createDataFrame(full, schema)


def member(id, **change):
    return {**BASE_MEMBER, "id": id, **change}


def version(numseq, **change):
    return {**BASE_VERSION, "numseq": numseq, **change}


def context(spark, members, registry=(), contracts=(), ledger=None):
    return Reconciliation(
        members=table(spark, schemas.MEMBERS, members),
        registry=table(spark, schemas.REGISTRY, registry),
        contracts=table(spark, schemas.CONTRACTS, contracts),
        ledger=None if ledger is None else table(spark, schemas.LEDGER, ledger),
        as_of=AS_OF,
        as_of_ts=f"{AS_OF} 12:00:00",
    )


def ids(df, name="id"):
    return sorted(row[name] for row in df.select(name).collect())


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()
