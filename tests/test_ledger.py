from datetime import datetime

from pyspark.sql import functions as F

from concilia import schemas
from concilia.functions.prepare import prepare_registry
from concilia.operators import ledger
from tests.helpers import table, version

R14, R12 = "ativo_inativo_confsib_reinclusao", "inativo_cadusu_ativo_confsib"


def now():
    return F.to_timestamp(F.lit("2001-10-31 12:00:00"))


def row(id, rule=R14, cco="C1", status="aguardando", until="2001-11-30 00:00:00", base=5):
    return {
        "cadusu_id": id, "rule_id": rule, "codcco": cco, "posans_aplicado": "8-REINCLUSAO",
        "status": status, "applied_at": datetime(2001, 10, 1), "note": "n",
        "wait_until": datetime.fromisoformat(until), "baseline_numseq": base,
    }


def book(spark, *rows):
    return table(spark, schemas.LEDGER, rows)


def states(df):
    return {r.cadusu_id: r.status for r in df.collect()}


def test_resolution_needs_status_and_a_newer_version(spark):
    r = prepare_registry(table(spark, schemas.REGISTRY, [
        version(6, codcco="C1 "), version(5, codcco="C2"), version(9, codcco="C3", status="I"),
        version(1, codcco="C4"), version(None, codcco="C5"), version(7, codcco="C6", status=" a"),
    ]))
    rows = book(
        spark, row(1), row(2, cco="C2"), row(3, cco="C3"), row(4, cco="C4", base=None),
        row(5, cco="C5"), row(6, cco="C6"), row(7, cco=None), row(8, cco="C3", rule=R12),
        row(9, status="expirado"), row(10, rule="other"),
    )
    out = ledger.auto_resolve(rows, r, now())
    assert states(out) == {
        1: "resolvido", 2: "aguardando", 3: "aguardando", 4: "resolvido", 5: "aguardando",
        6: "resolvido", 7: "aguardando", 8: "resolvido", 9: "expirado", 10: "aguardando",
    }
    notes = {x.cadusu_id: x.note for x in out.collect()}
    assert notes[1] == "auto: confsib status=A numseq=6 > baseline=5"
    assert notes[4].endswith("(sem baseline)") and notes[2] == "n"


def test_expiry_is_strict(spark):
    rows = book(
        spark, row(1, until="2001-10-31 12:00:00"), row(2, until="2001-10-31 11:59:59"),
        row(3, until="2001-10-31 11:59:59", status="resolvido"),
    )
    assert states(ledger.expire(rows, now())) == {1: "aguardando", 2: "expirado", 3: "resolvido"}
    active = [r.cadusu_id for r in ledger.active_ids(rows, now()).collect()]
    assert active == [1]


def test_resolution_by_hand(spark):
    chosen = spark.createDataFrame([(1,), (2,), (3,)], "id long")
    rows = book(spark, row(1), row(2, rule=R12), row(3, status="expirado"), row(4))
    out = {r.cadusu_id: r for r in ledger.resolve(rows, chosen, R14, now()).collect()}
    assert out[1].status == "resolvido" and out[1].note == "n" and out[1].resolved_at
    assert out[2].status == "aguardando" and out[3].status == "expirado"
    assert out[4].status == "aguardando"


def test_renewal_replaces_and_keeps_one_row(spark):
    old = book(spark, row(1, status="expirado"), row(2))
    r = prepare_registry(table(spark, schemas.REGISTRY, [version(8)]))
    applied = spark.createDataFrame([(1, " C1 ", "8-REINCLUSAO"), (3, None, None)],
                                    "id long, codcco string, posans string")
    new = ledger.registrations(R14, applied, r, now())
    out = {x.cadusu_id: x for x in ledger.register(old, new).collect()}
    assert sorted(out) == [1, 2, 3]
    assert (out[1].status, out[1].baseline_numseq, out[1].codcco) == ("aguardando", 8, "C1")
    assert (out[3].posans_aplicado, out[3].baseline_numseq) == ("8-REINCLUSAO", None)
    assert ledger.registrations("other", applied, r, now()).count() == 0
    events = old.unionByName(new)
    assert {x.cadusu_id: x.status for x in ledger.current(events).collect()} == {
        1: "aguardando", 2: "aguardando", 3: "aguardando"}


def test_reading(spark):
    rows = book(spark, row(1), row(2, rule=R12), row(3, status="expirado"))
    assert [r.cadusu_id for r in ledger.listing(rows).collect()] == [1, 2]
    assert ledger.listing(rows, status=None, limit=2).count() == 2
    assert {r.rule_id: r.total for r in ledger.summary(rows).collect()} == {R12: 1, R14: 1}
    registry = table(spark, schemas.REGISTRY, [version(4)])
    mark = spark.createDataFrame([(3,)], "max_numseq long")
    assert ledger.sync_state(registry, mark).first().refreshed is True
    none = spark.createDataFrame([(None,)], "max_numseq long")
    assert ledger.sync_state(registry, none).first().refreshed is False
