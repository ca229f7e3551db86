"""The scan brought up to date equals the scan from scratch, and reads less."""

from dataclasses import replace

from pyspark.sql import functions as F

from concilia.plans import incremental, scan
from tests.helpers import context, member, version

c = F.col


def scanned(rows):
    return {r.id: tuple(r.rules) for r in rows.collect()}


def records_read(spark, run):
    """Input records of all stages that ``run`` starts."""
    store = spark.sparkContext._jsc.sc().statusStore()
    empty = spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0)

    def total():
        stages = store.stageList(None, False, False, empty, None)
        return sum(stages.apply(i).inputRecords() for i in range(stages.size()))

    before = total()
    out = run()
    return out, total() - before


def test_steps_give_the_scan(spark, derived):
    newest = derived.registry.agg(F.max("numseq")).first()[0]
    state = incremental.start(replace(derived, registry=derived.registry.where(c("numseq") <= newest // 2)))
    nobody = derived.members.select("id").limit(0)
    for share in (3, 4):
        now = replace(derived, registry=derived.registry.where((c("numseq") <= newest * share // 4) | c("numseq").isNull()))
        state = incremental.State.of(incremental.advance(now, state, nobody).text())
        assert scanned(incremental.rule_scan(now, state)) == scanned(scan.rule_scan(now))
    assert len(state.facts) == 3 and state.mark == newest
    small = incremental.compacted(spark, state)
    again = incremental.advance(derived, small, nobody)
    assert len(small.facts) == 1 and scanned(incremental.rule_scan(derived, again)) == scanned(scan.rule_scan(derived))


def test_changed_added_and_removed_members(spark):
    people = [member(i, codcco=f"C{i}", cpfusu=f"{i:011d}") for i in range(6)]
    versions = [version(i + 1, codcco=f"C{i}", cpfusu=f"{i:011d}") for i in range(6)]
    people[3]["posans"] = "2-ALTERACAO"
    before = context(spark, people, versions)
    people[1]["posans"], people[2]["situusu"] = "3-EXCLUSAO", "INATIVO"
    now = context(spark, people[:5] + [member(9, codcco="none")], versions + [version(20, codcco="C3", status="I", cpfusu=f"{3:011d}")])
    changed = spark.createDataFrame([(1,), (2,), (5,), (9,)], "id long")
    state = incremental.advance(now, incremental.start(before), changed)
    got = scanned(incremental.rule_scan(now, state))
    assert got == scanned(scan.rule_scan(now)) and 5 not in got and 9 in got and "ativo_cadusu_inativo_confsib" in got[3]


def test_another_day(spark):
    from datetime import date

    # On the second day the re-inclusion is older than 90 days.
    people = [member(i, posans="8-REINCLUSAO", dataini=date(2001, 7, 1 + 9 * i)) for i in range(3)]
    before = context(spark, people, [version(1, dataini="2000-01-01")])
    before, now = replace(before, as_of="2001-09-01"), replace(before, as_of="2001-10-10")
    state = incremental.advance(now, incremental.start(before), before.members.select("id").limit(0))
    assert scanned(incremental.rule_scan(now, state)) == scanned(scan.rule_scan(now)) != scanned(scan.rule_scan(before))


def test_a_changed_contract(spark):
    people = [member(1)]
    before = context(spark, people, [version(1)], [{"codtit": "0001-0001", "nometit": "ANA LIMA"}])
    now = context(spark, people, [version(1)], [{"codtit": "0001-0001", "nometit": "EVA"}])
    nobody = before.members.select("id").limit(0)
    state = incremental.advance(now, incremental.start(before), nobody, now.contracts.select("codtit"))
    got = scanned(incremental.rule_scan(now, state))
    assert got == scanned(scan.rule_scan(now)) and "divergencia_nome_cadusu_confsib" in got[1]


def test_old_versions_are_not_read_again(spark, folder):
    people = [member(i, codcco=f"C{i}") for i in range(50)]
    old = [version(i + 1, codcco=f"C{i % 50}") for i in range(4000)]
    new = [version(5000 + i, codcco=f"C{i}", status="I") for i in range(3)]
    ctx = context(spark, people, old + new)
    for number, rows in enumerate((old, new)):
        context(spark, people, rows).registry.coalesce(1).write.parquet(f"{folder}/load={number}")
    ctx = replace(ctx, registry=spark.read.parquet(folder).select(*ctx.registry.columns))
    first = replace(ctx, registry=spark.read.parquet(f"{folder}/load=0"))
    state = incremental.start(first)
    nobody = ctx.members.select("id").limit(0)
    state, read = records_read(spark, lambda: incremental.advance(ctx, state, nobody))
    got, scan_read = records_read(spark, lambda: scanned(incremental.rule_scan(ctx, state)))
    want, whole = records_read(spark, lambda: scanned(scan.rule_scan(ctx)))
    assert got == want and whole > 4000 > 4 * scan_read and read < 1500
