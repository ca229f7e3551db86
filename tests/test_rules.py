"""One member that breaks the rule, near misses, and NULLs, for each rule."""

from datetime import date

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from concilia import schemas
from concilia.plans import scan
from concilia.plans.catalogue import BY_ID, RULES
from concilia.plans.corrections import PLANS
from tests.helpers import BASE_MEMBER, context, ids, member, plan_of, table, version

CASES = {
    "inativo_sem_cco_nao_atualizado": [
        (dict(situusu="INATIVO", codcco=" ", posans="1-INCLUSAO"), True),
        (dict(situusu="INATIVO", codcco=None, posans="4-ATUALIZADO"), False),
        (dict(situusu="INATIVO", codcco=None, posans=None), False),
        (dict(situusu="ATIVO", codcco=None, posans="1-INCLUSAO"), False),
    ],
    "ativo_com_cco_inclusao": [
        (dict(posans="1-INCLUSAO"), True), (dict(posans="1-INCLUSAO", codcco=" "), False),
    ],
    "inativo_cco_null_exclusao": [
        (dict(situusu="INATIVO", codcco=None, posans="3-EXCLUSAO"), True),
        (dict(situusu="INATIVO", codcco="", posans="3-EXCLUSAO"), False),
    ],
    "inativo_cco_null_inclusao": [
        (dict(situusu="INATIVO", codcco=None, posans="1-INCLUSAO"), True),
        (dict(situusu="INATIVO", codcco=" ", posans="1-INCLUSAO"), False),
    ],
    "alteracao_com_cco": [
        (dict(posans="2-ALTERACAO"), True), (dict(posans="2-ALTERACAO", codcco=None), False),
    ],
    "inclusao_antiga_com_cco": [
        (dict(posans="1-INCLUSAO", dataini=date(2001, 8, 1)), True),
        (dict(posans="1-INCLUSAO", dataini=date(2001, 8, 2)), False),
        (dict(posans="1-INCLUSAO", dataini=None), False),
    ],
    "reinclusao_recente_com_cco": [
        (dict(posans="8-REINCLUSAO", dataini=date(2001, 8, 2)), True),
        (dict(posans="8-REINCLUSAO", dataini=date(2001, 8, 1)), False),
    ],
    "ativo_sem_cco_fora_inclusao": [
        (dict(codcco=None), True), (dict(codcco=None, dataini=None), True),
        (dict(codcco=None, cpfusu=" "), False), (dict(codcco=None, posans="1-INCLUSAO"), False),
        (dict(codcco=None, dataini=date(2001, 10, 1)), False),
        (dict(codcco=None, posans=None), False),
    ],
    "ativo_com_cco_exclusao": [
        (dict(posans="3-EXCLUSAO", codcco=None), True),
        (dict(posans="3-EXCLUSAO", situusu="BLOQUEADO"), False),
    ],
    "cadusu_sem_codans": [(dict(codans=" "), True), (dict(), False)],
    "inativo_com_cco_nao_excluido": [
        (dict(situusu="INATIVO", posans="2-ALTERACAO"), True),
        (dict(situusu="INATIVO", posans="3-EXCLUSAO"), False),
        (dict(situusu="INATIVO", posans=None), False),
    ],
    "exclusao_sem_datafim": [
        (dict(situusu="INATIVO", posans="3-EXCLUSAO"), True),
        (dict(situusu="INATIVO", posans="3-EXCLUSAO", datafim=date(2001, 1, 1)), False),
    ],
    "exclusao_sem_datafim_nao_inativo": [
        (dict(situusu="BLOQUEADO", posans="3-EXCLUSAO"), True),
        (dict(situusu=None, posans="3-EXCLUSAO"), False),
        (dict(situusu="BLOQUEADO", posans="3-EXCLUSAO", codcco=" "), False),
    ],
    "inclusao_sem_dataini": [
        (dict(posans="8-REINCLUSAO", dataini=None), True), (dict(dataini=None), False),
    ],
    "ativo_campos_sib_obrigatorios": [
        (dict(nomeusu=" "), True), (dict(nascusu=None), True), (dict(sexousu=""), True),
        (dict(cpfusu=None, cns=" "), True), (dict(cpfusu=None), False),
        (dict(nomeusu=" ", situusu="INATIVO"), False),
    ],
    "ativo_sem_cpf_posans": [(dict(cpfusu="  "), True), (dict(), False)],
    "cpf_invalido_ativo": [
        (dict(cpfusu="1234567890"), True), (dict(cpfusu=" 12345678901"), True),
        (dict(cpfusu="12345678901\n"), True), (dict(cpfusu=None), False), (dict(), False),
    ],
    "nome_mae_invalido": [
        (dict(nomeusu="ANA 2"), True), (dict(mae="EVA"), True), (dict(mae="EVA #"), True),
        (dict(mae=None), False), (dict(nomeusu="JOSÉ D'ÁVILA-LIMA", mae="É Ç"), False),
    ],
    "ret_reativ_com_cco": [
        (dict(posans="9-RET REATIV", situusu="BLOQUEADO"), True),
        (dict(posans="9-RET REATIV", situusu="INATIVO"), False),
    ],
    "posans_desconhecido": [
        (dict(posans="LEGADO"), True), (dict(posans=None), False), (dict(), False),
    ],
    "cadusu_ausente_confsib": [
        (dict(codcco="none"), True), (dict(codcco="none", posans="1-INCLUSAO"), False),
        (dict(codcco="none", situusu="INATIVO"), False), (dict(codcco="none", posans=None), False),
        (dict(), False),
    ],
}
WITH_REGISTRY = {
    "reinclusao_antiga_com_cco": [
        (dict(posans="8-REINCLUSAO"), [version(1)], True),
        (dict(posans="8-REINCLUSAO"), [version(1, status="I ")], False),
        (dict(posans="8-REINCLUSAO"), [version(1, status="I"), version(2)], True),
        (dict(posans="8-REINCLUSAO"), [version(1, status="I", nascusu="31/02/1980")], True),
        (dict(posans="8-REINCLUSAO"), [], True),
    ],
    "inativo_cadusu_ativo_confsib": [
        (dict(situusu="INATIVO"), [version(1)], True),
        (dict(situusu="INATIVO"), [version(1, nascusu="", cpfusu=None, nomeusu=" ")], True),
        (dict(situusu="INATIVO"), [version(1, cpfusu="9")], False),
        (dict(situusu="INATIVO"), [version(1), version(None, status="I")], False),
        (dict(situusu="INATIVO", posans="3-EXCLUSAO"), [version(1)], False),
        (dict(situusu="INATIVO"), [version(1, codcco="C1 ")], False),
    ],
    "ativo_cadusu_inativo_confsib": [
        (dict(posans="2-ALTERACAO"), [version(1, status="I", codcco="C1 ")], True),
        (dict(), [version(1, status="I")], False),
        (dict(posans="2-ALTERACAO"), [version(1, status="I", codusu="x")], False),
        (dict(posans="1-INCLUSAO", codcco=" "), [version(1, status="I"), version(2)], True),
        (dict(posans="1-INCLUSAO", codcco=None), [version(1, status="I", codcco=" ")], False),
        (dict(posans="1-INCLUSAO", codcco=None, cpfusu="123.456.789-01"),
         [version(1, status="I")], False),
    ],
    "ativo_inativo_confsib_reinclusao": [
        (dict(), [version(1, status="I", codusu="x")], True),
        (dict(), [version(1, status="I")], False),
        (dict(posans="8-REINCLUSAO"), [version(1, status="I", codusu="x")], False),
        (dict(sexousu=None), [version(1, status="I", codusu="x")], False),
    ],
    "exclusao_cco_ja_inativo_confsib": [
        (dict(posans="3-EXCLUSAO"), [version(1), version(2, status="I")], True),
        (dict(posans="3-EXCLUSAO"), [version(1, status="I"), version(2)], False),
    ],
    "cpf_inclusao_ja_ativo_confsib": [
        (dict(posans="1-INCLUSAO", codcco=None), [version(1)], True),
        (dict(posans="1-INCLUSAO", codcco=None), [version(1, dataini="05/03/2000")], False),
        (dict(posans="1-INCLUSAO", codcco=None), [version(1), version(2, nomeusu="X")], False),
        (dict(posans="1-INCLUSAO", codcco=None), [version(1), version(2, status="I")], True),
    ],
    "divergencia_nome_inativo_confsib": [
        (dict(situusu="INATIVO"), [version(1, nomeusu="OUTRA"), version(2)], True),
        (dict(situusu="INATIVO"), [version(1, nomeusu=" "), version(2, nomeusu="ana lima")], False),
    ],
    "divergencia_nome_cadusu_confsib": [
        (dict(), [version(1, nomeusu="OUTRA"), version(2)], True),
        (dict(situusu=None), [version(1, nomeusu="OUTRA")], False),
        (dict(ansnome="1", posans="10-SIB-FLEX"), [version(1, nomeusu="OUTRA")], False),
        (dict(ansnome="1", posans=None), [version(1, nomeusu="OUTRA")], False),
        (dict(ansnome="1"), [version(1, nomeusu="OUTRA")], True),
    ],
    "divergencia_nasc_cadusu_confsib": [
        (dict(), [version(1, nascusu="03/01/1980"), version(2)], True),
        (dict(), [version(1, nascusu="31/02/1980")], False),
        (dict(ansnasc="1", posans="10-SIB-FLEX"), [version(1, nascusu="03/01/1980")], False),
        (dict(), [version(1, nascusu="03/01/1980", cpfusu="2")], False),
    ],
    "reativacao_cco_ja_ativo_confsib": [
        (dict(posans="9-RET REATIV"), [version(1)], True),
        (dict(posans="8-REINCLUSAO"), [version(1, status="I")], False),
        (dict(posans="8-REINCLUSAO", codcco=" "), [version(1, codcco=" ")], False),
    ],
    "sib_flex_sem_campo_marcado": [
        (dict(posans="10-SIB-FLEX", ansrg=" ", anscns="0"), [version(1)], True),
        (dict(posans="10-SIB-FLEX", anscnpjcei="1 "), [version(1)], False),
    ],
}


@pytest.mark.parametrize("rule_id", sorted(CASES))
def test_member_rules(spark, rule_id):
    members = [member(i, **change) for i, (change, _) in enumerate(CASES[rule_id], start=1)]
    wanted = [i for i, (_, breaks) in enumerate(CASES[rule_id], start=1) if breaks]
    ctx = context(spark, members, [version(1)])
    assert ids(BY_ID[rule_id].detail(ctx)) == wanted


@pytest.mark.parametrize("rule_id", sorted(WITH_REGISTRY))
def test_registry_rules(spark, rule_id):
    for change, versions, breaks in WITH_REGISTRY[rule_id]:
        ctx = context(spark, [member(1, **change)], versions)
        assert ids(BY_ID[rule_id].detail(ctx)) == ([1] if breaks else []), (change, versions)


def test_holder_contract_name(spark):
    contracts = [{"codtit": "0001-0001", "nometit": "OUTRO"}]
    rows = [member(1), member(2, codusu="01"), member(3, ansnome="1", posans="10-SIB-FLEX")]
    ctx = context(spark, rows, [version(1)], contracts)
    listed = BY_ID["divergencia_nome_cadusu_confsib"].detail(ctx).collect()
    assert sorted(r.id for r in listed) == [1, 3]
    assert {r.situacao_nome for r in listed} == {"alinhar nometit ao nome local (titular)"}
    same = context(spark, rows, [version(1)], [{"codtit": "0001-0001", "nometit": "ana lima "}])
    assert BY_ID["divergencia_nome_cadusu_confsib"].detail(same).count() == 0


def test_orphans(spark):
    ctx = context(spark, [member(1)], [version(1), version(2, codcco="C9"),
                                       version(3, codcco="C8", status="I")])
    assert ids(BY_ID["confsib_sem_cadusu"].detail(ctx), "numseq") == [2]
    assert ids(BY_ID["confsib_sem_cadusu_inativo"].detail(ctx), "numseq") == [3]


def test_duplicates(spark):
    rows = [
        member(1), member(2, codcco="C1 "), member(3, codcco="C3", nascusu=date(1999, 1, 1)),
        member(4, codcco="C4", codtit="0002-0001"), member(5, situusu="INATIVO"),
    ]
    ctx = context(spark, rows)
    assert ids(BY_ID["cco_duplicado"].detail(ctx)) == [1, 2]
    assert BY_ID["cco_duplicado"].count(ctx).first().total == 1
    assert ids(BY_ID["cpf_duplicado_ativos"].detail(ctx)) == [1, 2, 3]
    diverging = BY_ID["cpf_duplicado_ativos_nasc_divergente"].detail(ctx)
    assert ids(diverging) == [1, 2, 3]
    assert diverging.first().nascimentos_do_cpf == "01/01/1999 | 02/01/1980"
    assert ids(BY_ID["cpf_invalido_cruzado_nascimento"].detail(ctx)) == [2, 3]


def test_every_rule_counts_what_it_lists(spark, derived):
    totals = {r.rule_id: r.total for r in scan.rule_summary(derived).collect()}
    assert len(totals) == 38
    for rule in RULES:
        listed = rule.detail(derived).count()
        if rule.id == "cco_duplicado":
            assert rule.count(derived).first().total == totals[rule.id]
        else:
            assert listed == totals[rule.id], rule.id


def test_scan_agrees_with_single_rules(spark, derived):
    rows = scan.rule_scan(derived).collect()
    for rule_id in ("cco_duplicado", "ativo_cadusu_inativo_confsib", "nome_mae_invalido"):
        wanted = ids(BY_ID[rule_id].detail(derived))
        assert sorted(r.id for r in rows if rule_id in r.rules) == wanted


def test_rules_contained_in_others(spark, derived):
    def found(rule_id):
        return set(ids(BY_ID[rule_id].detail(derived)))

    outer = found("inativo_sem_cco_nao_atualizado")
    assert found("inativo_cco_null_exclusao") <= outer
    assert found("inativo_cco_null_inclusao") <= outer
    diverging = found("cpf_duplicado_ativos_nasc_divergente")
    assert found("cpf_invalido_cruzado_nascimento") <= diverging <= found("cpf_duplicado_ativos")


def test_a_rule_that_cannot_be_planned_does_not_stop_the_others(spark):
    ctx = context(spark, [member(1, posans="LEGADO")], [version(1)])
    fewer = StructType([f for f in schemas.MEMBERS if f.name != "mae"])
    broken = ctx.with_members(table(spark, fewer, [member(1, posans="LEGADO")]))
    rows = {r.rule_id: r for r in scan.rule_summary(broken).collect()}
    assert rows["nome_mae_invalido"].total == -1 and "mae" in rows["nome_mae_invalido"].error
    assert rows["posans_desconhecido"].total == 1 and rows["posans_desconhecido"].error is None


def test_catalogue(spark):
    rows = scan.catalogue(spark).collect()
    assert sum(r.fixable for r in rows) == len(PLANS) == 29
    assert sum(r.manual_reason is not None for r in rows) == 9


def test_empty_tables_keep_their_columns(spark):
    ctx = context(spark, [])
    for rule in RULES:
        detail = rule.detail(ctx)
        assert detail.columns
    assert all(r.total == 0 for r in scan.rule_summary(ctx).collect())


def test_a_rule_that_fails_at_run_time_is_told_apart(spark):
    from dataclasses import replace

    from concilia.plans.catalogue import RULES, Part
    from concilia.plans.scan import rule_summary_apart

    ctx = context(spark, [member(1, situusu="INATIVO", posans="3-EXCLUSAO")])
    bad = replace(RULES[1], parts=(Part("members", lambda day: F.expr("raise_error('boom') is null")),))
    got = {r.rule_id: r for r in rule_summary_apart(ctx, (RULES[0], bad, RULES[19])).collect()}
    assert got[bad.id].total == -1 and "boom" in got[bad.id].error and not got[bad.id].ok
    assert got[RULES[0].id].total >= 0 and got[RULES[19].id].error is None


def test_one_bad_rule_costs_few_jobs(spark, derived, monkeypatch):
    from dataclasses import replace

    from concilia.plans.catalogue import Part

    bad = replace(RULES[7], parts=(Part("members", lambda day: F.expr("raise_error('boom') is null")),))
    rules = tuple(bad if rule.id == bad.id else rule for rule in RULES if rule.unit != "registry")
    jobs = []
    real = scan.hits
    monkeypatch.setattr(scan, "hits", lambda ctx, some, *more: jobs.append(len(some)) or real(ctx, some, *more))
    got = {r.rule_id: r.total for r in scan.rule_summary_apart(derived, rules).collect()}
    monkeypatch.undo()
    assert got.pop(bad.id) == -1 and len(jobs) <= 2 * 6 + 1
    want = {r.rule_id: r.total for r in scan.rule_summary(derived).collect()}
    assert got == {i: want[i] for i in got}


def registry_scans(df):
    """Scans of the registry's files in a plan, counting a reused exchange once."""
    return sum("FileScan" in line and "numseq" in line for line in plan_of(df).splitlines())


def test_the_registry_is_read_at_most_three_times(spark, derived):
    assert 1 <= registry_scans(scan.rule_scan(derived)) <= 3
    assert 1 <= registry_scans(scan.rule_summary(derived)) <= 3


def per_frame(ctx, counting):
    """The hits of each rule by its own frame."""
    out = set()
    for rule in RULES:
        if counting or rule.unit != "registry":
            out |= {tuple(r) for r in scan.hits(ctx, (rule,), counting).where("id is not null").select("rule_id", "id").collect()}
    return out


def test_wide_rows_hit_what_frames_hit(spark, derived):
    got = {tuple(r) for r in scan.hits(derived, RULES).where("id is not null").select("rule_id", "id").collect()}
    assert got == per_frame(derived, True)


def test_wide_rows_choose_versions_as_frames_do(spark):
    """Ties, unknown sequences, padded CCOs, several names and births, blanks and nulls."""
    import random

    rng = random.Random(6)
    some = lambda *values: rng.choice(values)
    people = []
    for i in range(150):
        people.append(member(
            i, codcco=some("C1", " C1", "C2", "C3", "", "  ", None), situusu=some("ATIVO", "INATIVO", "BLOQUEADO"),
            posans=some("1-INCLUSAO", "3-EXCLUSAO", "4-ATUALIZADO", "8-REINCLUSAO", "9-RET REATIV", None),
            codans=some("0001-0001-00", "X", "", None), cpfusu=some("12345678901", "2", " 12345678901", "", None),
            nomeusu=some("ANA LIMA", "ana lima ", "EVA", "", None), codusu=some("00", "01"),
            nascusu=some(BASE_MEMBER["nascusu"], None), dataini=some(BASE_MEMBER["dataini"], None), ansnome=some("1", "0", None),
        ))
    versions = []
    for i in range(60):
        versions.append(version(
            some(1, 2, 3, None), status=some("A", "I", "A ", None), codcco=some("C1", " C1", "C2", "C3 ", "", None),
            nomeusu=some("ANA LIMA", "EVA", "", None), cpfusu=some("12345678901", "2", "", None), codusu=some("0001-0001-00", "X", ""),
            nascusu=some("1980-01-02", "03/02/1980", "31/02/1980", ""), dataini=some("04/03/2000", "2001-01-01"), cnpj=some("1", "2", None),
        ))
    contracts = [{"codtit": "0001-0001", "nometit": some("ANA LIMA", "EVA", None)} for _ in range(3)]
    for few in (versions, versions[:9], []):
        ctx = context(spark, people, few, contracts)
        got = {tuple(r) for r in scan.hits(ctx, RULES, False).where("id is not null").select("rule_id", "id").collect()}
        assert {r for r in got if not r[0].startswith("confsib_sem")} == per_frame(ctx, False)


def test_registry_facts_are_made_in_shares(spark, folder):
    """One file with one row group, one CCO: several tasks sort its entries, with the same facts."""
    from concilia.functions.prepare import prepare_registry
    from concilia.plans import wide

    rows = [version(i, cpfusu=str(i), nomeusu=f"N{i % 7}") for i in range(3000)]
    table = context(spark, [], rows).registry
    table.repartition(1).write.parquet(f"{folder}/one")
    table.repartition(8).write.parquet(f"{folder}/eight")
    size = spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    merged = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "4k")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        for name in ("one", "eight"):
            registry = prepare_registry(spark.read.schema(table.schema).parquet(f"{folder}/{name}"))
            facts = wide.registry_facts(registry)
            hot = [r for r in facts.collect() if r.kind == wide.CCO]
            assert [(r.k1, -r.newest.older, r.low, r.high) for r in hot] == [("C1", 2999, "N0", "N6")]
            lines = [line.strip(" :+-*()0123456789") for line in plan_of(facts).split("Initial Plan")[0].splitlines()]
            first = max(i for i, line in enumerate(lines) if line.startswith("SortAggregate"))
            below = "\n".join(lines[first:])
            assert "REBALANCE_PARTITIONS_BY_COL" in below, below
        assert wide._in_shares(registry).rdd.getNumPartitions() > 4
    finally:
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", size)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", merged)
