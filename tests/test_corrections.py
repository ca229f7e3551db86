from dataclasses import replace
from datetime import date

import pytest

from concilia.operators import changes, ledger, shaping
from concilia.plans import corrections
from concilia.plans.catalogue import BY_ID
from concilia.plans.corrections import PLANS, PLAN_BY_RULE
from tests.helpers import context, ids, member, version

# Rules that list members again after their correction, by design.
STAYS = {
    "ativo_sem_cpf_posans",              # the rule does not look at the movement
    "cpf_invalido_ativo",                # only CPFs with eleven digits are corrected
    "inativo_cadusu_ativo_confsib",      # only members with an end date are corrected
    "ativo_campos_sib_obrigatorios",     # only gaps the registry can fill
    "sib_flex_sem_campo_marcado",        # only where a field differs
    "divergencia_nome_inativo_confsib",  # older versions may still have another name
}
LISTS_CORRECTED = {"ativo_sem_cpf_posans", "divergencia_nome_inativo_confsib"}


def select_all(ctx):
    return ctx.members.select("id")


@pytest.mark.parametrize("rule_id", sorted(PLAN_BY_RULE))
def test_preview_is_part_of_the_rule_and_clears_it(spark, derived, rule_id):
    plan = PLAN_BY_RULE[rule_id]
    listed = set(ids(BY_ID[rule_id].detail(derived)))
    previewed = ids(plan.preview(derived))
    assert len(previewed) == len(set(previewed)) and set(previewed) <= listed
    everyone = corrections.apply_fix(derived, rule_id, select_all(derived), confirm=True)
    assert ids(everyone.updated) == previewed
    after = derived.with_members(everyone.members)
    if plan.contract:
        after = replace(after, contracts=everyone.contracts)
    again = set(ids(BY_ID[rule_id].detail(after)))
    assert again == (listed - set(previewed) if rule_id not in STAYS else again & listed)
    if rule_id not in LISTS_CORRECTED:
        assert not again & set(previewed)
    assert everyone.members.count() == derived.members.count()
    assert everyone.members.columns == derived.members.columns


@pytest.mark.parametrize("rule_id", ["inativo_sem_cco_nao_atualizado", "cpf_invalido_ativo",
                                     "reativacao_cco_ja_ativo_confsib"])
def test_both_ways_of_applying_agree(spark, derived, rule_id):
    joined = corrections.apply_fix(derived, rule_id, select_all(derived), confirm=True).members
    direct = corrections.apply_everywhere(derived, rule_id)
    assert joined.exceptAll(direct).count() == direct.exceptAll(joined).count() == 0


def test_guard_selection_and_null(spark):
    rows = [
        member(1, posans="8-REINCLUSAO", situusu="INATIVO", datafim=date(2001, 1, 1)),
        member(2, posans="8-REINCLUSAO", datafim=date(2001, 1, 1)),
        member(3),
    ]
    ctx = context(spark, rows, [version(1)])
    chosen = spark.createDataFrame([(1,), (3,), (99,)], "id long")
    done = corrections.apply_fix(ctx, "reativacao_cco_ja_ativo_confsib", chosen, confirm=True)
    after = {r.id: r for r in done.members.collect()}
    assert (after[1].situusu, after[1].posans, after[1].datafim) == ("ATIVO", "4-ATUALIZADO", None)
    assert after[1].dataultalt == date(2001, 10, 31) and after[1].dtope is not None
    assert after[2].posans == "8-REINCLUSAO" and after[2].datafim == date(2001, 1, 1)
    assert after[3].dataultalt is None
    assert changes.apply_counts(chosen, done.updated).first().asDict() == {
        "requested": 3, "updated": 1}


def test_refusals(spark, derived):
    with pytest.raises(ValueError):
        corrections.apply_fix(derived, "ativo_com_cco_exclusao", select_all(derived))
    with pytest.raises(ValueError):
        corrections.plan_for("cco_duplicado")
    with pytest.raises(ValueError):
        corrections.plan_for("no such rule")


def test_left_over_end_date(spark):
    rows = [member(i, posans="8-REINCLUSAO", datafim=date(2001, 1, 1), codcco=f"C{i}")
            for i in (1, 2)]
    ctx = context(spark, rows, [version(1), version(2, codcco="C2", cpfusu="1")])
    shown = {r.id: r for r in PLAN_BY_RULE["reinclusao_antiga_com_cco"].preview(ctx).collect()}
    assert shown[1].datafim_novo is None and shown[2].datafim_novo == date(2001, 1, 1)


def test_code_sources(spark):
    rows = [
        member(1, codans=None, situusu="INATIVO"), member(2, codans=" "),
        member(3, codans=None, codtit=" "), member(4, codans="x"),
    ]
    ctx = context(spark, rows, [version(1, codusu=" R" + "1" * 40), version(0, codusu="old")])
    shown = {r.id: (r.codans_novo, r.origem)
             for r in PLAN_BY_RULE["cadusu_sem_codans"].preview(ctx).collect()}
    assert shown == {1: ("R" + "1" * 29, "confsib"), 2: ("0001-0001-00", "montado")}


def test_completion_from_the_registry(spark):
    rows = [
        member(1, sexousu=None), member(2, sexousu=None, codcco=" ", codusu="02"),
        member(3, cpfusu=" ", cns=None),
    ]
    registry = [version(1), version(2, cpfusu="", cns="9", sexousu="M")]
    ctx = context(spark, rows, registry)
    shown = {r.id: r for r in PLAN_BY_RULE["ativo_campos_sib_obrigatorios"].preview(ctx).collect()}
    assert (shown[1].sexo_novo, shown[1].posans_novo) == ("F", "4-ATUALIZADO")
    assert (shown[2].codcco_novo, shown[2].posans_novo) == ("C1", "4-ATUALIZADO")
    assert (shown[3].cns_novo, shown[3].posans_novo) == ("9", "4-ATUALIZADO")


def test_long_form_matches_the_preview(spark, derived):
    rule_id = "ativo_campos_sib_obrigatorios"
    long = corrections.change_set(derived, rule_id).collect()
    pairs = shaping.paired_changes(PLAN_BY_RULE[rule_id].preview(derived)).count()
    assert len(long) == pairs > 0


def test_change_sets_are_what_applying_changes(spark, derived):
    """Per plan: the long form equals the difference that ``apply_fix`` makes."""
    everything = corrections.change_set(derived).collect()
    found = {(r.rule_id, r.table_name, r.key, r.field): (r.old_value, r.new_value) for r in everything}
    assert len(found) == len({(*r[:4], r.old_value) for r in everything})
    text = lambda v: None if v is None else str(v)
    before = {r.id: r for r in derived.members.collect()}
    for plan in PLANS:
        done = corrections.apply_fix(derived, plan.rule_id, select_all(derived), confirm=True)
        want = {}
        for row in done.members.collect():
            for field in plan.assign:
                if row[field] != before[row.id][field]:
                    want[plan.rule_id, "cadusu", str(row.id), field] = (
                        text(before[row.id][field]), text(row[field]))
        if plan.contract:
            # A contract code may have several rows: those with the new stamp have changed.
            stamped = done.contracts.filter(done.contracts.dtope == derived.moment).collect()
            taken = {(k[2], v[1]) for k, v in found.items() if k[1] == "cadcont"}
            assert {(r.codtit, r.nometit) for r in stamped} == taken
            want |= {k: v for k, v in found.items() if k[1] == "cadcont"}
        assert {k: v for k, v in found.items() if k[0] == plan.rule_id} == want, plan.rule_id
    assert any(k[1] == "cadcont" for k in found)


def test_results_agree_after_the_inputs_change(spark, folder):
    """Eligibility is decided once; replacing the tables afterwards changes nothing."""
    from concilia.sources.tables import read_tables

    rule_id = "ativo_inativo_confsib_reinclusao"
    ctx = context(spark, [member(1), member(2, codcco="C2")],
                  [version(1, status="I", codusu="x"), version(2, codcco="C2")], [], [])
    for name, df in (("cadusu", ctx.members), ("confsib", ctx.registry),
                     ("cadcont", ctx.contracts), ("pending", ctx.ledger)):
        df.write.parquet(f"{folder}/{name}")
    stored = read_tables(spark, folder, ctx.as_of, ctx.as_of_ts)
    done = corrections.apply_fix(stored, rule_id, select_all(stored), confirm=True, path=f"{folder}/done")
    stored.registry.limit(0).write.mode("append").parquet(f"{folder}/empty")
    emptied = replace(stored, registry=spark.read.parquet(f"{folder}/empty"))
    assert ids(BY_ID[rule_id].detail(emptied)) == []
    assert ids(done.updated) == [1] == [r.cadusu_id for r in done.ledger_rows.collect()]
    assert ids(done.members.filter("posans = '8-REINCLUSAO'")) == [1]
    assert done.ledger_rows.first().baseline_numseq == 1
    again = corrections.apply_fix(emptied, rule_id, select_all(emptied), confirm=True)
    assert again.updated.count() == again.ledger_rows.count() == 0


def test_an_unchanged_title_is_no_change(spark):
    rows = [member(1, nomeusu="NEW NAME"), member(2, codusu="01", nomeusu="OTHER", codtit="t")]
    ctx = context(spark, rows, [version(1)], [{"codtit": "t", "nometit": "KEPT"}])
    changed = corrections.change_set(ctx, "divergencia_nome_cadusu_confsib").collect()
    assert changed and all(r.table_name == "cadusu" for r in changed)
    shown = shaping.paired_changes(
        PLAN_BY_RULE["divergencia_nome_cadusu_confsib"].preview(ctx)).collect()
    assert shown and all(r.field != "nometit" for r in shown)


def test_fourteen_waits_and_comes_back(spark):
    """Applying, waiting, expiring: the cycle of a correction the registry must confirm."""
    rule_id = "ativo_inativo_confsib_reinclusao"
    rows, registry = [member(1)], [version(1, status="I", codusu="x")]
    ctx = context(spark, rows, registry, ledger=[])
    assert ids(BY_ID[rule_id].detail(ctx)) == [1]
    done = corrections.apply_fix(ctx, rule_id, select_all(ctx), confirm=True)
    book = ledger.register(ctx.ledger, done.ledger_rows)
    kept = book.first()
    assert (kept.status, kept.baseline_numseq, kept.posans_aplicado) == (
        "aguardando", 1, "8-REINCLUSAO")
    assert (kept.wait_until - kept.applied_at).days == 45
    waiting = replace(ctx, ledger=book)          # the member is still unchanged
    assert ids(BY_ID[rule_id].detail(waiting)) == []
    later = replace(waiting, as_of_ts="2001-12-20 12:00:00")
    assert ids(BY_ID[rule_id].detail(later)) == [1]


def test_all_plans_have_a_rule(spark):
    assert len(PLANS) == 29 and {p.rule_id for p in PLANS} <= set(BY_ID)


def test_origins_and_pages(spark, derived):
    df = shaping.with_origins(BY_ID["inativo_cadusu_ativo_confsib"].detail(derived))
    origin = {f.name: f.metadata["origin"] for f in df.schema}
    assert origin["nome_ans"] == "registry" and origin["id"] == "member"
    assert origin["chave_usada"] == "meta"
    listing = shaping.with_origins(BY_ID["confsib_sem_cadusu"].detail(derived))
    assert {f.metadata["origin"] for f in listing.schema} == {"registry"}
    rows = shaping.ordered_detail(BY_ID["inativo_sem_cco_nao_atualizado"], derived)
    starts = [r.dataini for r in shaping.page(rows, 5).collect()]
    assert starts == sorted(starts, reverse=True)
    facts = shaping.page_facts(rows, 5).first()
    assert (facts.returned, facts.truncated) == (5, True)
