"""The 29 correction plans, and the engine that turns them into changes.

A plan takes the rows of its rule (the same condition is the guard when a correction is
applied) and says what each field becomes. Everything is lazy: a preview, a change set,
the corrected snapshot and the ledger rows all derive from the same rows.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from concilia import vocabulary as v
from concilia.functions.predicates import (
    any_of, exact_same_record, field_differences, missing_mandatory, registry_can_fill, some_difference,
)
from concilia.functions.text import (
    compose_code, cut, digits_only, is_blank, is_present, nullif_blank,
)
from concilia.operators import ledger
from concilia.operators.changes import apply_wide, select_ids
from concilia.plans.catalogue import (
    BY_ID, Part, c, flex_without_flag, has_cco, inactive, movement, remote, sent_name,
)
from concilia.plans.context import Reconciliation, without_waiting
from concilia.session import shared_folder

Value = Callable[[Column], Column]

MEMBER_TABLE, CONTRACT_TABLE = "cadusu", "cadcont"


@dataclass(frozen=True)
class FixPlan:
    rule_id: str
    label: str
    summary: str
    assign: dict[str, Value]
    keys: tuple
    parts: tuple[Part, ...] | None = None
    only: Callable[[], Column] | None = None
    shown: dict[str, str] | None = None
    after: Callable[[], list] | None = None
    contract: dict[str, Value] | None = None

    @property
    def fields(self) -> tuple[str, ...]:
        return (*self.assign, *(self.contract or {}))

    def eligible(self, ctx: Reconciliation, selection: DataFrame | None = None) -> DataFrame:
        """Rows the plan would change now: the rule's condition, then the plan's own."""
        rows = BY_ID[self.rule_id].rows(ctx, self.parts)
        if self.only is not None:
            rows = rows.filter(self.only())
        return select_ids(rows, selection)

    def preview(self, ctx: Reconciliation, selection: DataFrame | None = None) -> DataFrame:
        """Keys, then ``field_atual`` and ``field_novo`` of every field, then context."""
        names = self.shown or {}
        columns: list = [k() if callable(k) else k for k in self.keys]
        for field, value in self.assign.items():
            name = names.get(field, field)
            columns += [c(field).alias(f"{name}_atual"), value(ctx.day).alias(f"{name}_novo")]
        for field, value in (self.contract or {}).items():
            columns += [c(field).alias(f"{field}_atual"), value(ctx.day).alias(f"{field}_novo")]
        return self.eligible(ctx, selection).select(
            *columns, *(self.after() if self.after else [])
        )

    def changes(self, ctx: Reconciliation, selection: DataFrame | None = None) -> DataFrame:
        """Wide change rows: ``id`` and ``new_field`` for every member field."""
        return self.eligible(ctx, selection).select(
            "id", *[value(ctx.day).alias(f"new_{f}") for f, value in self.assign.items()]
        )


def to(value: str) -> Value:
    return lambda day: F.lit(value)


def nothing(kind: str) -> Value:
    return lambda day: F.lit(None).cast(kind)


_KEYS = ("id", "codtit", "codusu", "nomeusu", "situusu", "codcco")


def _settle(rule_id: str, *more: str, keys: tuple = _KEYS, **rest) -> FixPlan:
    return FixPlan(
        rule_id, "Settle the movement", "The movement becomes 4-ATUALIZADO.",
        {"posans": to(v.UPDATED)}, (*keys, *more), **rest,
    )


def _fill(name: str) -> Value:
    """The local value, or the registry's where it is missing."""
    return lambda day: F.when(is_blank(name), nullif_blank(f"r_{name}")).otherwise(c(name))


def _filled(name: str) -> Column:
    return is_present(name) | is_present(f"r_{name}")


def _completed_movement(day: Column) -> Column:
    complete = (
        _filled("nomeusu")
        & F.coalesce("nascusu", "r_birth").isNotNull()
        & _filled("sexousu")
        & (_filled("cpfusu") | _filled("cns"))
    )
    sent = F.when(_filled("codcco"), F.lit(v.UPDATED)).otherwise(F.lit(v.INCLUSION))
    return F.when(complete, sent).otherwise(c("posans"))


def _linked_cco(day: Column) -> Column:
    new_inclusion = movement(v.INCLUSION) & is_blank("codcco")
    return F.when(new_inclusion, F.col("r_cco")).otherwise(c("codcco"))


def _registry_code() -> Column:
    return cut("r_codusu", 30)


def _code(day: Column) -> Column:
    return F.coalesce(_registry_code(), compose_code("codtit", "codusu"))


def _code_source() -> Column:
    return (
        F.when(_registry_code().isNotNull(), F.lit(v.CODE_FROM_REGISTRY))
        .when(compose_code("codtit", "codusu").isNotNull(), F.lit(v.CODE_COMPOSED))
        .alias("origem")
    )


def _flag(name: str) -> Value:
    return lambda day: F.when(F.expr(field_differences()[name]), F.lit("1")).otherwise(c(name))


PLANS: tuple[FixPlan, ...] = (
    _settle("inativo_sem_cco_nao_atualizado"),
    _settle("ativo_com_cco_inclusao"),
    _settle("inativo_cco_null_exclusao"),
    _settle("inativo_cco_null_inclusao"),
    _settle("alteracao_com_cco"),
    FixPlan(
        "reinclusao_antiga_com_cco", "Settle the movement",
        "The movement becomes 4-ATUALIZADO; a left-over end date of the same record is cleared.",
        {
            "posans": to(v.UPDATED),
            "datafim": lambda day: F.when(
                c("datafim").isNotNull() & exact_same_record(), F.lit(None).cast("date")
            ).otherwise(c("datafim")),
        },
        (*_KEYS, "dataini"),
        after=lambda: [
            c("r_status").alias("status_ans"), c("r_nomeusu").alias("nome_ans"),
            c("r_dataini").alias("dataini_ans"), c("r_datafim").alias("datafim_ans"),
        ],
    ),
    _settle("inclusao_antiga_com_cco", "dataini"),
    _settle("reinclusao_recente_com_cco", "dataini"),
    FixPlan(
        "ativo_sem_cco_fora_inclusao", "Mark for inclusion", "The movement becomes 1-INCLUSAO.",
        {"posans": to(v.INCLUSION)},
        ("id", "codtit", "codusu", "nomeusu", "situusu", "cpfusu", "codcco", "dataini"),
    ),
    _settle("ativo_com_cco_exclusao", "datafim"),
    FixPlan(
        "inativo_com_cco_nao_excluido", "Exclude or settle",
        "4-ATUALIZADO if the registry already shows it inactive, otherwise 3-EXCLUSAO.",
        {"posans": lambda day: F.when(
            remote(v.REG_INACTIVE), F.lit(v.UPDATED)).otherwise(F.lit(v.EXCLUSION))},
        (*_KEYS, "datafim"),
        parts=(Part("by_cco", lambda day: inactive() & has_cco()
                    & ~movement(v.EXCLUSION, v.UPDATED)),),
        after=lambda: [c("r_status").alias("status_ans")],
    ),
    _settle("exclusao_cco_ja_inativo_confsib", "datafim",
            after=lambda: [c("r_status").alias("status_ans")]),
    FixPlan(
        "cpf_inclusao_ja_ativo_confsib", "Link the registry's CCO",
        "Takes the CCO of the same person; the movement becomes 4-ATUALIZADO.",
        {"codcco": lambda day: c("r_cco"), "posans": to(v.UPDATED)},
        ("id", "codtit", "codusu", "nomeusu", "situusu", "cpfusu", "dataini",
         lambda: c("r_start").alias("dataini_ans")),
        after=lambda: [c("r_codusu").alias("codusu_conflito")],
    ),
    _settle("exclusao_sem_datafim_nao_inativo", "datafim"),
    FixPlan(
        "inclusao_sem_dataini", "Fill the start date",
        "The start becomes the registration date, or today.",
        {"dataini": lambda day: F.coalesce(c("datacad"), day)},
        ("id", "codtit", "codusu", "nomeusu", "situusu", "posans", "datacad"),
    ),
    FixPlan(
        "cpf_invalido_ativo", "Strip the CPF mask", "Only where eleven digits remain.",
        {"cpfusu": lambda day: digits_only("cpfusu")},
        ("id", "codtit", "codusu", "nomeusu", "situusu"),
        only=lambda: F.length("m_digits") == 11,
    ),
    FixPlan(
        "divergencia_nome_cadusu_confsib", "Send the local name",
        "Marks the name for sending; a holder's contract takes the local name.",
        {"ansnome": to("1"), "posans": to(v.FLEX)},
        ("id", "codtit", "codusu", "codcco", "situusu",
         lambda: c("nomeusu").alias("nomeusu_mantido"),
         lambda: sent_name().getField("r_nomeusu").alias("nome_ans_ignorado")),
        contract={"nometit": lambda day: F.when(c("holder_differs"), cut("nomeusu", 80))},
    ),
    FixPlan(
        "divergencia_nome_inativo_confsib", "Take the registry's name",
        "The local name becomes the newest differing registry name, cut to 80.",
        {"nomeusu": lambda day: cut("differing_name.r_nomeusu", 80)},
        ("id", "codtit", "codusu", "codcco", "situusu", "posans"),
        after=lambda: [c("differing_name.r_nomeusu").alias("nome_ans")],
    ),
    FixPlan(
        "divergencia_nasc_cadusu_confsib", "Send the local birth", "Marks the birth for sending.",
        {"posans": to(v.FLEX), "ansnasc": to("1")},
        ("id", "codtit", "codusu", "codcco", "situusu", "nomeusu", "cpfusu", "dataini",
         lambda: c("nascusu").alias("nasc_local"),
         lambda: c("other_birth.r_birth").alias("nasc_ans")),
    ),
    FixPlan(
        "cpf_invalido_cruzado_nascimento", "Clear the CPF",
        "The keeper of the group keeps the CPF.",
        {"cpfusu": nothing("string")},
        ("id", "empresa", "codtit", "codusu", "nomeusu", "codcco", "posans", "dataini",
         "nascusu"),
        after=lambda: [
            c("keeper.id_mantido").alias("id_mantido"),
            c("keeper.nome_mantido").alias("nome_mantido"),
            c("keeper.nasc_mantido").alias("nasc_mantido"),
        ],
    ),
    FixPlan(
        "cadusu_sem_codans", "Fill the registry code",
        "The registry's code for the same CCO, CPF and start, or contract and number.",
        {"codans": _code},
        ("id", "codtit", "codusu", "nomeusu", "situusu", "posans", "codcco", "cpfusu",
         "dataini"),
        parts=(Part("codes", lambda day: is_blank("codans")),),
        only=lambda: F.trim(_code(None)) != "",
        after=lambda: [_code_source()],
    ),
    _settle("ativo_sem_cpf_posans",
            keys=("id", "codtit", "codusu", "nomeusu", "situusu", "cpfusu", "codcco")),
    _settle("ret_reativ_com_cco"),
    FixPlan(
        "reativacao_cco_ja_ativo_confsib", "Align with the registry",
        "Active, settled, end date cleared.",
        {"situusu": to(v.ACTIVE), "posans": to(v.UPDATED), "datafim": nothing("date")},
        ("id", "codtit", "codusu", "nomeusu", "codcco"),
        after=lambda: [c("r_status").alias("status_ans")],
    ),
    FixPlan(
        "sib_flex_sem_campo_marcado", "Mark the differing fields",
        "Every flag whose field differs from the registry becomes 1.",
        {name: _flag(name) for name in v.FLAGS if name not in ("anstitular", "anscnpjcei")},
        _KEYS,
        parts=(Part("by_cco_full", flex_without_flag,
                    lambda day: c("r_codcco").isNotNull() & some_difference()),),
    ),
    FixPlan(
        "ativo_campos_sib_obrigatorios", "Complete from the registry",
        "Fills gaps from the same person; complete members are settled or included.",
        {
            "nomeusu": _fill("nomeusu"),
            "nascusu": lambda day: F.coalesce("nascusu", "r_birth"),
            "sexousu": _fill("sexousu"),
            "cpfusu": _fill("cpfusu"),
            "cns": _fill("cns"),
            "codcco": _fill("codcco"),
            "posans": _completed_movement,
        },
        ("id", "codtit", "codusu", "situusu"),
        parts=(Part("identity", lambda day: missing_mandatory(),
                    lambda day: registry_can_fill()),),
        shown={"nomeusu": "nome", "nascusu": "nasc", "sexousu": "sexo", "cpfusu": "cpf"},
        after=lambda: ["dataini", c("r_dataini").alias("dataini_ans")],
    ),
    FixPlan(
        "ativo_inativo_confsib_reinclusao", "Mark for re-inclusion",
        "The movement becomes 8-REINCLUSAO and waits for the registry.",
        {"posans": to(v.REINCLUSION)},
        (*_KEYS, "cpfusu", "cns", "sexousu", "nascusu", "dataini"),
        after=lambda: [F.lit(v.TODO_REINCLUSION).alias("situacao_correcao")],
    ),
    FixPlan(
        "inativo_cadusu_ativo_confsib", "Mark for exclusion",
        "With an end date, the movement becomes 3-EXCLUSAO and waits for the registry.",
        {"posans": to(v.EXCLUSION)},
        (*_KEYS, "datafim"),
        only=lambda: c("datafim").isNotNull(),
    ),
    FixPlan(
        "ativo_cadusu_inativo_confsib", "Settle with the registry",
        "The movement becomes 4-ATUALIZADO; a missing CCO is taken from the registry.",
        {"codcco": _linked_cco, "posans": to(v.UPDATED)},
        ("id", "codtit", "codusu", "codans", "nomeusu", "situusu", "cpfusu", "nascusu",
         "dataini", lambda: c("r_start").alias("dataini_ans"),
         lambda: c("r_codusu").alias("codusu_ans")),
        after=lambda: [
            F.when(has_cco(), F.lit(v.REASON_FULL))
            .otherwise(F.lit(v.REASON_FULL_LINK)).alias("motivo"),
        ],
    ),
)

PLAN_BY_RULE = {plan.rule_id: plan for plan in PLANS}

MANUAL_REASONS = {
    "exclusao_sem_datafim": "Enter the end date by hand.",
    "cadusu_ausente_confsib": "Decide whether to send the member or wait for the next return.",
    "confsib_sem_cadusu": "There is no member to change: register it or discard the return.",
    "confsib_sem_cadusu_inativo": "Mostly old exclusions: register the history or ignore.",
    "cco_duplicado": "Decide which member keeps the number.",
    "posans_desconhecido": "Map the code first.",
    "cpf_duplicado_ativos": "Decide which member keeps the CPF.",
    "cpf_duplicado_ativos_nasc_divergente": "Use the rule on CPFs that do not fit the birth.",
    "nome_mae_invalido": "Correct the names by hand.",
}
TIPS = {
    "divergencia_nome_cadusu_confsib": "The local name was checked by a person: it stands.",
    "ativo_inativo_confsib_reinclusao": "Waits about 45 days for the registry to turn active.",
    "inativo_cadusu_ativo_confsib": "Waits about 45 days for the registry to turn inactive.",
}
BADGES = {"divergencia_nome_cadusu_confsib": "Send the local name"}


def metadata(rule_id: str) -> dict:
    """What a catalogue shows about correcting a rule."""
    plan = PLAN_BY_RULE.get(rule_id)
    if plan is None:
        return {
            "fixable": False, "fix_label": None, "fix_summary": None, "fix_fields": "",
            "fix_tip": TIPS.get(rule_id), "badge": BADGES.get(rule_id),
            "manual_reason": MANUAL_REASONS[rule_id],
        }
    return {
        "fixable": True, "fix_label": plan.label, "fix_summary": plan.summary,
        "fix_fields": ",".join(plan.fields), "fix_tip": TIPS.get(rule_id, plan.summary),
        "badge": BADGES.get(rule_id), "manual_reason": None,
    }


def plan_for(rule_id: str) -> FixPlan:
    plan = PLAN_BY_RULE.get(rule_id)
    if plan is None:
        raise ValueError(MANUAL_REASONS.get(rule_id, f"no rule {rule_id!r}"))
    return plan


@dataclass(frozen=True)
class Applied:
    """Results of applying one plan; all from the change rows written in ``path``."""

    members: DataFrame
    contracts: DataFrame
    updated: DataFrame
    ledger_rows: DataFrame | None
    path: str


def apply_fix(
    ctx: Reconciliation,
    rule_id: str,
    selection: DataFrame,
    confirm: bool = False,
    path: str | None = None,
) -> Applied:
    """Corrected members (and contracts) for the selected ids that still qualify.

    ``selection`` has a column ``id`` and may be of any size. Ids that stopped qualifying
    are left as they are. Eligibility is decided once: the change rows and the ledger rows
    are written to ``path`` (a new folder; by default below the shared one) and everything
    is derived from them, so the results cannot disagree, also once the tables are replaced.
    """
    if not confirm:
        raise ValueError("applying a correction needs confirm=True")
    plan, spark = plan_for(rule_id), ctx.members.sparkSession
    path = path or f"{shared_folder(spark)}/applied-{uuid.uuid4().hex}"
    shown = ["codtit", "codusu", "nomeusu", "situusu", "codcco", "posans"]
    shown += [f for f in plan.assign if f not in shown]
    title = plan.contract["nometit"](ctx.day) if plan.contract else F.lit(None)
    rows = plan.eligible(ctx, selection).select(
        "id", *shown, *[value(ctx.day).alias(f"new_{f}") for f, value in plan.assign.items()],
        title.cast("string").alias("title"),
    )
    rows.write.parquet(f"{path}/changes")
    rows = spark.read.parquet(f"{path}/changes")
    changes = rows.select("id", *[f"new_{f}" for f in plan.assign])
    members = apply_wide(ctx.members, changes, ctx.day, ctx.moment)
    contracts = _apply_to_contracts(ctx, rows) if plan.contract else ctx.contracts
    updated = rows.select(
        "id", *[c(f"new_{f}" if f in plan.assign else f).alias(f) for f in shown]
    )
    waiting = None
    if rule_id in ledger.AWAITED:
        ledger.registrations(rule_id, updated, ctx.r, ctx.moment).write.parquet(f"{path}/ledger")
        waiting = spark.read.parquet(f"{path}/ledger")
    return Applied(members, contracts, updated, waiting, path)


def _contract_names(titles: DataFrame) -> DataFrame:
    """``codtit, new_name`` from ``codtit, title``: the corrected holder's name, where there is one."""
    named = titles.filter("title is not null")
    return named.groupBy("codtit").agg(F.min("title").alias("new_name"))


def _takes_new_name() -> Column:
    return F.col("new_name").isNotNull() & (
        F.upper(F.trim(F.coalesce("nometit", F.lit("")))) != F.upper("new_name")
    )


def _apply_to_contracts(ctx: Reconciliation, rows: DataFrame) -> DataFrame:
    """Contracts whose holder's corrected name differs take that name."""
    differs = _takes_new_name()
    return (
        ctx.contracts.join(_contract_names(rows), "codtit", "left")
        .withColumns({
            "nometit": F.when(differs, c("new_name")).otherwise(c("nometit")),
            "dtope": F.when(differs, ctx.moment).otherwise(c("dtope")),
        })
        .select(*ctx.contracts.columns)
    )


def apply_everywhere(ctx: Reconciliation, rule_id: str) -> DataFrame:
    """Corrected members with every eligible row changed.

    Plans that look at the member alone need neither join nor shuffle: the guard and the
    new values are evaluated in the scan itself.
    """
    plan = plan_for(rule_id)
    parts = plan.parts or BY_ID[rule_id].parts
    if any(part.frame != "members" for part in parts):
        return apply_wide(ctx.members, plan.changes(ctx), ctx.day, ctx.moment)
    guard = F.lit(False)
    for part in parts:
        guard = guard | (part.given(ctx.day) & part.when(ctx.day))
    if plan.only is not None:
        guard = guard & plan.only()
    guard = F.coalesce(guard, F.lit(False))
    new = {
        **{f: F.when(guard, value(ctx.day)).otherwise(c(f)) for f, value in plan.assign.items()},
        "dataultalt": F.when(guard, ctx.day).otherwise(c("dataultalt")),
        "dtope": F.when(guard, ctx.moment).otherwise(c("dtope")),
    }
    return ctx.m.withColumns(new).select(*ctx.members.columns)


def change_set(
    ctx: Reconciliation,
    rule_ids: str | Iterable[str] | None = None,
    selection: DataFrame | None = None,
) -> DataFrame:
    """Long form ``(rule_id, table_name, key, field, old_value, new_value, as_of)`` of all that
    applying the plans would change; values as text. All plans by default.

    Member rows have the member's id as ``key``, contract rows the contract's code. Plans
    are grouped by frame, as the scan groups rules: each frame is computed once, and every
    row emits the changes of all plans it qualifies for.
    """
    wanted = {rule_ids} if isinstance(rule_ids, str) else rule_ids and set(rule_ids)
    plans = [p for p in PLANS if wanted is None or p.rule_id in wanted]
    frames: dict[str, list[tuple[FixPlan, Part]]] = {}
    for plan in plans:
        for part in plan.parts or BY_ID[plan.rule_id].parts:
            frames.setdefault(part.frame, []).append((plan, part))
    found = [_frame_changes(ctx, frame, pairs, selection) for frame, pairs in frames.items()]
    found += [_contract_changes(ctx, plan, selection) for plan in plans if plan.contract]
    return reduce(DataFrame.unionByName, found).withColumn("as_of", ctx.day)


def _frame_changes(
    ctx: Reconciliation,
    frame: str,
    pairs: list[tuple[FixPlan, Part]],
    selection: DataFrame | None,
) -> DataFrame:
    given = [part.given(ctx.day) for _, part in pairs]
    rows = select_ids(ctx.frame(frame, any_of(given)), selection)
    emitted = []
    for test, (plan, part) in zip(given, pairs):
        test = test & part.when(ctx.day) & (plan.only() if plan.only else F.lit(True))
        for field, value in plan.assign.items():
            old, new = c(field).cast("string"), value(ctx.day).cast("string")
            emitted.append(F.when(test & ~old.eqNullSafe(new), F.struct(
                F.lit(plan.rule_id).alias("rule_id"), F.lit(field).alias("field"),
                old.alias("old_value"), new.alias("new_value"),
            )))
    changed = rows.select("id", F.explode(F.array_compact(F.array(*emitted))).alias("e"))
    changed = changed.select("id", "e.*")
    if ctx.ledger is not None and any(BY_ID[p.rule_id].awaits_registry for p, _ in pairs):
        changed = without_waiting(ctx, changed)
    return changed.select(
        "rule_id", F.lit(MEMBER_TABLE).alias("table_name"), c("id").cast("string").alias("key"),
        "field", "old_value", "new_value",
    )


def _contract_changes(
    ctx: Reconciliation, plan: FixPlan, selection: DataFrame | None
) -> DataFrame:
    """What applying the plan does to contracts: one row per contract whose name changes."""
    titles = plan.eligible(ctx, selection).select(
        "codtit", plan.contract["nometit"](ctx.day).alias("title")
    )
    new = _contract_names(titles)
    return ctx.contracts.join(new, "codtit").filter(_takes_new_name()).select(
        F.lit(plan.rule_id).alias("rule_id"), F.lit(CONTRACT_TABLE).alias("table_name"),
        c("codtit").alias("key"), F.lit("nometit").alias("field"),
        c("nometit").alias("old_value"), c("new_name").alias("new_value"),
    ).distinct()
