"""The 38 rules. Each is a condition over a frame; every matching row is an inconsistency.

``given`` looks at the member alone and is applied before any join; ``when`` looks at the
joined row. Both are built for a given clock, so the same rule serves listing, counting
and corrections.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from concilia.functions.dates import deadline_passed, older_than_days
from concilia.functions.predicates import (
    compatible_keys, exact_same_record, full_identity, is_holder, mandatory_present,
    missing_mandatory, not_inactive, prepared_for_flex, same_start, some_difference,
    some_flag_marked,
)
from concilia.functions.text import (
    has_digit, has_illegal_character, is_blank, is_cpf, is_present, same_name, word_count,
)
from concilia.operators.groups import differing
from concilia.plans.context import Reconciliation
from concilia import vocabulary as v

c = F.col
Test = Callable[[Column], Column]
Shape = Callable[[], list]


def always(day: Column) -> Column:
    return F.lit(True)


@dataclass(frozen=True)
class Part:
    """Rows of one frame that break the rule. Parts of one rule never share a row."""

    frame: str
    given: Test
    when: Test = always
    labels: tuple[tuple[str, Callable[[], Column]], ...] = ()


@dataclass(frozen=True)
class Rule:
    id: str
    severity: str
    category: str
    title: str
    description: str
    parts: tuple[Part, ...]
    order: tuple[str, ...] = ("codtit", "codusu")
    columns: Shape | None = None
    unit: str = "member"
    detail_parts: tuple[Part, ...] | None = None
    count_parts: tuple[Part, ...] | None = None
    expected_zero: bool = True
    awaits_registry: bool = False

    def rows(self, ctx: Reconciliation, parts: tuple[Part, ...] | None = None) -> DataFrame:
        """Matching rows of the rule's frame, all columns, nothing waiting in the ledger."""
        out = None
        for part in parts or self.parts:
            df = ctx.frame(part.frame, part.given(ctx.day)).filter(part.when(ctx.day))
            for name, label in part.labels:
                df = df.withColumn(name, label())
            out = df if out is None else out.unionByName(df, allowMissingColumns=True)
        return ctx.without_waiting(out, self.id) if self.awaits_registry else out

    def detail(self, ctx: Reconciliation) -> DataFrame:
        """The listing of the rule, unordered and complete."""
        columns = self.columns() if self.columns else list(v.MEMBER_COLUMNS)
        return self.rows(ctx, self.detail_parts or self.parts).select(*columns)

    def count(self, ctx: Reconciliation) -> DataFrame:
        return self.rows(ctx, self.count_parts or self.parts).agg(
            F.count(F.lit(1)).alias("total")
        )


# -- small words for conditions ------------------------------------------------------


def active() -> Column:
    return F.expr(f"situusu = '{v.ACTIVE}'")


def inactive() -> Column:
    return F.expr(f"situusu = '{v.INACTIVE}'")


def movement(*codes: str) -> Column:
    return F.expr("posans in ({})".format(", ".join(f"'{code}'" for code in codes)))


def has_cco() -> Column:
    return is_present("codcco")


def raw_cco() -> Column:
    """Not empty as written: blanks count as a CCO here."""
    return F.expr("coalesce(codcco, '') <> ''")


def remote(status: str) -> Column:
    return F.expr(f"r_state = '{status}'")


def _ans(*names: str) -> list[Column]:
    """Registry columns under the names results use."""
    shown = {
        "status_ans": "r_status", "cco_ans": "r_codcco", "codusu_ans": "r_codusu",
        "nome_ans": "r_nomeusu", "cpf_ans": "r_cpfusu", "nasc_ans": "r_nascusu",
        "dataini_ans": "r_dataini", "datafim_ans": "r_datafim",
    }
    return [c(shown[n]).alias(n) for n in (names or shown)]


def _text(value: str, name: str) -> Column:
    return F.lit(value).alias(name)


def _match(*more) -> list:
    return [*v.MATCH_COLUMNS, *_ans(), *more]


# -- parts used by several rules -----------------------------------------------------


def member_rule(test: Test) -> tuple[Part, ...]:
    return (Part("members", test),)


def _name_parts(given: Test, when: Test) -> tuple[Part, ...]:
    return (Part("names", given, when),)


def _invalid_name(day: Column) -> Column:
    return active() & (
        (is_present("nomeusu") & has_illegal_character("nomeusu"))
        | (is_present("mae") & has_illegal_character("mae"))
        | (is_present("mae") & (word_count("mae") < 2))
    )


def _name_problem() -> Column:
    return (
        F.when(is_present("nomeusu") & has_digit("nomeusu"), F.lit(v.NAME_DIGIT))
        .when(is_present("nomeusu") & has_illegal_character("nomeusu"), F.lit(v.NAME_CHARACTER))
        .alias("problema_nomeusu")
    )


def _mother_problem() -> Column:
    return (
        F.when(is_present("mae") & has_digit("mae"), F.lit(v.MOTHER_DIGIT))
        .when(is_present("mae") & has_illegal_character("mae"), F.lit(v.MOTHER_CHARACTER))
        .when(is_present("mae") & (word_count("mae") < 2), F.lit(v.MOTHER_ONE_WORD))
        .alias("problema_mae")
    )


def _inclusion_without_cco(day: Column) -> Column:
    return active() & movement(v.INCLUSION) & is_blank("codcco") & (F.length("m_digits") == 11)


def _old_reinclusion(day: Column) -> Column:
    return older_than_days("dataini", day, 90) & movement(v.REINCLUSION) & has_cco()


def _intended_reinclusion() -> Column:
    return F.coalesce(remote(v.REG_INACTIVE), F.lit(False)) & (
        exact_same_record() & mandatory_present()
    )


def _absent_given(day: Column) -> Column:
    return not_inactive() & ~(active() & raw_cco() & movement(v.INCLUSION))


def _late_without_cco(day: Column) -> Column:
    return (
        active() & is_blank("codcco") & is_present("cpfusu")
        & (c("posans") != v.INCLUSION) & deadline_passed("dataini", day)
    )


def _name_to_send(day: Column) -> Column:
    """Names differ, and the member is not yet prepared to send its own name."""
    differs = c("differing_name").isNotNull() | c("holder_differs")
    title_settled = (
        (F.trim(c("codusu")) != v.HOLDER) | c("ct_codtit").isNull() | ~c("holder_differs")
    )
    return differs & ~(prepared_for_flex("ansnome") & title_settled)


def sent_name() -> Column:
    """The version a member is listed with: any newest name if its contract differs."""
    return F.when(c("holder_differs"), c("newest_name")).otherwise(c("differing_name"))


def _birth_given(day: Column) -> Column:
    return (
        not_inactive() & raw_cco() & c("dataini").isNotNull() & is_present("cpfusu")
        & is_present("nomeusu") & c("nascusu").isNotNull() & ~prepared_for_flex("ansnasc")
    )


def flex_without_flag(day: Column) -> Column:
    return movement(v.FLEX) & ~some_flag_marked()


def _duplicate_base(day: Column) -> Column:
    return not_inactive() & has_cco()


RULES: tuple[Rule, ...] = (
    Rule(
        "inativo_sem_cco_nao_atualizado", "critica", "Movement",
        "Inactive without CCO, movement not settled",
        "An inactive member the registry never numbered must not carry a movement.",
        member_rule(lambda day: inactive() & is_blank("codcco") & (c("posans") != v.UPDATED)),
        ("dataini", "codtit", "codusu"),
    ),
    Rule(
        "ativo_com_cco_inclusao", "critica", "Movement",
        "Active with CCO still marked for inclusion",
        "The registry already knows the member, so an inclusion cannot be pending.",
        member_rule(lambda day: active() & has_cco() & movement(v.INCLUSION)),
        ("dataini", "codtit", "codusu"),
    ),
    Rule(
        "inativo_cco_null_exclusao", "critica", "Movement",
        "Inactive without CCO marked for exclusion",
        "Nothing can be excluded from the registry without its number.",
        member_rule(lambda day: inactive() & c("codcco").isNull() & movement(v.EXCLUSION)),
        ("datafim", "codtit", "codusu"),
    ),
    Rule(
        "inativo_cco_null_inclusao", "critica", "Movement",
        "Inactive without CCO marked for inclusion",
        "An inactive member is not to be included.",
        member_rule(lambda day: inactive() & c("codcco").isNull() & movement(v.INCLUSION)),
        ("dataini", "codtit", "codusu"),
    ),
    Rule(
        "alteracao_com_cco", "alta", "Movement",
        "Change pending for a member with CCO",
        "The change was sent and its return has not been reconciled.",
        member_rule(lambda day: movement(v.CHANGE) & has_cco()),
        ("dataalt", "dataini", "codtit", "codusu"),
    ),
    Rule(
        "reinclusao_antiga_com_cco", "alta", "Deadlines",
        "Re-inclusion older than 90 days with CCO",
        "The re-inclusion is stuck, unless the registry still shows the same record inactive.",
        (Part("by_cco", _old_reinclusion, lambda day: ~_intended_reinclusion()),),
        ("dataini", "codtit", "codusu"),
        lambda: [*v.MEMBER_COLUMNS, *_ans()],
    ),
    Rule(
        "inclusao_antiga_com_cco", "alta", "Deadlines",
        "Inclusion older than 90 days with CCO",
        "The inclusion should have been settled by now.",
        member_rule(lambda day: older_than_days("dataini", day, 90)
                    & movement(v.INCLUSION) & has_cco()),
        ("dataini", "codtit", "codusu"),
    ),
    Rule(
        "reinclusao_recente_com_cco", "alta", "Deadlines",
        "Recent re-inclusion with CCO",
        "The movement contradicts the number the member already has.",
        member_rule(lambda day: (c("dataini") >= F.date_sub(day, 90))
                    & movement(v.REINCLUSION) & has_cco()),
        ("-dataini", "codtit", "codusu"),
    ),
    Rule(
        "cadusu_ausente_confsib", "critica", "Registry",
        "Member absent from the registry",
        "Found neither by CCO, nor (without CCO) by code and birth or CPF and birth.",
        (Part("absent", _absent_given),),
        ("situusu", "posans", "codtit", "codusu"),
    ),
    Rule(
        "confsib_sem_cadusu", "alta", "Registry",
        "Active registry record without a member",
        "No member has its CCO, or (without CCO) its code and birth or CPF and birth.",
        (Part("orphans", lambda day: remote(v.REG_ACTIVE)),),
        ("nomeusu", "numseq"),
        lambda: [c(f"r_{n}").alias(n) for n in v.REGISTRY_COLUMNS],
        unit="registry",
    ),
    Rule(
        "confsib_sem_cadusu_inativo", "media", "Registry",
        "Inactive registry record without a member",
        "The same search for inactive records, mostly old exclusions.",
        (Part("orphans", lambda day: remote(v.REG_INACTIVE)),),
        ("nomeusu", "numseq"),
        lambda: [c(f"r_{n}").alias(n) for n in v.REGISTRY_COLUMNS],
        unit="registry",
    ),
    Rule(
        "inativo_cadusu_ativo_confsib", "critica", "Registry",
        "Inactive member, active in the registry",
        "Matched by CCO without contradiction; exclusion neither marked nor awaited.",
        (Part(
            "by_cco",
            lambda day: inactive() & has_cco() & (c("posans") != v.EXCLUSION),
            lambda day: remote(v.REG_ACTIVE) & compatible_keys(),
        ),),
        columns=lambda: _match(_text(v.KEY_CCO_COMPATIBLE, "chave_usada")),
        awaits_registry=True,
    ),
    Rule(
        "ativo_cadusu_inativo_confsib", "critica", "Registry",
        "Active member, inactive in the registry",
        "The same person in every compared field, by CCO or, for a new inclusion, by CPF.",
        (
            Part(
                "by_trimmed_cco",
                lambda day: active() & has_cco() & (c("posans") != v.UPDATED),
                lambda day: remote(v.REG_INACTIVE) & full_identity(),
                (("chave_usada", lambda: F.lit(v.KEY_FULL_CCO)),
                 ("situacao_correcao", lambda: F.lit(v.TODO_UPDATED))),
            ),
            Part(
                "by_cpf",
                _inclusion_without_cco,
                lambda day: remote(v.REG_INACTIVE) & full_identity(),
                (("chave_usada", lambda: F.lit(v.KEY_FULL_NO_CCO)),
                 ("situacao_correcao", lambda: F.lit(v.TODO_LINK))),
            ),
        ),
        ("-dataini", "posans", "codtit", "codusu"),
        lambda: _match("chave_usada", "situacao_correcao"),
    ),
    Rule(
        "ativo_inativo_confsib_reinclusao", "critica", "Registry",
        "Active member to be re-included",
        "The same record is inactive in the registry and cannot be settled locally.",
        (Part(
            "by_trimmed_cco",
            lambda day: active() & has_cco() & (c("posans") != v.REINCLUSION)
            & mandatory_present(),
            lambda day: remote(v.REG_INACTIVE) & exact_same_record() & ~full_identity(),
        ),),
        ("-dataini", "codtit", "codusu"),
        lambda: [
            *v.MATCH_COLUMNS, "cns", "sexousu", *_ans(),
            _text(v.KEY_EXACT, "chave_usada"), _text(v.TODO_REINCLUSION, "situacao_correcao"),
        ],
        awaits_registry=True,
    ),
    Rule(
        "ativo_sem_cco_fora_inclusao", "critica", "Movement",
        "Active without CCO, not marked for inclusion",
        "The member has a CPF and the reporting deadline of its start month has passed.",
        member_rule(_late_without_cco),
        ("posans", "dataini", "codtit", "codusu"),
    ),
    Rule(
        "ativo_com_cco_exclusao", "critica", "Movement",
        "Active marked for exclusion",
        "Only inactive members are excluded.",
        member_rule(lambda day: active() & movement(v.EXCLUSION)),
        ("datafim", "codtit", "codusu"),
    ),
    Rule(
        "cadusu_sem_codans", "critica", "Integrity",
        "Member without registry code",
        "Without the code the member can be neither matched nor sent.",
        member_rule(lambda day: is_blank("codans")),
        ("situusu", "posans", "codtit", "codusu"),
    ),
    Rule(
        "inativo_com_cco_nao_excluido", "alta", "Movement",
        "Inactive with CCO, neither excluded nor settled",
        "The movement to set depends on what the registry shows for the CCO.",
        member_rule(lambda day: inactive() & has_cco()
                    & ~movement(v.EXCLUSION, v.UPDATED)),
        ("posans", "datafim", "codtit", "codusu"),
        lambda: [
            *v.MEMBER_COLUMNS, *_ans("status_ans"),
            F.when(remote(v.REG_INACTIVE), F.lit(v.HINT_INACTIVE))
            .when(remote(v.REG_ACTIVE), F.lit(v.HINT_ACTIVE))
            .otherwise(F.lit(v.HINT_MISSING)).alias("sugestao_posans"),
        ],
        detail_parts=(Part(
            "by_cco",
            lambda day: inactive() & has_cco() & ~movement(v.EXCLUSION, v.UPDATED),
        ),),
    ),
    Rule(
        "exclusao_cco_ja_inativo_confsib", "alta", "Registry",
        "Exclusion of a CCO the registry shows inactive",
        "The registry rejects an exclusion of what is already inactive.",
        (Part(
            "by_cco",
            lambda day: movement(v.EXCLUSION) & has_cco(),
            lambda day: remote(v.REG_INACTIVE),
        ),),
        ("situusu", "datafim", "codtit", "codusu"),
        lambda: [
            *v.MATCH_COLUMNS, *_ans("status_ans", "nome_ans", "datafim_ans"),
            _text(v.NOTE_EXCLUSION, "situacao_exclusao"),
        ],
    ),
    Rule(
        "exclusao_sem_datafim", "alta", "Dates",
        "Exclusion of an inactive member without end date",
        "The exclusion needs the date the membership ended.",
        member_rule(lambda day: inactive() & movement(v.EXCLUSION) & c("datafim").isNull()),
    ),
    Rule(
        "exclusao_sem_datafim_nao_inativo", "alta", "Movement",
        "Exclusion of a member that is not inactive",
        "A blocked member was marked for exclusion by mistake.",
        member_rule(lambda day: not_inactive() & movement(v.EXCLUSION)
                    & c("datafim").isNull() & has_cco()),
        ("situusu", "codtit", "codusu"),
    ),
    Rule(
        "inclusao_sem_dataini", "alta", "Dates",
        "Inclusion or re-inclusion without start date",
        "Both movements need the date the membership starts.",
        member_rule(lambda day: movement(v.INCLUSION, v.REINCLUSION) & c("dataini").isNull()),
        ("situusu", "codtit", "codusu"),
    ),
    Rule(
        "ativo_campos_sib_obrigatorios", "alta", "Member data",
        "Active with a mandatory field missing",
        "Name, birth, sex, or both CPF and CNS are missing.",
        member_rule(lambda day: missing_mandatory()),
    ),
    Rule(
        "ativo_sem_cpf_posans", "alta", "Movement",
        "Active without CPF",
        "Without a CPF the registry does not number the member.",
        member_rule(lambda day: active() & is_blank("cpfusu")),
        ("posans", "codtit", "codusu"),
    ),
    Rule(
        "cpf_invalido_ativo", "media", "Member data",
        "Active with a malformed CPF",
        "A CPF is exactly eleven digits, without mask.",
        member_rule(lambda day: active() & is_present("cpfusu") & ~is_cpf("cpfusu")),
    ),
    Rule(
        "nome_mae_invalido", "critica", "Integrity",
        "Invalid name or mother's name",
        "Only letters, spaces, hyphens and apostrophes; the mother's name has two words.",
        member_rule(_invalid_name),
        columns=lambda: [
            "id", "codtit", "codusu", "nomeusu", "mae", "situusu", "posans", "codcco", "codans",
            "cpfusu", "nascusu", "dataini", _name_problem(), _mother_problem(),
        ],
    ),
    Rule(
        "cco_duplicado", "critica", "Integrity",
        "CCO used by several members",
        "The CCO identifies one person. Counts the numbers, lists the members.",
        (Part("duplicate_cco", _duplicate_base),),
        ("codcco", "situusu", "codtit", "codusu"),
        unit="group",
        count_parts=(Part("duplicate_cco_keys", _duplicate_base),),
    ),
    Rule(
        "cpf_inclusao_ja_ativo_confsib", "critica", "Registry",
        "Inclusion of a CPF the registry shows active",
        "The same person (name and start agree): the registry would reject the inclusion.",
        (Part(
            "by_cpf",
            _inclusion_without_cco,
            lambda day: remote(v.REG_ACTIVE) & same_start() & same_name("nomeusu", "r_nomeusu"),
        ),),
        ("-dataini", "codtit", "codusu"),
        lambda: [
            "id", "codtit", "codusu", "nomeusu", "situusu", "posans", "cpfusu", "nascusu",
            "codplano", "codcco", "codans", "dataini", c("r_start").alias("dataini_ans"),
            c("r_codcco").alias("cco_conflito"), c("r_codusu").alias("codusu_conflito"),
            c("r_codtit").alias("codtit_conflito"), c("r_nomeusu").alias("nome_conflito"),
            c("r_codplaport").alias("plano_conflito"),
            c("r_codplaope").alias("plano_ope_conflito"),
            c("r_cnpj").alias("cnpj_contratante_ans"), *_ans("status_ans"),
            _text(v.NOTE_SAME_PERSON, "situacao_inclusao"),
        ],
    ),
    Rule(
        "cpf_duplicado_ativos", "alta", "Integrity",
        "CPF repeated among active members of a company",
        "The company is the first four characters of the contract.",
        (Part("cpf_groups", lambda day: active()),),
        ("cpfusu", "empresa", "nascusu", "codtit", "codusu"),
        lambda: [
            "id", "empresa", "codtit", "codusu", "nomeusu", "situusu", "posans", "codcco",
            "codans", "cpfusu", "nascusu", "sexousu", "dataini", "datafim", "codplano",
            "parentesco",
        ],
    ),
    Rule(
        "cpf_duplicado_ativos_nasc_divergente", "critica", "Integrity",
        "Repeated CPF with different births",
        "The CPF is wrong or was given to different people.",
        (Part("cpf_groups", lambda day: active(), lambda day: differing()),),
        ("cpfusu", "empresa", "nascusu", "codtit", "codusu"),
        lambda: [
            "id", "empresa", "codtit", "codusu", "nomeusu", "cpfusu", "nascusu", "situusu",
            "posans", "codcco", "codans", "sexousu", "dataini", "datafim", "nascimentos_do_cpf",
        ],
        detail_parts=(Part("cpf_groups_births", lambda day: active(), lambda day: differing()),),
    ),
    Rule(
        "cpf_invalido_cruzado_nascimento", "critica", "Integrity",
        "CPF that does not belong to the birth date",
        "Of members sharing a CPF with different births, all but the earliest born.",
        (Part(
            "cpf_groups", lambda day: active(),
            lambda day: differing() & (c("id") != c("keeper.id_mantido")),
        ),),
        ("cpf_atual", "empresa", "nascusu", "codtit", "codusu"),
        lambda: [
            "id", "empresa", "codtit", "codusu", "nomeusu", "codcco", "posans", "dataini",
            c("cpfusu").alias("cpf_atual"), "nascusu",
            c("keeper.cpf_mantido").alias("cpf_do_cadastro_mantido"),
            c("keeper.nasc_mantido").alias("nasc_do_cadastro_mantido"),
            c("keeper.nome_mantido").alias("nome_do_cadastro_mantido"),
            c("keeper.id_mantido").alias("id_mantido"), "situusu", "codans",
        ],
    ),
    Rule(
        "divergencia_nome_cadusu_confsib", "alta", "Registry",
        "Name differs from the registry or the contract",
        "The local name stands and is to be sent, unless it is already prepared.",
        _name_parts(lambda day: has_cco() & not_inactive(), _name_to_send),
        ("id",),
        lambda: [
            "id", "codtit", "codusu", "codcco", "situusu", "posans", "ansnome",
            c("nomeusu").alias("nome_local"),
            sent_name().getField("r_nomeusu").alias("nome_ans"),
            c("nometit").alias("nometit_contrato"), "cpfusu", "nascusu", "dataini",
            F.when(c("m_name") != sent_name().getField("r_name"), F.lit(v.NAME_SEND))
            .when(c("holder_differs"), F.lit(v.NAME_ALIGN))
            .otherwise(F.lit(v.NAME_OK)).alias("situacao_nome"),
            F.when(c("holder_differs"), F.lit(v.HOLDER_UPDATE))
            .when(is_holder(), F.lit(v.HOLDER_OK)).alias("situacao_titular"),
        ],
    ),
    Rule(
        "divergencia_nome_inativo_confsib", "media", "Registry",
        "Name of an inactive member differs from the registry",
        "For inactive members the registry's name is taken.",
        _name_parts(
            lambda day: raw_cco() & inactive(), lambda day: c("differing_name").isNotNull()
        ),
        ("id",),
        lambda: [
            "id", "codtit", "codusu", "codcco", "situusu", "posans",
            c("nomeusu").alias("nome_local"),
            c("differing_name.r_nomeusu").alias("nome_ans"), "cpfusu", "nascusu", "dataini",
        ],
    ),
    Rule(
        "divergencia_nasc_cadusu_confsib", "alta", "Registry",
        "Birth differs from the registry",
        "The same CCO, start, name and CPF; the local birth is to be sent.",
        (Part("births", _birth_given),),
        ("id",),
        lambda: [
            "id", "codtit", "codusu", "codcco", "situusu", "posans", "ansnasc", "nomeusu",
            "cpfusu", "dataini", c("nascusu").alias("nasc_local"),
            c("other_birth.r_birth").alias("nasc_ans"),
            c("other_birth.r_nascusu").alias("nasc_ans_raw"),
        ],
    ),
    Rule(
        "sib_flex_sem_campo_marcado", "critica", "Movement",
        "Field correction without any field marked",
        "At least one of the twelve flags has to say which field is sent.",
        member_rule(flex_without_flag),
        columns=lambda: [
            *v.MATCH_COLUMNS, "rgusu", "mae", "cns", "parentesco", "codplano", *v.FLAGS,
            F.when(c("r_codcco").isNull(), F.lit(v.FLEX_NO_REGISTRY))
            .when(some_difference(), F.lit(v.FLEX_DIFFERS))
            .otherwise(F.lit(v.FLEX_EQUAL)).alias("comparacao_ans"),
        ],
        detail_parts=(Part("by_cco_full", flex_without_flag),),
    ),
    Rule(
        "reativacao_cco_ja_ativo_confsib", "alta", "Registry",
        "Reactivation of a CCO the registry shows active",
        "The registry rejects a reactivation of what is already active.",
        (Part(
            "by_cco",
            lambda day: movement(v.REINCLUSION, v.REACTIVATION) & has_cco(),
            lambda day: remote(v.REG_ACTIVE),
        ),),
        ("posans", "situusu", "codtit", "codusu"),
        lambda: [
            *v.MATCH_COLUMNS, *_ans("status_ans", "nome_ans", "dataini_ans"),
            _text(v.NOTE_REACTIVATION, "situacao_reativacao"),
        ],
    ),
    Rule(
        "ret_reativ_com_cco", "alta", "Movement",
        "Reactivation return with CCO, not inactive",
        "The reactivation is already reflected.",
        member_rule(lambda day: movement(v.REACTIVATION) & not_inactive() & has_cco()),
        ("situusu", "codtit", "codusu"),
    ),
    Rule(
        "posans_desconhecido", "media", "Integrity",
        "Unknown movement code",
        "A code outside the seven known ones.",
        member_rule(lambda day: ~movement(*v.MOVEMENTS)),
        ("posans", "codtit", "codusu"),
    ),
)

BY_ID = {rule.id: rule for rule in RULES}
