"""Rejected records returned by the registry: flatten, explain, count, correct.

A record holds fields and a field holds errors, both as arrays in document order. They are
read by ``sources.rejection_xml``.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from concilia import vocabulary as v
from concilia.functions.text import is_present
from concilia.operators.changes import apply_wide
from concilia.operators.matching import lookup
from concilia.operators.versions import first_per_key

SETTLE = "posans_atualizado"
INCLUDE = "posans_inclusao"

# Error code -> (severity, correction). Titles and advice are ours.
ERROR_CODES = {
    "0205": ("alta", "", "Born after the start", "Correct the birth or the start, send again."),
    "0206": ("critica", "", "Birth locked by the tax authority", "Check the CPF and the name."),
    "0410": ("critica", "", "Already active for this CPF and plan", "Link the existing CCO."),
    "1205": ("alta", "", "Start outside the reported month", "Correct the start, send again."),
    "1602": ("alta", "", "Employer document missing", "Complete the employer, send again."),
    "1702": ("alta", "", "Employer document missing", "Complete the employer, send again."),
    "1802": ("alta", "", "Holder code unknown", "Correct the holder, send again."),
    "1803": ("alta", "", "Code is not a holder's", "Correct the holder, send again."),
    "3005": ("media", SETTLE, "CCO already inactive", "Settle: posans = 4-ATUALIZADO."),
    "3011": ("baixa", SETTLE, "Nothing changed", "Settle: posans = 4-ATUALIZADO."),
    "3103": ("alta", "", "End outside the reported month", "Correct the end, send again."),
    "3205": ("critica", INCLUDE, "Cannot be reactivated", "Clear the CCO, send an inclusion."),
    "4202": ("alta", "", "Employer document missing", "Complete the employer, send again."),
}
DEFAULT = ("media", "", "Unknown error code", "Look the code up and correct the field by hand.")

#: What each correction does to the local member, and the label of its button.
LOCAL_ACTION = {
    SETTLE: ("posans = 4-ATUALIZADO", "Apply: settle the movement"),
    INCLUDE: ("codcco = NULL, posans = 1-INCLUSAO", "Apply: send as an inclusion"),
}
BY_HAND = {
    "0205": "nascusu, dataini", "0206": "cpfusu, nomeusu", "0410": "codcco", "1205": "dataini",
    "1602": "contract", "1702": "contract", "1802": "codtit", "1803": "codtit",
    "3103": "datafim", "4202": "contract",
}


def error_codes(spark: SparkSession) -> DataFrame:
    rows = [
        {
            "d_code": code, "d_severity": s, "d_action": a, "d_title": t, "d_advice": d,
            "d_local": LOCAL_ACTION[a][0] if a else f"correct by hand: {BY_HAND[code]}",
            "d_label": LOCAL_ACTION[a][1] if a else "",
        }
        for code, (s, a, t, d) in ERROR_CODES.items()
    ]
    return spark.createDataFrame(pa.Table.from_pylist(rows))


def suggest(df: DataFrame, code: str = "codigo_erro") -> DataFrame:
    """Severity, title, advice, local action and correction of a code, with its label;
    defaults for unknown codes.

    The dictionary has 13 rows, so broadcasting it is safe at any size of ``df``.
    """
    words = F.broadcast(error_codes(df.sparkSession))
    joined = df.join(words, F.trim(F.coalesce(F.col(code), F.lit(""))) == F.col("d_code"), "left")
    severity, action, title, advice = DEFAULT
    return joined.withColumns({
        "severidade": F.coalesce("d_severity", F.lit(severity)),
        "titulo": F.coalesce("d_title", F.lit(title)),
        "sugestao": F.coalesce("d_advice", F.lit(advice)),
        "fix_action": F.coalesce("d_action", F.lit(action)),
        "fixable": F.coalesce("d_action", F.lit("")) != "",
        "acao_local": F.coalesce("d_local", F.lit("correct by hand")),
        "fix_label": F.coalesce("d_label", F.lit("")),
    }).drop("d_code", "d_severity", "d_action", "d_title", "d_advice", "d_local", "d_label")


def flatten(records: DataFrame) -> DataFrame:
    """Adds ``erros``: all errors of a record in document order, each with its field."""
    flat = F.flatten(F.transform(
        F.coalesce("campoErro", F.expr("array()").cast(records.schema["campoErro"].dataType)),
        lambda field: F.transform(
            F.coalesce(field["erro"], F.expr("array()").cast(
                records.schema["campoErro"].dataType.elementType["erro"].dataType)),
            lambda error: F.struct(
                _clean(error["codigoErro"]).alias("codigo_erro"),
                _clean(error["mensagemErro"]).alias("mensagem_erro"),
                _clean(field["codigoCampo"]).alias("codigo_campo"),
                _clean(field["descricaoCampo"]).alias("descricao_campo"),
                _clean(field["valorCampo"]).alias("valor_campo"),
            ),
        ),
    ))
    return records.withColumn("erros", flat)


def _clean(value: Column) -> Column:
    return F.coalesce(F.trim(value), F.lit(""))


def explode_errors(records: DataFrame) -> DataFrame:
    """One row per error (one row with NULLs for a record without any), with its position."""
    keep = [c for c in records.columns if c not in ("campoErro", "erros")]
    rows = records.select(*keep, F.posexplode_outer("erros").alias("position", "e"))
    return rows.select(*keep, "position", "e.*")


def with_principal(records: DataFrame) -> DataFrame:
    """The record's first error as columns, explained.

    A record without errors is ``media`` and has empty texts.
    """
    first = records.withColumn("_first", F.get("erros", F.lit(0)))
    named = first.withColumns({
        name: F.coalesce(F.col(f"_first.{name}"), F.lit(""))
        for name in ("codigo_erro", "mensagem_erro", "descricao_campo", "valor_campo")
    })
    known = F.col("_first").isNotNull()
    return suggest(named).withColumns({
        name: F.when(known, F.col(name)).otherwise(F.lit("")) for name in ("titulo", "sugestao")
    }).drop("_first")


def movement_name() -> Column:
    """Movement by name, by code where the name is blank."""
    return F.when(is_present("tipo_movimento"), F.col("tipo_movimento")).otherwise(
        F.col("codigo_tipo_movimento")
    )


def by_code(principal: DataFrame) -> DataFrame:
    counted = (
        principal.filter(is_present("codigo_erro"))
        .groupBy("codigo_erro").agg(F.count(F.lit(1)).alias("quantidade"))
    )
    return suggest(counted).orderBy(F.col("quantidade").desc(), "codigo_erro")


def by_movement(principal: DataFrame) -> DataFrame:
    return (
        principal.groupBy(movement_name().alias("tipo_movimento"))
        .agg(F.count(F.lit(1)).alias("quantidade"))
        .orderBy(F.col("quantidade").desc(), "tipo_movimento")
    )


def by_severity(principal: DataFrame) -> DataFrame:
    return (
        principal.groupBy("severidade").agg(F.count(F.lit(1)).alias("quantidade"))
        .orderBy(F.col("quantidade").desc(), "severidade")
    )


def enrich(
    records: DataFrame, members: DataFrame, spread_by: str | Sequence[str]
) -> DataFrame:
    """Adds the member with the record's CCO (the lowest id if several). Prepared members.

    ``spread_by`` tells records apart, also those without a CCO, which are dealt out by it:
    all rejected inclusions have none.
    """
    names = {
        "id": "cadusu_id", "nomeusu": "cadusu_nome", "situusu": "cadusu_situusu",
        "posans": "cadusu_posans", "codusu": "cadusu_codusu", "dataini": "cadusu_dataini",
        "datafim": "cadusu_datafim",
    }
    local = members.filter("m_cco is not null").select(
        "m_cco", *[F.col(old).alias(new) for old, new in names.items()]
    )
    first = first_per_key(local, ["m_cco"], [F.col("cadusu_id").asc_nulls_last()])
    keyed = records.withColumn("_cco", F.nullif(F.trim("cco"), F.lit("")))
    return lookup(keyed, first, {"_cco": "m_cco"}, "left", spread_by=spread_by).drop(
        "_cco", "m_cco"
    )


def matched(enriched: DataFrame) -> DataFrame:
    return enriched.agg(
        F.count(F.lit(1)).alias("records"),
        F.count_if(F.col("cadusu_id").isNotNull()).alias("matched"),
    )


def choose(principal: DataFrame, code: str | None = None, movement: str | None = None) -> DataFrame:
    rows = principal
    if code:
        rows = rows.filter(F.col("codigo_erro") == code)
    if movement:
        rows = rows.filter(F.col("tipo_movimento") == movement)
    return rows


def having_error(records: DataFrame, code: str) -> DataFrame:
    """Records with the error in any position."""
    return records.filter(F.exists("erros", lambda e: e["codigo_erro"] == code))


def ccos_for_error(records: DataFrame, code: str) -> DataFrame:
    return normal_keys(having_error(records, code), "cco")


def normal_keys(df: DataFrame, name: str) -> DataFrame:
    """A key list: trimmed, without blanks, distinct."""
    return df.select(F.trim(name).alias(name)).filter(F.col(name) != "").distinct()


# -- corrections -----------------------------------------------------------------------


@dataclass(frozen=True)
class Action:
    label: str
    eligible: Callable[[str, str], Column]
    movement: str
    clears_cco: bool = False


ACTIONS = {
    SETTLE: Action(
        "Settle the movement",
        lambda posans, situusu: F.coalesce(F.trim(F.col(posans)), F.lit("")) != v.UPDATED,
        v.UPDATED,
    ),
    INCLUDE: Action(
        "Send as a new inclusion",
        lambda posans, situusu: F.col(situusu).eqNullSafe(F.lit(v.ACTIVE))
        & F.coalesce(F.col(posans).isin(v.REINCLUSION, v.REACTIVATION), F.lit(False)),
        v.INCLUSION,
        True,
    ),
}


def action_for(code: str) -> Action:
    name = ERROR_CODES.get((code or "").strip(), DEFAULT)[1]
    if name not in ACTIONS:
        raise ValueError(f"error code {code!r} has no automatic correction")
    return ACTIONS[name]


def preview_fix(members: DataFrame, ccos: DataFrame, code: str) -> DataFrame:
    """Members the correction of ``code`` would change, for a list of CCOs (column ``cco``).

    Prepared members; the list may be of any size.
    """
    action = action_for(code)
    keys = normal_keys(ccos, "cco").withColumnRenamed("cco", "k_cco")
    rows = lookup(members, keys, {"m_cco": "k_cco"}, "left_semi").filter(
        action.eligible("posans", "situusu")
    )
    new_cco = [F.lit("").alias("codcco_novo")] if action.clears_cco else []
    return rows.select(
        "id", "codtit", "codusu", "nomeusu", "situusu", "codcco", *new_cco,
        F.col("posans").alias("posans_atual"), F.lit(action.movement).alias("posans_novo"),
        F.col("m_cco").alias("cco_ref"),
    )


def apply_fix(
    members: DataFrame,
    preview: DataFrame,
    code: str,
    day: Column,
    moment: Column,
    confirm: bool = False,
) -> DataFrame:
    """Members with the previewed rows corrected (the CCO becomes NULL where it is cleared)."""
    if not confirm:
        raise ValueError("applying a correction needs confirm=True")
    action = action_for(code)
    cleared = (
        [F.lit(None).cast("string").alias("new_codcco")] if action.clears_cco else []
    )
    changes = preview.select("id", F.col("posans_novo").alias("new_posans"), *cleared)
    return apply_wide(members, changes, day, moment)


def eligible_by_code(
    records: DataFrame, members: DataFrame, spread_by: str | Sequence[str]
) -> DataFrame:
    """Per correctable code, the records having it anywhere whose member still qualifies."""
    enriched = enrich(records, members, spread_by)
    distinct_codes = F.array_distinct(F.transform("erros", lambda e: e["codigo_erro"]))
    rows = enriched.filter(F.col("cadusu_id").isNotNull()).select(
        F.explode(distinct_codes).alias("codigo_erro"),
        F.coalesce(F.trim("cadusu_posans"), F.lit("")).alias("posans"),
        F.upper(F.coalesce(F.trim("cadusu_situusu"), F.lit(""))).alias("situusu"),
    )
    explained = suggest(rows).filter("fixable")
    qualifies = F.lit(False)
    for name, action in ACTIONS.items():
        qualifies = qualifies | (
            (F.col("fix_action") == name) & action.eligible("posans", "situusu")
        )
    return explained.groupBy("codigo_erro", "fix_action").agg(
        F.count_if(qualifies).alias("elegiveis")
    )

