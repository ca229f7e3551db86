"""Order, page, filter and describe result tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from concilia.plans.catalogue import Rule
from concilia.plans.context import Reconciliation


def order_columns(keys: Sequence[str], tie: str | None = None) -> list[Column]:
    """``name`` ascending, ``-name`` descending; unknown values last in both."""
    out = [
        F.col(k[1:]).desc_nulls_last() if k.startswith("-") else F.col(k).asc_nulls_last()
        for k in keys
    ]
    return out + ([F.col(tie).asc_nulls_last()] if tie else [])


def ordered_detail(rule: Rule, ctx: Reconciliation) -> DataFrame:
    """A rule's listing in its order; critical rules put the newest start first."""
    rows = rule.detail(ctx)
    keys = list(rule.order)
    if rule.severity == "critica" and "dataini" in rows.columns and "-dataini" not in keys:
        keys = ["-dataini", *[k for k in keys if k != "dataini"]]
    return rows.orderBy(*order_columns(keys, "id" if "id" in rows.columns else None))


def page(rows: DataFrame, limit: int | None = None) -> DataFrame:
    """The first rows of an ordered table. Without a limit, all of them."""
    return rows if limit is None else rows.limit(limit)


def page_facts(rows: DataFrame, limit: int) -> DataFrame:
    """Total, returned and truncated, in one row, without collecting the rows."""
    return rows.agg(F.count(F.lit(1)).alias("total")).select(
        "total",
        F.least(F.col("total"), F.lit(limit).cast("long")).alias("returned"),
        (F.col("total") > limit).alias("truncated"),
    )


def order_rules(summary: DataFrame) -> DataFrame:
    """Most hits first, then by title."""
    return summary.orderBy(F.col("total").desc_nulls_last(), F.col("title").asc_nulls_last())


def filter_rules(
    summary: DataFrame, severity: str | None = None, state: str | None = None
) -> DataFrame:
    """``state``: ``ok`` for rules without hits, ``bad`` for rules with some."""
    rows = summary
    if severity:
        rows = rows.filter(F.col("severity") == severity)
    if state == "ok":
        rows = rows.filter(F.col("ok") & (F.col("total") == 0))
    if state == "bad":
        rows = rows.filter(F.col("total") > 0)
    return rows


# Names that say where a result column comes from.
_META = ("chave_usada", "situacao_correcao", "comparacao_ans")
_REGISTRY_ENDINGS = ("_ans", "_confsib", "_ans_raw", "_contratante_ans")


def column_origin(name: str, columns: Sequence[str]) -> str:
    """``member``, ``registry`` or ``meta``, from the name and its neighbours."""
    name, names = name.lower(), [c.lower() for c in columns]
    if name in _META:
        return "meta"
    if name.endswith(_REGISTRY_ENDINGS):
        return "registry"
    registry_listing = (
        "numseq" in names and bool({"flag", "registro"} & set(names)) and "id" not in names
        and not any(c.endswith(_REGISTRY_ENDINGS[:3]) for c in names)
    )
    return "registry" if registry_listing and name != "nome_local" else "member"


def with_origins(df: DataFrame) -> DataFrame:
    """The same table with each column's origin in the schema's metadata."""
    return df.select(*[
        F.col(c).alias(c, metadata={"origin": column_origin(c, df.columns)}) for c in df.columns
    ])


#: Fields of the contract that a member preview shows beside the member's own.
CONTRACT_FIELDS = ("nometit",)


def changed_fields(columns: Sequence[str]) -> list[str]:
    """Fields a preview shows as ``_atual`` and ``_novo``, in order."""
    found: dict[str, None] = {}
    for name in columns:
        for ending in ("_atual", "_novo"):
            if name.endswith(ending):
                found[name[: -len(ending)]] = None
    return list(found)


def paired_changes(preview: DataFrame, key: str = "id") -> DataFrame:
    """A preview in long form: one row per changed field with old and new text.

    A field a preview leaves as it is is no change; nor is an empty new value of a contract
    field, which there means that the contract stays.
    """
    pairs = [
        F.struct(
            F.lit(field).alias("field"),
            F.col(f"{field}_atual").cast("string").alias("old_value"),
            F.col(f"{field}_novo").cast("string").alias("new_value"),
        )
        for field in changed_fields(preview.columns)
    ]
    changed = ~F.col("old_value").eqNullSafe(F.col("new_value"))
    stays = F.col("field").isin(*CONTRACT_FIELDS) & F.col("new_value").isNull()
    return preview.select(key, F.inline(F.array(*pairs))).filter(changed & ~stays)
