"""One reduction of the registry that serves all rules which compare members with it.

Every registry version names, once, each key something is looked up by: its CCO as written,
the trimmed CCO, CPF and status, and so on, all in one column set ``kind, k1 .. k4``. One
scan, one exchange and one partial aggregation give the *facts* of every key: its newest
version and the range of the values in question (names, births, contract titles). "Some
version differs from x" is "the least or the greatest value differs from x".

Members name the keys they need in the same way (*probes*), look the facts up in one join,
and get them back as one row per member. Facts of two sets of versions merge into those of
their union, so stored facts can be brought up to date by new versions alone.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from concilia.functions.predicates import any_of, is_holder
from concilia.functions.prepare import normalise
from concilia.functions.text import upper_trim
from concilia.operators.matching import lookup
from concilia.plans.context import Reconciliation
from concilia.vocabulary import REG_ACTIVE, REG_INACTIVE

#: The frames that are evaluated on wide rows.
FRAMES = ("by_cco", "by_trimmed_cco", "by_cpf", "names", "births", "absent")

KEY = ["kind", "k1", "k2", "k3", "k4"]
CCO, PADDED, CPF, BIRTHS, CODE_BIRTH, CPF_BIRTH, TITLE = range(1, 8)

#: What tells versions of equal sequence apart, in this order; the first group only counts
#: where a CPF is looked up (see ``Reconciliation._frame_by_cpf``).
_CPF_ONLY = ("r_cnpj", "r_codplaope", "r_codplaport", "r_codtit")
_CONTENT = (
    "r_cnpj", "r_codcco", "r_codplaope", "r_codplaport", "r_codtit", "r_codusu", "r_cpfusu", "r_datafim", "r_dataini",
    "r_nascusu", "r_nomeusu", "r_status",
)


def _key(kind: int, *parts: Column) -> list[Column]:
    values = [*parts, *[F.lit("")] * (4 - len(parts))]
    return [F.lit(kind).alias("kind"), *(p.cast("string").alias(f"k{i}") for i, p in enumerate(values, 1))]


def _version(of_cpf: bool) -> Column:
    """A version as a struct whose least value is the newest one (unknown sequence first)."""
    fields = [F.col("r_numseq").isNotNull().alias("known"), (-F.col("r_numseq")).alias("older")]
    for name in _CONTENT:
        value = F.lit(None).cast("string") if name in _CPF_ONLY and not of_cpf else F.col(name)
        fields += [value.isNull().alias(f"no_{name}"), value.alias(name)]
    return F.struct(*fields)


_VERSION = "struct<known:boolean,older:bigint," + ",".join(f"no_{n}:boolean,{n}:string" for n in _CONTENT) + ">"


def _entry(key: list[Column], version: Column | None = None, low: Column | None = None) -> Column:
    nothing = F.lit(None).cast(_VERSION)
    value = F.lit(None).cast("string") if low is None else low.cast("string")
    return F.struct(*key, (nothing if version is None else version).cast(_VERSION).alias("version"), value.alias("value"))


def _entries(registry: DataFrame, contracts: DataFrame | None) -> DataFrame:
    """``kind, k1 .. k4, version, value``: every key of every version, and of contract titles."""
    c = F.col
    known = lambda *names: any_of([c(n).isNull() for n in names])
    when = lambda test, entry: F.when(F.coalesce(test, F.lit(False)), entry)
    version = _version(False)
    entries = F.array_compact(F.array(
        when(c("r_codcco").isNotNull(), _entry(_key(CCO, c("r_codcco")), version, F.when(c("r_name") != "", c("r_name")))),
        when(c("r_cco") != c("r_codcco"), _entry(_key(PADDED, c("r_cco")), version)),
        when(
            c("r_cco").isNotNull() & c("r_cpf").isNotNull() & c("r_state").isin(REG_ACTIVE, REG_INACTIVE),
            _entry(_key(CPF, c("r_cpf"), c("r_state")), _version(True)),
        ),
        when(
            ~known("r_codcco", "r_start", "r_cpf", "r_name", "r_birth"),
            _entry(_key(BIRTHS, c("r_codcco"), c("r_start"), c("r_cpf"), c("r_name")), low=c("r_birth")),
        ),
        when(~known("r_codusu", "r_birth"), _entry(_key(CODE_BIRTH, c("r_codusu"), c("r_birth")))),
        when(~known("r_cpfusu", "r_birth"), _entry(_key(CPF_BIRTH, c("r_cpfusu"), c("r_birth")))),
    ))
    found = registry.select(F.explode(entries).alias("e")).select("e.*")
    if contracts is None:
        return found
    titles = contracts.where(c("codtit").isNotNull())
    return found.unionByName(titles.select(_entry(_key(TITLE, c("codtit")), low=upper_trim("nometit")).alias("e")).select("e.*"))


def _in_shares(registry: DataFrame) -> DataFrame:
    """The registry's rows in shares of the advisory size; versions of a CCO stay together
    unless they exceed one.

    Least and greatest structs are found by sorting, in the map task too, where every version
    has up to six entries: a task would sort all that lies in the files it reads. Only the
    table's own columns are moved.
    """
    return normalise(registry.select("r_numseq", *_CONTENT).hint("rebalance", "r_codcco"))


def registry_facts(registry: DataFrame, contracts: DataFrame | None = None) -> DataFrame:
    """``kind, k1 .. k4, newest, low, high`` of every key. Prepared registry."""
    return _entries(_in_shares(registry), contracts).groupBy(*KEY).agg(
        F.min("version").alias("newest"), F.min("value").alias("low"), F.max("value").alias("high")
    )


def merged_facts(*facts: DataFrame) -> DataFrame:
    """The facts of the union of the versions that each of ``facts`` is about."""
    every = facts[0]
    for more in facts[1:]:
        every = every.unionByName(more)
    return every.groupBy(*KEY).agg(F.min("newest").alias("newest"), F.min("low").alias("low"), F.max("high").alias("high"))


def _given(ctx: Reconciliation, parts: Iterable, *frames: str) -> Column:
    tests = [part.given(ctx.day) for part in parts if part.frame in frames]
    return F.coalesce(any_of(tests), F.lit(False)) if tests else F.lit(False)


def _raw_cco() -> Column:
    return F.coalesce("codcco", F.lit("")) != ""


def probes(ctx: Reconciliation, members: DataFrame, parts: Sequence) -> DataFrame:
    """``id, slot, trims, kind, k1 .. k4``: the keys each member needs for these parts.

    Prepared members. ``trims`` marks keys that belong to the member's trimmed CCO. Rows
    without a needed key have none, so blanks meet nowhere.
    """
    c = F.col
    by_cco, trimmed, by_cpf = (_given(ctx, parts, f) for f in ("by_cco", "by_trimmed_cco", "by_cpf"))
    named, born, absent = (_given(ctx, parts, f) for f in ("names", "births", "absent"))
    same = F.coalesce(c("codcco") == c("m_cco"), F.lit(False))

    def probe(test: Column, slot: int, trims: Column | bool, *key) -> Column:
        usable = test & ~any_of([k.isNull() for k in key[1:]])
        trims = F.lit(trims) if isinstance(trims, bool) else trims
        return F.when(usable, F.struct(F.lit(slot).alias("slot"), trims.alias("trims"), *_key(*key)))

    wanted = F.array_compact(F.array(
        probe(by_cco | named | (absent & _raw_cco()) | (trimmed & same), 0, same, CCO, c("codcco")),
        probe(trimmed & ~same, 1, True, CCO, c("m_cco")),
        probe(trimmed, 2, True, PADDED, c("m_cco")),
        probe(by_cpf, 3, False, CPF, c("m_cpf"), F.lit(REG_ACTIVE)),
        probe(by_cpf, 4, False, CPF, c("m_cpf"), F.lit(REG_INACTIVE)),
        probe(born, 5, False, BIRTHS, c("codcco"), c("dataini"), c("m_cpf"), c("m_name")),
        probe(absent & ~_raw_cco() & (c("codans") != ""), 6, False, CODE_BIRTH, c("codans"), c("nascusu")),
        probe(absent & ~_raw_cco() & (c("cpfusu") != ""), 7, False, CPF_BIRTH, c("cpfusu"), c("nascusu")),
        probe(named & is_holder(), 8, False, TITLE, c("codtit")),
    ))
    return members.select("id", F.explode(wanted).alias("p")).select("id", "p.*")


def facts_by_member(wanted: DataFrame, facts: DataFrame) -> DataFrame:
    """One row per member: its facts by what they are for."""
    right = facts.select(*[F.col(k).alias(f"f_{k}") for k in KEY], "newest", "low", "high")
    found = lookup(wanted, right, {k: f"f_{k}" for k in KEY}, "inner")
    at = lambda value, *slots: F.min(F.when(F.col("slot").isin(*slots), F.col(value)))
    has = lambda *slots: F.bool_or(F.col("slot").isin(*slots))
    return found.groupBy(F.col("id").alias("of")).agg(
        at("newest", 0).alias("cco"),
        F.min(F.when(F.col("trims"), F.col("newest"))).alias("trimmed"),
        at("newest", 3).alias("cpf_active"), at("newest", 4).alias("cpf_inactive"),
        at("low", 0).alias("name_low"), at("high", 0).alias("name_high"),
        at("low", 5).alias("birth_low"), at("high", 5).alias("birth_high"),
        at("low", 8).alias("title_low"), at("high", 8).alias("title_high"),
        has(0).alias("has_cco"), has(6, 7).alias("has_other"),
    )


def wide_rows(ctx: Reconciliation, parts: Sequence, members: DataFrame, facts: DataFrame) -> DataFrame:
    """Members with a column ``frame`` and what rules on that frame look at, a row per frame
    that the member is in. Conditions see the columns they see on the frame itself."""
    c = F.col
    rows = members.filter(_given(ctx, parts, *FRAMES))
    rows = lookup(rows, facts_by_member(probes(ctx, rows, parts), facts), {"id": "of"}, "left")
    differs = lambda low, high, x: F.coalesce((c(low) != x) | (c(high) != x), F.lit(False))
    holder = is_holder() & ((c("title_low") != c("title_high")) | (c("title_low") != c("m_name")))
    nothing, no = F.lit(None).cast(_VERSION), F.lit(False)

    def frame(name: str, test: Column, version: Column = nothing, **more: Column) -> Column:
        extra = {"differing_name": F.lit(None).cast("boolean"), "holder_differs": no, "ct_codtit": F.lit(None).cast("string"), **more}
        inside = F.struct(F.lit(name).alias("frame"), version.alias("version"), *(v.alias(n) for n, v in extra.items()))
        return F.when(test & _given(ctx, parts, name), inside)

    frames = F.array_compact(F.array(
        frame("by_cco", F.lit(True), c("cco")),
        frame("by_trimmed_cco", c("trimmed").isNotNull(), c("trimmed")),
        frame("by_cpf", c("cpf_active").isNotNull(), c("cpf_active")),
        frame("by_cpf", c("cpf_inactive").isNotNull(), c("cpf_inactive")),
        frame(
            "names", c("name_low").isNotNull(),
            differing_name=F.when(differs("name_low", "name_high", c("m_name")), F.lit(True)),
            holder_differs=F.coalesce(holder, no),
            ct_codtit=F.when(c("title_low").isNotNull(), c("codtit")),
        ),
        frame("births", differs("birth_low", "birth_high", c("nascusu").cast("string"))),
        frame("absent", ~F.coalesce(F.when(_raw_cco(), c("has_cco")).otherwise(c("has_other")), no)),
    ))
    own = members.columns
    rows = rows.select(*own, F.explode(frames).alias("f")).select(*own, "f.*")
    # Columns of the version, and those that follow from them.
    return normalise(rows.select(
        *own, "frame", "differing_name", "holder_differs", "ct_codtit",
        (-c("version.older")).alias("r_numseq"), *[c(f"version.{n}").alias(n) for n in _CONTENT],
    ))


def hits(ctx: Reconciliation, found: Sequence[tuple], members: DataFrame | None = None, facts: DataFrame | None = None) -> DataFrame:
    """``id, rule_id``: the members that break the given ``(rule, part)``s on these frames.

    ``members`` and ``facts`` stand for the whole tables; both are prepared.
    """
    parts = [part for _, part in found]
    members = ctx.m if members is None else members
    if facts is None:
        needs_titles = any(part.frame == "names" for part in parts)
        facts = registry_facts(ctx.r, ctx.contracts if needs_titles else None)
    broken = F.array_compact(F.array(*[
        F.when((F.col("frame") == part.frame) & part.given(ctx.day) & part.when(ctx.day), F.lit(rule.id)) for rule, part in found
    ]))
    return wide_rows(ctx, parts, members, facts).select("id", F.explode(broken).alias("rule_id"))
