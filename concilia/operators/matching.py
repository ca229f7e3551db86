"""Joins between members and registry.

Every join here looks up a side that holds **one row per key**, so a member row never
multiplies. Skew is handled in three ways:

* rows whose key is blank or not applicable never share a partition: in an outer or anti
  join they are scattered by a slot number next to the key instead of all being NULL;
* the unique side is reduced before the shuffle (see ``versions``, ``distinct_keys``);
* a hot but real key on the large side is split by adaptive skew handling, which only has
  to replicate the unique side's single row. It works on joins of two exchanges, so the
  unique side, small by then, is always exchanged once more.

Broadcasting is left to Spark, which checks the size.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, functions as F

from concilia.functions.prepare import normalise
from concilia.functions.text import is_blank, is_present
from concilia.operators.versions import first_per_key, latest_version
from concilia.vocabulary import KEY_CCO_COMPATIBLE, KEY_CODE_BIRTH, KEY_CPF_BIRTH

_SLOTS = 1 << 20


def lookup(
    left: DataFrame,
    right: DataFrame,
    keys: Mapping[str, str],
    how: str = "left",
    when: Column | None = None,
    spread_by: str | Sequence[str] = "id",
) -> DataFrame:
    """Join ``left`` to a ``right`` that is unique on its keys.

    ``keys`` maps left to right column names. ``when`` restricts the left rows the lookup
    applies to. ``how`` is ``inner``, ``left_semi``, ``left`` or ``left_anti``; the last two
    keep the rows the lookup does not apply to, dealt out by the columns ``spread_by``.
    """
    spread_by = [spread_by] if isinstance(spread_by, str) else list(spread_by)
    usable = reduce(and_, [F.col(k).isNotNull() for k in keys])
    if when is not None:
        usable = usable & F.coalesce(when, F.lit(False))
    rights = list(keys.values())
    # Always 0, in a form the planner keeps as a join key: the unique side then gets an
    # exchange of its own right below the join, which adaptive skew handling requires.
    # Left rows the lookup does not apply to have another slot, so they match nothing.
    one_slot = F.pmod(F.xxhash64(*[F.col(r) for r in rights]), F.lit(1))
    unique = right.withColumn("_slot_r", one_slot)
    applies = F.pmod(F.xxhash64(*[F.col(k) for k in keys]), F.lit(1))
    if how in ("inner", "left_semi"):
        rows = left.filter(usable).withColumn("_slot_l", applies)
    else:
        scattered = F.lit(1) + F.pmod(F.xxhash64(*spread_by), F.lit(_SLOTS))
        rows = left.withColumn("_slot_l", F.when(usable, applies).otherwise(scattered))
    condition = reduce(
        and_,
        [F.col(k) == F.col(r) for k, r in keys.items()]
        + [F.col("_slot_l") == F.col("_slot_r")],
    )
    return rows.join(unique, condition, how).drop("_slot_l", "_slot_r")


def lookup_on_layout(
    left: DataFrame, right: DataFrame, key: str, right_key: str, how: str = "left", hottest: int = 64
) -> DataFrame:
    """``lookup`` by one key that leaves ``right`` where it lies.

    For a ``right`` whose table is bucketed by its key (``sinks.save_bucketed``) and unique on
    it: only ``left`` is moved, to the buckets. What ``lookup`` does with slots, which would
    move both sides, is done for hot keys alone: the ``hottest`` keys of ``left`` are found
    with a sketch, and their rows are joined where they are with the at most ``hottest`` rows
    of ``right`` they meet, which are broadcast. The sketch decides the way, not the result.
    Rows without a key meet nothing and are not moved. ``how`` is ``inner`` or ``left``.
    """
    if how not in ("inner", "left"):
        raise ValueError(f"how must be inner or left, not {how!r}")
    known = left.filter(F.col(key).isNotNull())
    found = known.agg(
        F.expr(f"approx_top_k({key}, {hottest}, {100 * hottest})").alias("top"), F.count(F.lit(1)).alias("n")
    ).first()
    share = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions")) * 2
    hot = [top["item"] for top in found["top"] or [] if top["count"] * share > found["n"]]
    is_hot = F.col(key).isin(hot) if hot else F.lit(False)
    condition = F.col(key) == F.col(right_key)
    out = known.filter(~is_hot).join(right, condition, how)
    if hot:
        few = right.filter(F.col(right_key).isin(hot))
        out = out.unionByName(known.filter(is_hot).join(F.broadcast(few), condition, how))
    if how == "left":
        nothing = [F.lit(None).cast(f.dataType).alias(f.name) for f in right.schema]
        out = out.unionByName(left.filter(F.col(key).isNull()).select("*", *nothing))
    return out


def distinct_keys(df: DataFrame, *columns: str) -> DataFrame:
    return df.select(*columns).dropna().distinct()


def _tier_keys(rows: DataFrame, cco: str, code: str, cpf: str, birth: str) -> DataFrame:
    """``tier, t1, t2``: the distinct keys of all three tiers, from one scan and one exchange."""
    def key(tier: int, first: str, second: Column) -> Column:
        known = F.col(first).isNotNull() & second.isNotNull()
        return F.when(known, F.struct(F.lit(tier).alias("tier"), F.col(first).alias("t1"), second.cast("string").alias("t2")))

    keys = F.array_compact(F.array(key(1, cco, F.lit("")), key(2, code, F.col(birth)), key(3, cpf, F.col(birth))))
    return rows.select(F.explode(keys).alias("k")).select("k.*").distinct()


def _without_tier(
    rows: DataFrame, keys: DataFrame, cco: str, code: str, cpf: str, birth: str, spread_by: str | Sequence[str]
) -> DataFrame:
    """Rows that no tier they may use finds among ``keys``.

    A row with a CCO has one tier; others look by code + birth, then by CPF + birth. All
    rows look up their first tier in one join; only those it did not find, and that have
    another, go on, to the same set of keys.
    """
    c, own = F.col, rows.columns
    tier = lambda name: F.coalesce(c(name) != "", F.lit(False)) & c(birth).isNotNull()
    with_cco = F.coalesce(c(cco), F.lit("")) != ""
    by_code, by_cpf = ~with_cco & tier(code), ~with_cco & tier(cpf)
    marked = rows.withColumns({
        "_tier": F.when(with_cco, 1).when(by_code, 2).when(by_cpf, 3),
        "_t1": F.when(with_cco, c(cco)).when(by_code, c(code)).when(by_cpf, c(cpf)),
        "_t2": F.when(with_cco, F.lit("")).when(by_code | by_cpf, c(birth).cast("string")),
        "_next": F.when(by_code & by_cpf, F.lit(3)),
    })
    names = {"tier": "k_tier", "t1": "k_t1", "t2": "k_t2"}
    keys = keys.select(*[c(old).alias(new) for old, new in names.items()])
    first = lookup(marked, keys, {"_tier": "k_tier", "_t1": "k_t1", "_t2": "k_t2"}, "left_anti", spread_by=spread_by)
    second = lookup(
        first.withColumn("_t1", c(cpf)), keys, {"_next": "k_tier", "_t1": "k_t1", "_t2": "k_t2"}, "left_anti", spread_by=spread_by
    )
    return second.select(*own)


def members_absent_from_registry(members: DataFrame, registry: DataFrame) -> DataFrame:
    """Members no tier finds in the registry. Prepared inputs.

    A member with a CCO (blanks count as one here) is looked for by CCO only; the other
    two tiers, code + birth and CPF + birth, serve members without any.
    """
    keys = _tier_keys(registry, "r_codcco", "r_codusu", "r_cpfusu", "r_birth")
    return _without_tier(members, keys, "codcco", "codans", "cpfusu", "nascusu", "id")


def registry_without_member(registry: DataFrame, members: DataFrame) -> DataFrame:
    """Registry rows no tier finds among the members: the mirror of the one above."""
    spread = ("r_numseq", "r_nomeusu", "r_cpfusu")  # an unknown sequence alone is one place
    keys = _tier_keys(members, "codcco", "codans", "cpfusu", "nascusu")
    return _without_tier(registry, keys, "r_codcco", "r_codusu", "r_cpfusu", "r_birth", spread)


REGISTRY_VIEW = (
    "r_numseq", "r_status", "r_codcco", "r_codusu", "r_nomeusu", "r_cpfusu", "r_nascusu",
    "r_dataini", "r_datafim",
)


def newest_rows(registry: DataFrame, keys: Sequence[str], *extra: str) -> DataFrame:
    """Newest version per key with the columns results show, normalised. Prepared registry.

    Only the table's own columns and the keys are moved; everything that can be derived is
    derived again for the rows that are kept.
    """
    own = [*REGISTRY_VIEW, *extra]
    rows = registry.select(*own, *[k for k in keys if k not in own])
    return normalise(latest_version(rows, keys))


def tiered_match(
    members: DataFrame, registry: DataFrame, compatible: Column, status: str | Column
) -> DataFrame:
    """Members matched to a registry row of ``status``, by the first key that finds one.

    CCO (newest version must have the status and not contradict the member); then, for
    members without CCO, the newest row of that status by code + birth or CPF + birth,
    whichever is newer. Adds ``chave_usada``. ``status`` may differ per member: it is part
    of the key, so one pass over the registry per key serves all of them.
    """
    status = F.lit(status) if isinstance(status, str) else status
    wanted = members.withColumn("_status", status).filter(F.col("_status").isNotNull())
    newest = newest_rows(registry.filter(is_present("r_codcco")), ["r_codcco"])
    by_cco = (
        lookup(wanted, newest, {"codcco": "r_codcco"}, "inner")
        .filter((F.col("r_state") == F.col("_status")) & compatible)
        .withColumn("chave_usada", F.lit(KEY_CCO_COMPATIBLE))
    )

    no_cco = wanted.filter(is_blank("codcco"))
    by_code = lookup(
        no_cco.filter(is_present("codans")),
        newest_rows(registry, ["r_codusu", "r_birth", "r_state"]),
        {"codans": "r_codusu", "nascusu": "r_birth", "_status": "r_state"},
        "inner",
    )
    by_cpf = lookup(
        no_cco.filter(is_present("cpfusu")),
        newest_rows(registry, ["r_cpfusu", "r_birth", "r_state"]),
        {"cpfusu": "r_cpfusu", "nascusu": "r_birth", "_status": "r_state"},
        "inner",
    )
    # At most two candidates per member.
    other = first_per_key(
        by_code.unionByName(by_cpf), ["id"], [F.col("r_numseq").desc_nulls_first()]
    ).withColumn(
        "chave_usada",
        F.when(
            is_present("codans") & (F.col("r_codusu") == F.col("codans")), F.lit(KEY_CODE_BIRTH)
        ).otherwise(F.lit(KEY_CPF_BIRTH)),
    )
    return by_cco.unionByName(other).drop("_status")


def identities(registry: DataFrame, *extra: str) -> DataFrame:
    """Newest registry row per name, birth, start and CPF digits. Prepared registry."""
    keys = ["r_name", "r_birth", "r_start", "r_digits"]
    return newest_rows(registry.filter("r_name <> ''"), keys, *extra)


def with_identities(members: DataFrame, newest: DataFrame) -> DataFrame:
    return lookup(
        members.filter("m_name <> ''"),
        newest,
        {"m_name": "r_name", "nascusu": "r_birth", "dataini": "r_start", "m_digits": "r_digits"},
        "inner",
    )


def identity_match(members: DataFrame, registry: DataFrame, *extra: str) -> DataFrame:
    """Newest registry row with the same name, birth, start and CPF digits (both may lack a CPF)."""
    return with_identities(members, identities(registry, *extra))
