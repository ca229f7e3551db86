"""Predicates shared by rules.

They read a prepared member row (columns as in the table, plus ``m_*``), joined with one
prepared registry row (``r_*``) where they compare the two. Each is one SQL expression.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, functions as F

from concilia.functions.text import trimmed
from concilia.vocabulary import ACTIVE, FLAGS, FLEX, HOLDER, INACTIVE


def any_of(conditions) -> Column:
    return reduce(or_, conditions)


def same_birth() -> Column:
    return F.expr("r_birth = nascusu")


def same_start() -> Column:
    return F.expr("r_start = dataini")


def missing_mandatory() -> Column:
    """An active member lacks a field the registry requires."""
    return F.expr(
        f"situusu = '{ACTIVE}' and (m_name = '' or nascusu is null"
        f" or {trimmed('sexousu')} = '' or (m_cpf is null and {trimmed('cns')} = ''))"
    )


def mandatory_present() -> Column:
    return F.expr(
        f"m_cco is not null and m_name <> '' and nascusu is not null"
        f" and {trimmed('sexousu')} <> '' and (m_cpf is not null or {trimmed('cns')} <> '')"
    )


def registry_can_fill() -> Column:
    gaps = [
        f"({trimmed(name)} = '' and {trimmed('r_' + name)} <> '')"
        for name in ("nomeusu", "sexousu", "cpfusu", "cns", "codcco")
    ]
    return F.expr(" or ".join([*gaps, "(nascusu is null and r_birth is not null)"]))


def field_differences() -> dict[str, str]:
    """Flag name -> SQL: the local field differs from the registry row."""

    def alnum(name: str) -> str:
        return f"upper(regexp_replace(coalesce({name}, ''), '[^0-9A-Za-z]', ''))"

    def digits(name: str) -> str:
        return f"regexp_replace(coalesce({name}, ''), '[^0-9]', '')"

    def upper(name: str) -> str:
        return f"upper({trimmed(name)})"

    plan = "coalesce(nullif(trim(r_codplaport), ''), nullif(trim(r_codplaope), ''), '')"
    return {
        "ansrg": f"{alnum('rgusu')} <> {alnum('r_docident')}",
        "anscpf": "m_digits <> r_digits",
        "ansmae": f"{upper('mae')} <> {upper('r_mae')}",
        "anscns": f"{digits('cns')} <> {digits('r_cns')}",
        "ansnasc": "not (nascusu <=> r_birth)",
        "ansparentesco": f"{upper('parentesco')} <> {upper('r_parentesco')}",
        "ansnome": "m_name <> r_name",
        "ansplano": f"{upper('codplano')} <> upper({plan})",
        "ansdataini": "not (dataini <=> r_start)",
        "ansdatafim": "not (datafim <=> r_end)",
    }


def some_difference() -> Column:
    return F.expr(" or ".join(f"({d})" for d in field_differences().values()))


def some_flag_marked() -> Column:
    return F.expr(" or ".join(f"{trimmed(flag)} = '1'" for flag in FLAGS))


def exact_same_record() -> Column:
    """CCO, name, CPF, birth and start: known on both sides and equal."""
    return F.expr(
        "coalesce(m_cco = r_cco and m_name <> '' and m_name = r_name and m_cpf = r_cpf"
        " and r_birth = nascusu and r_start = dataini, false)"
    )


def compatible_keys() -> Column:
    """CPF, birth and name do not contradict each other where both sides know them."""
    return F.expr(
        "(m_cpf is null or r_cpf is null or m_cpf = r_cpf)"
        " and (nascusu is null or r_birth is null or nascusu = r_birth)"
        " and (m_name = '' or r_name = '' or m_name = r_name)"
    )


def same_member_code() -> Column:
    remote = f"upper({trimmed('r_codusu')})"
    return F.expr(
        f"upper({trimmed('codusu')}) = {remote}"
        f" or ({trimmed('codans')} <> '' and upper(trim(codans)) = {remote})"
    )


def full_identity() -> Column:
    """Name, eleven-digit CPF, birth, start and member code all agree."""
    return F.coalesce(
        F.expr(
            "m_name <> '' and m_name = r_name and length(m_digits) = 11"
            " and m_digits = r_digits and r_birth = nascusu and r_start = dataini"
        )
        & same_member_code(),
        F.lit(False),
    )


def is_holder() -> Column:
    return F.expr(f"trim(codusu) = '{HOLDER}'")


def not_inactive() -> Column:
    return F.expr(f"situusu <> '{INACTIVE}'")


def prepared_for_flex(flag: str) -> Column:
    return F.expr(f"{trimmed(flag)} = '1' and posans = '{FLEX}'")
