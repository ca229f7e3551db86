"""Scalar text expressions over a named column.

Each is one built-in SQL expression, so it stays inside generated code and costs one call
to build. None needs Python at run time.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def trimmed(name: str) -> str:
    return f"coalesce(trim({name}), '')"


def is_blank(name: str) -> Column:
    """NULL, empty, or nothing but spaces. Never NULL itself."""
    return F.expr(f"{trimmed(name)} = ''")


def is_present(name: str) -> Column:
    return F.expr(f"{trimmed(name)} <> ''")


def nullif_blank(name: str) -> Column:
    return F.expr(f"nullif(trim({name}), '')")


def first_present(*names: str) -> Column:
    """First non-blank value, trimmed; empty text when there is none."""
    return F.expr(f"coalesce({', '.join(f'''nullif(trim({n}), '')''' for n in names)}, '')")


def upper_trim(name: str) -> Column:
    """Text for case-insensitive comparison; NULL counts as empty."""
    return F.expr(f"upper({trimmed(name)})")


def digits_only(name: str) -> Column:
    return F.expr(f"regexp_replace(coalesce({name}, ''), '[^0-9]', '')")


def alnum_upper(name: str) -> Column:
    return F.expr(f"upper(regexp_replace(coalesce({name}, ''), '[^0-9A-Za-z]', ''))")


def is_cpf(name: str) -> Column:
    """Exactly eleven digits. ``\\z`` because ``$`` would accept a trailing newline."""
    return F.col(name).rlike(r"^[0-9]{11}\z")


def has_digit(name: str) -> Column:
    return F.col(name).rlike("[0-9]")


def has_illegal_character(name: str) -> Column:
    """Anything but letters of any alphabet, white space, apostrophe and hyphen."""
    return F.col(name).rlike(r"[^\p{L}\s'\-]")


def word_count(name: str) -> Column:
    return F.size(F.split(F.expr(f"trim({name})"), r"\s+"))


def company(name: str) -> Column:
    return F.expr(f"left({name}, 4)")


def cut(name: str, length: int) -> Column:
    return F.expr(f"left(trim({name}), {int(length)})")


def compose_code(contract: str, number: str) -> Column:
    """``contract-number`` cut to 30; NULL unless both parts are present."""
    return F.expr(
        f"case when {trimmed(contract)} <> '' and {trimmed(number)} <> ''"
        f" then left(trim({contract}) || '-' || trim({number}), 30) end"
    )


def same_name(a: str, b: str) -> Column:
    left, right = f"upper({trimmed(a)})", f"upper({trimmed(b)})"
    return F.expr(f"{left} <> '' and {left} = {right}")
