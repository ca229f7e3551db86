"""Scalar date expressions. The clock is always a parameter, never ``current_date``."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from concilia.vocabulary import NO_DATE


def parse_two_format_date(name: str) -> Column:
    """``YYYY-MM-DD`` or ``DD/MM/YYYY`` text to a date.

    Blank, other shapes and impossible days (31/02) give NULL.
    """
    text = F.trim(F.col(name))
    iso = text.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}\z")
    local = text.rlike(r"^[0-9]{2}/[0-9]{2}/[0-9]{4}\z")
    turned = F.concat(text.substr(7, 4), F.lit("-"), text.substr(4, 2), F.lit("-"),
                      text.substr(1, 2))
    # A cast reads ISO text without a formatter, which is several times faster.
    return F.when(iso, text.try_cast("date")).when(local, turned.try_cast("date"))


def deadline_passed(name: str, as_of: Column) -> Column:
    """The month of a start is reported until day 5 of the next; no start counts as passed."""
    start = F.col(name)
    return start.isNull() | (as_of > F.date_add(F.last_day(start), 5))


def older_than_days(name: str, as_of: Column, days: int) -> Column:
    return F.col(name) < F.date_sub(as_of, days)


def br_date_text(name: str) -> Column:
    return F.coalesce(F.date_format(F.col(name), "dd/MM/yyyy"), F.lit(NO_DATE))
