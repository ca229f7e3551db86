"""Normalise both tables once, before any join.

Join keys and parsed dates become plain columns, so every join downstream is an
equality of columns (hash or sort-merge). Columns nobody uses are pruned by Spark.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from concilia.functions.dates import parse_two_format_date
from concilia.functions.text import digits_only, nullif_blank, upper_trim


# Added by ``normalise``; all functions of the columns of the table.
NORMALISED = (
    "r_state", "r_cco", "r_cpf", "r_digits", "r_name", "r_birth", "r_start", "r_end",
)


def prepare_members(members: DataFrame) -> DataFrame:
    return members.withColumns({
        "m_cco": nullif_blank("codcco"),
        "m_cpf": nullif_blank("cpfusu"),
        "m_digits": digits_only("cpfusu"),
        "m_name": upper_trim("nomeusu"),
    })


def prepare_registry(registry: DataFrame) -> DataFrame:
    """Registry columns get the prefix ``r_``; keys and parsed dates are added."""
    return normalise(registry.select([F.col(c).alias(f"r_{c}") for c in registry.columns]))


def normalise(rows: DataFrame) -> DataFrame:
    """Adds the normalised columns that are missing and whose source is there."""
    sources = {
        "r_state": ("r_status", lambda c: F.trim(F.col(c))),
        "r_cco": ("r_codcco", nullif_blank),
        "r_cpf": ("r_cpfusu", nullif_blank),
        "r_digits": ("r_cpfusu", digits_only),
        "r_name": ("r_nomeusu", upper_trim),
        "r_birth": ("r_nascusu", parse_two_format_date),
        "r_start": ("r_dataini", parse_two_format_date),
        "r_end": ("r_datafim", parse_two_format_date),
    }
    there = set(rows.columns)
    return rows.withColumns({
        name: build(source) for name, (source, build) in sources.items()
        if name not in there and source in there
    })
