from datetime import date

import pytest
from pyspark.sql import functions as F

from concilia.functions import (
    alnum_upper, br_date_text, compose_code, cut, deadline_passed, digits_only, first_present,
    has_illegal_character, is_blank, is_cpf, is_present, nullif_blank, older_than_days,
    parse_two_format_date, same_name, word_count,
)


def one(spark, value, expression, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(expression.alias("y")).first().y


@pytest.mark.parametrize("text, day", [
    ("2001-02-28", date(2001, 2, 28)), ("28/02/2001", date(2001, 2, 28)),
    (" 28/02/2001 ", date(2001, 2, 28)), ("2001-02-30", None), ("31/02/2001", None),
    ("28-02-2001", None), ("2001-02-28\n", None), ("28/02/2001\n", None), ("", None),
    ("  ", None), (None, None), ("2001-2-8", None), ("texto", None),
])
def test_two_format_date(spark, text, day):
    assert one(spark, text, parse_two_format_date("x")) == day


@pytest.mark.parametrize("text, blank", [
    (None, True), ("", True), ("   ", True), (" ", False), ("\t", False), ("a", False),
])
def test_blank(spark, text, blank):
    assert one(spark, text, is_blank("x")) is blank
    assert one(spark, text, is_present("x")) is not blank
    assert (one(spark, text, nullif_blank("x")) is None) is blank


@pytest.mark.parametrize("text, good", [
    ("12345678901", True), ("1234567890", False), ("123.456.789-01", False),
    (" 12345678901", False), ("12345678901\n", False), ("1234567890a", False),
])
def test_cpf(spark, text, good):
    assert one(spark, text, is_cpf("x")) is good


@pytest.mark.parametrize("text, illegal", [
    ("JOSÉ D'ÁVILA", False), ("ANA-MARIA  LIMA", False), ("ANA 2", True), ("ANA#", True),
    ("Ñandú Ç", False), ("A.B", True),
])
def test_illegal_characters(spark, text, illegal):
    assert one(spark, text, has_illegal_character("x")) is illegal


@pytest.mark.parametrize("text, words", [("MARIA", 1), (" MARIA ", 1), ("MARIA  LIMA", 2)])
def test_words(spark, text, words):
    assert one(spark, text, word_count("x")) == words


def test_normal_forms(spark):
    assert one(spark, " 12.3-a ", digits_only("x")) == "123"
    assert one(spark, None, digits_only("x")) == ""
    assert one(spark, "rg-1 x", alnum_upper("x")) == "RG1X"
    assert one(spark, "  " + "n" * 90, cut("x", 80)) == "n" * 80
    row = spark.createDataFrame([(" ", "b ", "00", None)], "a string, b string, c string, d string")
    out = row.select(
        first_present("a", "b").alias("first"), first_present("a").alias("none"),
        compose_code("b", "c").alias("code"), compose_code("a", "c").alias("no_code"),
        compose_code("b", "d").alias("null_code"), same_name("a", "a").alias("blank_names"),
        same_name("b", "b").alias("same"),
    ).first()
    assert out.asDict() == {
        "first": "b", "none": "", "code": "b-00", "no_code": None, "null_code": None,
        "blank_names": False, "same": True,
    }


@pytest.mark.parametrize("start, as_of, passed", [
    (date(2026, 10, 1), "2026-11-05", False), (date(2026, 10, 1), "2026-11-06", True),
    (date(2026, 10, 31), "2026-11-05", False), (date(2026, 10, 31), "2026-11-06", True),
    (date(2026, 12, 15), "2027-01-05", False), (None, "2026-11-05", True),
])
def test_deadline(spark, start, as_of, passed):
    expression = deadline_passed("x", F.lit(as_of).cast("date"))
    assert one(spark, start, expression, "date") is passed


def test_age_and_text_of_days(spark):
    day = F.lit("2001-10-31").cast("date")
    assert one(spark, date(2001, 8, 2), older_than_days("x", day, 90), "date") is False
    assert one(spark, date(2001, 8, 1), older_than_days("x", day, 90), "date") is True
    assert one(spark, None, br_date_text("x"), "date") == "(sem data)"
    assert one(spark, date(2001, 8, 2), br_date_text("x"), "date") == "02/08/2001"
