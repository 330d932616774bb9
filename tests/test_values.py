"""Dates, numbers, rounding, number text, classification."""

import pytest
from pyspark.sql import functions as F

from gristmill.functions.coerce import coerce_date, coerce_number, is_plain_number
from gristmill.functions.text import plain_double, round_half_even, strip
from gristmill.operators.classify import file_type, looks_like_mail


def apply(spark, values, type_, expr):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {type_}")
    return [r["out"] for r in rows.select("i", expr(F.col("v")).alias("out")).orderBy("i").collect()]


def test_dates(spark):
    cases = {
        "2026-07-16": "2026-07-16",
        "16/07/2026": "2026-07-16",
        "16-07-2026": "2026-07-16",
        "2026/7/3": "2026-07-03",
        "3  jul 2026": "2026-07-03",
        "\t5/4/2026  ": "2026-04-05",
        "29/02/2024": "2024-02-29",
        "29/02/2025": None,
        "30/02/2026": None,
        "003/07/2026": None,
        "2026-13-01": None,
        "2026-07-16T00:00": None,
        "12 July 2026": None,
        "not a date": None,
        "": None,
        None: None,
    }
    assert apply(spark, cases, "string", coerce_date) == list(cases.values())


def test_numbers(spark):
    cases = {
        "1,200.50": 1200.5, "AED 950": 950.0, "42": 42.0, "n/a": None, "(500)": 500.0, "1.2e3": 1.23,
        "1.200,50": 1.2005, "1200.50-": None, "5.": 5.0, "-.5": -0.5, "--5": None, ".": None, "-": None,
        "-.": None, "1.2.3": None, "": None, None: None, "inf": None,
    }
    assert apply(spark, cases, "string", coerce_number) == list(cases.values())


def test_plain_numbers(spark):
    cases = {
        "240.00": True, " 240 ": True, "1e3": True, "1_000": True, "inf": True, "-NaN": True, ".5": True, "5.": True,
        "1,150.00": False, "AED 950": False, "1__0": False, "": False, ".": False, "e3": False, None: False,
    }
    assert apply(spark, cases, "string", is_plain_number) == list(cases.values())


@pytest.mark.parametrize("digits", [2, 3])
def test_rounding_follows_the_binary_value(spark, digits):
    values = [i / 2000 for i in range(2001)] + [i / 16 for i in range(17)] + [2.675, 1 / 3, 2 / 3, 0.145]
    assert apply(spark, values, "double", lambda c: round_half_even(c, digits)) == [round(v, digits) for v in values]


def test_number_text(spark):
    values = [4520.0, 12345678.9, 1e7, 123456789012345.6, 1e16, 1.5e20, 0.001, 0.0001, 0.00012345, 1e-5, 0.0, -12345678.25]
    assert apply(spark, values, "double", plain_double) == [repr(v) for v in values]


def test_strip_removes_every_white_space(spark):
    values = ["  a b \x1c\n", "", "\x85x　"]
    assert apply(spark, values, "string", strip) == [v.strip() for v in values]


def test_classification(spark):
    mail = "From: a@b.ae\nSubject: hi\n---\nbody"
    cases = [
        ("data.csv", "", "csv"), ("DATA.CSV", "", "csv"), ("doc.pdf", "", "pdf"), ("mail.txt", mail, "email"),
        ("mail.EML", mail, "email"), ("notes.txt", "just notes", "unknown"), ("lower.txt", mail.lower(), "unknown"),
        ("late.txt", "x" * 2000 + mail, "unknown"), ("edge.txt", "x" * 1978 + "From:" + "y" * 9 + "Subject:", "email"),
        ("cut.txt", "x" * 1979 + "From:" + "y" * 9 + "Subject:", "unknown"),
        ("img.png", mail, "unknown"), ("a.csv.gz", "", "unknown"), ("csv", "", "unknown"), ("a..csv", "", "csv"),
    ]
    rows = spark.createDataFrame(cases, "name string, text string, want string")
    out = rows.select("name", "want", file_type(F.col("name"), looks_like_mail(F.col("text"))).alias("got")).collect()
    assert {r["name"]: r["got"] for r in out} == {r["name"]: r["want"] for r in out}
