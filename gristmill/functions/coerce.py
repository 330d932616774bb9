"""Value repair as column expressions: dates to ISO text, numbers to doubles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import strip, strip_column

# Accepted date shapes, tried in this order (day before month).
DATE_SHAPES = (
    (r"^\d{4}-\d{1,2}-\d{1,2}$", "yyyy-M-d"),
    (r"^\d{1,2}/\d{1,2}/\d{4}$", "d/M/yyyy"),
    (r"^\d{1,2}-\d{1,2}-\d{4}$", "d-M-yyyy"),
    (r"^\d{4}/\d{1,2}/\d{1,2}$", "yyyy/M/d"),
    (r"^\d{1,2}\s+[A-Za-z]{3}\s+\d{4}$", "d MMM yyyy"),
)

# What parses as a number as it stands, without any cleaning.
_DIGITS = r"\d+(?:_\d+)*"
PLAIN_NUMBER = (
    rf"^(?i)[+-]?(?:inf(?:inity)?|nan|(?:{_DIGITS}\.?(?:{_DIGITS})?|\.{_DIGITS})(?:e[+-]?{_DIGITS})?)$"
)


def coerce_date(value: Column) -> Column:
    """ISO date text for any accepted shape, null for anything else.

    The shape test picks the one parser that can succeed, so each value is
    parsed once, and impossible dates come back null instead of failing.
    """
    text = strip_column(value)
    result = F.lit(None).cast("string")
    for shape, pattern in reversed(DATE_SHAPES):
        candidate = F.regexp_replace(text, r"\s+", " ") if " " in pattern else text
        result = F.when(
            text.rlike(shape), F.try_to_date(candidate, pattern).cast("string")
        ).otherwise(result)
    return result


def coerce_number(value: Column) -> Column:
    """Drop everything but digits, point and minus, then parse; null if it fails."""
    return F.regexp_replace(value, r"[^0-9.\-]", "").try_cast("double")


def is_plain_number(value: Column) -> Column:
    return F.coalesce(strip(value).rlike(PLAIN_NUMBER), F.lit(False))
