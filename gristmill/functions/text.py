"""String and number helpers with the text rules the records rely on."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Every code point that counts as white space when trimming.
SPACES = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)


def let(value: Column, body) -> Column:
    """Bind ``value`` once and use it many times inside ``body``."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip(text: Column) -> Column:
    """Trim all Unicode white space, not only blanks."""
    return F.btrim(text, F.lit(SPACES))


def strip_column(text: Column) -> Column:
    """The same for a column, which this names several times: no set of characters is searched where both ends are
    printable ASCII."""
    first, last = F.ascii(text), F.ascii(F.substring(text, -1, 1))
    return F.when(first.between(33, 126) & last.between(33, 126), text).otherwise(strip(text))


def is_blank(text: Column) -> Column:
    return strip(F.coalesce(text, F.lit(""))) == ""


def is_present(value: Column) -> Column:
    """Neither null nor the empty string; white space and zero count as present."""
    return F.coalesce(value.cast("string") != "", F.lit(False))


def text_or_none(value: Column) -> Column:
    return F.coalesce(value, F.lit("None"))


def unicode_regex(pattern: str) -> str:
    """Rewrite ``\\d \\w \\s`` so Java matches the same Unicode characters for
    them as the pattern's author meant, on every JDK."""
    for short, full in (
        (r"\d", r"\p{Nd}"),
        (r"[\w", r"[\p{L}\p{N}_"),
        (r"[\s", r"[\s\x1c-\x1f"),
        (r"[-\s", r"[-\s\x1c-\x1f"),
        (r"\s*", r"[\s\x1c-\x1f]*"),
    ):
        pattern = pattern.replace(short, full)
    return "(?U)" + pattern


def round_half_even(value: Column, digits: int) -> Column:
    """Round the exact binary value, ties to even.

    ``bround`` rounds the shortest decimal form, which differs when a value
    only prints as a tie (0.0005 is slightly above one half of 0.001).  The
    sign of the distance to the tie is computed exactly by splitting the value
    into two parts whose products carry no rounding error.
    """
    scale = 10**digits

    def steps(x: Column) -> Column:
        """How many half steps of the last digit, and how far off exactly."""
        high = x.cast("float").cast("double")
        half = F.rint(x * (2 * scale))
        off = (high * (2 * scale) - half) + (x - high) * (2 * scale)
        return F.struct(x.alias("x"), half.alias("half"), off.alias("off"))

    def pick(s: Column) -> Column:
        tie = (F.abs(s["half"]) % 2 == 1) & (F.abs(s["off"]) < 1e-6)
        return (
            F.when(tie & (s["off"] > 0), (s["half"] + 1) / 2)
            .when(tie & (s["off"] < 0), (s["half"] - 1) / 2)
            .otherwise(F.rint(s["x"] * scale))
        )

    # Far from a tie plain rounding is exact, and needs no variables.
    scaled = value * scale
    near = F.rint(scaled)
    # Bound to variables: nested roundings would otherwise repeat each other.
    return F.when(F.abs(scaled - near) < 0.49, near).otherwise(let(let(value, steps), pick)) / scale


def two_decimals(value: Column) -> Column:
    return F.format_string("%.2f", round_half_even(value, 2))


def plain_double(value: Column) -> Column:
    """A double as plain text: ``4520.0``, ``12345678.9``, ``1e+16``."""
    text = value.cast("string")
    digits = F.regexp_replace(text.try_cast("decimal(38,22)").cast("string"), r"0+$", "")
    expanded = F.when(digits.endswith("."), F.concat(digits, F.lit("0"))).otherwise(digits)
    mantissa = F.regexp_replace(F.substring_index(text, "E", 1), r"\.0$", "")
    exponent = F.substring_index(text, "E", -1).try_cast("int")
    scientific = F.concat(
        mantissa,
        F.when(exponent < 0, F.lit("e-")).otherwise(F.lit("e+")),
        F.lpad(F.abs(exponent).cast("string"), F.greatest(F.lit(2), F.length(F.abs(exponent).cast("string"))), F.lit("0")),
    )
    size = F.abs(value)
    return (
        F.when(~text.contains("E"), text)
        .when((size >= 1e-4) & (size < 1e16), expanded)
        .otherwise(scientific)
    )
