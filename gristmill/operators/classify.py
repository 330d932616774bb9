"""File classification and routing: extension first, content sniff second."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Sniffed prefix length and the marks of a mailbox export.
SNIFF_CHARS = 2000
MAIL_MARKS = ("From:", "Subject:")

CONTENT_TYPES = ("csv", "pdf", "email")


def suffix(name: Column) -> Column:
    """Lower-case extension; a name that only starts with a point has none."""
    return F.lower(F.regexp_extract(name, r"(?s).(\.[^.]+)$", 1))


def looks_like_mail(text: Column) -> Column:
    head = F.substring(text, 1, SNIFF_CHARS)
    found = F.lit(True)
    for mark in MAIL_MARKS:
        found = found & head.contains(mark)
    return F.coalesce(found, F.lit(False))


def file_type(name: Column, mail: Column) -> Column:
    """``csv``, ``pdf``, ``email`` or ``unknown``; ``mail`` is the sniff result."""
    end = suffix(name)
    return (
        F.when(end == ".csv", "csv")
        .when(end == ".pdf", "pdf")
        .when(end.isin(".eml", ".txt") & mail, "email")
        .otherwise("unknown")
    )
