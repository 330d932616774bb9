"""Detection and redaction of personal data as one column expression."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import unicode_regex


@dataclass(frozen=True)
class Detector:
    type: str
    pattern: str
    shortest: int  # characters of the shortest match
    hint: str = ""  # matches some part of every match; cheaper than the pattern
    needs: str = ""  # a literal every match contains

    @property
    def regex(self) -> str:
        return unicode_regex(self.pattern)

    @property
    def token(self) -> str:
        return f"[REDACTED-{self.type.upper()}]"


# What ``[\s-]`` stands for, spelled out: a Unicode flag would slow every class of a hint down.
_GAP = r"[\t-\r\x1c-\x1f\x85\p{Z}-]"

# The patterns, in the order they are applied; every one reads what
# the earlier ones have left.  A pattern that looks behind names its first character before.
DETECTORS = (
    Detector("emirates_id", r"784[-\s]?\d{4}[-\s]?\d{7}[-\s]?\d", 15, needs="784"),
    Detector("iban", r"\b[A-Z]{2}\d{2}[A-Z0-9]{11,28}\b", 15, r"[A-Z]{2}\p{Nd}{2}[A-Z0-9]{11}"),
    Detector("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", 6, needs="@"),
    Detector("phone", r"(?=\+)(?<![\w+-])\+\d{6,15}(?!\d)", 7, r"\+\p{Nd}{6}", "+"),
    Detector(
        "phone",
        r"(?=0)(?<![\w.\-])0[\s-]?5[024568](?:[\s-]?\d){7}(?!\d)",
        10,
        rf"0{_GAP}?5[024568]{_GAP}?\p{{Nd}}",
    ),
    Detector(
        "phone",
        r"(?=[+(\d])(?<![\w-])(?:\+\d{1,3}[\s-]?)?(?:\(\d{2,4}\)|\d{2,4})[\s-]\d{3}[\s-]?\d{3,4}(?!\d)",
        9,
        rf"{_GAP}(?<=[\p{{Nd}})]{_GAP})\p{{Nd}}{{3}}",
    ),
)
PII_TYPES = tuple(sorted({d.type for d in DETECTORS}))

# ``detector`` is the place in the list above: whole texts report detector by detector.
FINDING = "array<struct<type:string,preview:string,detector:int>>"


PREVIEW = "CASE WHEN length(m) > 4 THEN concat(substring(m, 1, 4), '***') ELSE '***' END"


def scan(text: str) -> Column:
    """``struct<redacted string, findings array<struct<type, preview>>>`` of the
    SQL expression ``text``, usually a column name.

    The detectors are folded one after the other over the whole text.  A state
    is bound to a lambda variable, so each step is evaluated once.  A text
    without any detector's hint cannot match any of them and skips the fold.
    """
    return F.expr(scan_sql(text))


def scan_sql(text: str) -> str:
    start = f"struct({text} AS redacted, CAST(array() AS {FINDING}) AS findings)"
    state = start
    for number, detector in enumerate(DETECTORS):
        s = f"s{number}"
        state = f"get(transform(array({state}), {s} -> {_step(number, detector, s)}), 0)"
    # One search for each hint: an alternation of them is tried anew at every character.
    hinted = " OR ".join(f"({_hinted(d, text)})" for d in DETECTORS)
    return f"CASE WHEN {hinted} THEN {state} ELSE {start} END"


def _hinted(detector: Detector, text: str) -> str:
    tests = [f"length({text}) >= {detector.shortest}"]
    if detector.needs:
        tests.append(f"contains({text}, '{detector.needs}')")
    if detector.hint:
        tests.append(f"regexp_like({text}, r'{detector.hint}')")
    return " AND ".join(tests)


def _step(number: int, detector: Detector, s: str) -> str:
    regex = f"r'{detector.regex}'"
    hit = f"{_hinted(detector, f'{s}.redacted')} AND regexp_like({s}.redacted, {regex})"
    return (
        f"CASE WHEN {hit} THEN struct("
        f"regexp_replace({s}.redacted, {regex}, '{detector.token}') AS redacted,"
        f" concat({s}.findings, transform(regexp_extract_all({s}.redacted, {regex}, 0),"
        f" m -> struct('{detector.type}' AS type, {PREVIEW} AS preview, {number} AS detector))) AS findings)"
        f" ELSE {s} END"
    )
