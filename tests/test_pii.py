"""Detection and redaction: known cases, and what whole documents keep."""

import re

from pyspark.sql import functions as F

from gristmill.functions.pii import DETECTORS, scan
from gristmill.operators.redact import redact_fields

SF = "/root/testdata/sf0.001"


def scanned(spark, texts):
    return spark.createDataFrame([(t,) for t in texts], "text string").withColumn("s", scan("text")).collect()


TEXTS = [
    "Ring the desk at +971 50 664 2083 today",
    "Contact lena.v@heronpaper.example, IBAN AE460090000000123456789, Emirates ID 784-1987-5550123-4",
    "Reach me on 055-310-7729", "0501234567", "+971501234567", "x+971501234567", "-055-310-7729",
    "Invoice HPW-31-01 dated 2026-08-01 for AED 3,915.00",
    "id 784199012345671 784 1990 1234567 1 1784199012345671",
    "(04) 321-4567 and +1 (212) 555-0100 and 04\n321\n4567",
    "12345 050 123 4567 8", "0501234567.", ".0501234567", "a@b.co,c@d.e,e@f.museum", "A@B@c.de",
    "XAE460090000000123456789 AE460090000000123456789_", "é0501234567 ٠٥٠١٢٣٤٥٦٧ +٩٧١٥٠١٢٣٤٥٦٧ ٠٤ ٣٢١ ٤٥٦٧",
    "$1 \\1 a@b.co \\", "", "   ", "no digits", "\x1c055\x1c987\x1c6543", "055 987 6543", "²055-310-7729", "á055-310-7729",
]


# Text, what is left of it, and the findings in scan order.
CASES = [
    ("Ring the desk at +971 50 664 2083 today", "Ring the desk at [REDACTED-PHONE] today", ["phone:+971***"]),
    (
        "Write lena.v@heronpaper.example, IBAN AE460090000000123456789, card 784-1987-5550123-4",
        "Write [REDACTED-EMAIL], IBAN [REDACTED-IBAN], card [REDACTED-EMIRATES_ID]",
        ["emirates_id:784-***", "iban:AE46***", "email:lena***"],
    ),
    ("0501234567", "[REDACTED-PHONE]", ["phone:0501***"]),
    ("x+971501234567", "x+971501234567", []),
    ("Order HPW-31-01 dated 2026-08-01 for AED 3,915.00", "Order HPW-31-01 dated 2026-08-01 for AED 3,915.00", []),
    ("1784199012345671", "1[REDACTED-EMIRATES_ID]", ["emirates_id:7841***"]),
    ("(04) 321-4567", "[REDACTED-PHONE]", ["phone:(04)***"]),
    ("0501234567.", "[REDACTED-PHONE].", ["phone:0501***"]),
    (".0501234567", ".0501234567", []),
    ("a@b.co,c@d.e,e@f.museum", "[REDACTED-EMAIL],c@d.e,[REDACTED-EMAIL]", ["email:a@b.***", "email:e@f.***"]),
    ("055\n987\n6543", "[REDACTED-PHONE]", ["phone:055\n***"]),
    ("", "", []),
    ("no digits", "no digits", []),
]


def test_known_cases(spark):
    rows = {r["text"]: r["s"] for r in scanned(spark, [t for t, _, _ in CASES])}
    for text, redacted, findings in CASES:
        assert rows[text]["redacted"] == redacted, text
        assert [f"{f['type']}:{f['preview']}" for f in rows[text]["findings"]] == findings, text


def test_whole_documents_lose_only_what_was_found(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("text")
    turns = spark.read.parquet(f"{SF}/conversations.parquet").select("text")
    rows = docs.unionByName(turns).withColumn("s", scan("text")).collect() + scanned(spark, TEXTS)
    assert any(r["s"]["findings"] for r in rows)
    token = re.compile(r"\[REDACTED-([A-Z_]+)\]")
    for r in rows:
        kept, types = token.split(r["s"]["redacted"])[::2], token.findall(r["s"]["redacted"])
        assert sorted(t.lower() for t in types) == sorted(f["type"] for f in r["s"]["findings"])
        assert re.fullmatch("(?s)" + ".+".join(map(re.escape, kept)), r["text"])
        assert not any(re.search(d.pattern, piece) for d in DETECTORS[:3] for piece in kept)


def test_null_text(spark):
    (row,) = scanned(spark, [None])
    assert row["s"]["redacted"] is None and row["s"]["findings"] == []


def test_previews_never_hold_the_value(spark):
    for row in scanned(spark, TEXTS):
        assert all(len(f["preview"]) <= 7 and "***" in f["preview"] for f in row["s"]["findings"])


def test_records_only_string_fields(spark):
    rows = spark.createDataFrame(
        [("f", "call 055-310-7729", 42.5, None, "a@b.co")], "source_file string, body string, amount double, note string, mail string"
    )
    (r,) = redact_fields(rows).collect()
    assert (r["body"], r["amount"], r["note"], r["mail"]) == ("call [REDACTED-PHONE]", 42.5, None, "[REDACTED-EMAIL]")
    assert [f["type"] for f in r["findings"]] == ["phone", "email"]


def test_skipped_fields_keep_their_value(spark):
    rows = spark.createDataFrame([("2026-07-01", False), ("055-310-7729", True)], "date string, bad boolean")
    out = redact_fields(rows, ["date"], {"date": "NOT bad"}).orderBy(F.col("bad")).collect()
    assert [r["date"] for r in out] == ["2026-07-01", "[REDACTED-PHONE]"]


def test_shortest_matches_pass_their_hints(spark):
    """Each detector's shortest match, alone and between others' characters, is found behind the cheap tests."""
    shortest = {
        "784199012345671": 15, "AE07ABCDEFGHIJK": 15, "a@b.cc": 6, "+123456": 7, "0501234567": 10, "12 345678": 9,
        "12\u2003345678": 9, "(12)\x1c345\u00a06789": 8, "0\u30005\u0660": 0, "A@b.c": 0, "+12345": 0,
    }
    expected = {t for t in shortest if shortest[t]}
    rows = spark.createDataFrame([(t,) for t in shortest], "t string").select("t", scan("t").alias("s")).collect()
    assert {r.t for r in rows if r.s.findings} == expected
    assert [d.shortest for d in DETECTORS] == [15, 15, 6, 7, 10, 9]
    around = spark.createDataFrame([(f"x, {t} .",) for t in expected], "t string").select(scan("t").alias("s"))
    assert all(r.s.findings for r in around.collect())
