"""Header plans, row repair, duplicates, logs."""

from pyspark.sql import functions as F

from gristmill.contracts import TRANSACTIONS
from gristmill.operators.profile import drift, profile
from gristmill.operators.repair import (
    Feed, deduplicate, feed_facts, plan_header, plan_table, repair_and_redact, row_issues,
)

CONTRACT = TRANSACTIONS.columns


def feed(spark, header, rows, name="f.csv"):
    cols = [f"c{i}" for i in range(len(header))]
    data = [(name, i, *r) for i, r in enumerate(rows)]
    df = spark.createDataFrame(data, "file string, pos bigint, " + ", ".join(f"{c} string" for c in cols))
    made = Feed.of(df, F.col("file"), F.col("pos"), cols)
    return Feed(made.df, tuple(header))


def run(spark, *feeds):
    rows = repair_and_redact(feeds, TRANSACTIONS)
    records = deduplicate(rows, TRANSACTIONS)
    facts = feed_facts(records, plan_table(spark, [f.header for f in feeds], TRANSACTIONS), TRANSACTIONS)
    issues = row_issues(rows, TRANSACTIONS).orderBy("source_file", "stage", "pos")
    return records.orderBy("source_file", "pos").collect(), facts.orderBy("source_file").collect(), issues.collect()


def test_known_drift_is_repaired(spark):
    header = ("transaction_id", "transaction_date", "amount_aed", "merchant_name", "category")
    records, (facts,), issues = run(spark, feed(spark, header, [
        ("T-1", "03/07/2026", "1,150.00", "Noon.com", "electronics"),
        ("T-2", "05/07/2026", "89.50", "Careem", "transport"),
        ("T-2", "05/07/2026", "89.50", "Careem", "transport"),
    ]))
    assert [tuple(r[c] for c in CONTRACT) for r in records] == [
        ("T-1", "2026-07-03", 1150.0, "AED", "Noon.com", "electronics"),
        ("T-2", "2026-07-05", 89.5, "AED", "Careem", "transport"),
    ]
    assert issues == [] and facts["confidence"] == 1.0 and facts["method"] == "csv+fixers"
    assert facts["fixes"] == [
        "renamed column 'amount_aed' -> 'amount'", "renamed column 'merchant_name' -> 'merchant'",
        "renamed column 'transaction_date' -> 'date'", "renamed column 'transaction_id' -> 'txn_id'",
        "filled missing column 'currency' with default 'AED'", "normalised 3 value(s) in 'date' to ISO dates",
        "coerced 1 value(s) in 'amount' to numeric", "dropped 1 exact duplicate row(s)",
    ]


def test_unfixable_values_are_reported(spark):
    _, (facts,), issues = run(spark, feed(spark, ("transaction_id", "amount"), [("T-1", "n/a"), ("T-2", None), ("T-3", "7")]))
    assert [i["issue"] for i in issues] == [
        "unparseable number 'n/a' in column 'amount'", "unparseable number 'None' in column 'amount'",
    ]
    assert facts["plan_issues"] == [
        "missing required column 'date' with no known default", "missing required column 'merchant' with no known default",
    ]
    assert (facts["n_issues"], facts["confidence"], facts["n_records"], facts["present"]) == (4, 0.5, 3, 5)


def test_agreed_header_keeps_duplicates_and_cleans_values(spark):
    row = ("T-1", "05/04/2026", "1,200.50", "AED", "Acme", "general")
    records, (facts,), _ = run(spark, feed(spark, CONTRACT, [row, row]))
    assert len(records) == 2 and records[0]["amount"] == 1200.5 and records[0]["date"] == "2026-04-05"
    assert facts["method"] == "csv+coerce"
    assert facts["branch_audit"][1] == "fix: schema matches baseline; 2 value normalisation(s), 0 unfixed"


def test_plain_header_and_values_need_no_fix(spark):
    _, (facts,), _ = run(spark, feed(spark, CONTRACT[::-1], [("g", "m", "AED", "240.00", "2026-06-02", "T-1")]))
    assert facts["fixes"] == [] and facts["method"] == "csv" and facts["confidence"] == 1.0


def test_last_of_colliding_columns_wins(spark):
    header = ("txn_id", "date", "txn_date", "amount", "merchant", "amount")
    records, _, _ = run(spark, feed(spark, header, [("T", "2026-01-01", "2026-02-02", "1", "m", "2")]))
    assert records[0]["date"] == "2026-02-02" and records[0]["amount"] == 2.0


def test_implied_currency(spark):
    plan = plan_header(("txn_id", "date", "Amount_USD", "merchant", "category"), TRANSACTIONS)
    assert plan.fills == {"currency": "USD"}
    plan = plan_header(("txn_id", "date", "amount_usd", "currency", "merchant", "category"), TRANSACTIONS)
    assert plan.fills == {}


def test_extra_columns_are_dropped_in_one_line(spark):
    plan = plan_header((*CONTRACT, "zeta", "Alpha"), TRANSACTIONS)
    assert plan.log == ("dropped unexpected column(s): Alpha, zeta",)


def test_rows_that_differ_only_in_personal_data_stay_apart(spark):
    header = ("transaction_id", "date", "amount", "merchant", "category")
    rows = [("T", "2026-01-01", "1", m, "c") for m in ("call 055-987-6543", "call 055-987-6544", "call 055-987-6543")]
    records, (facts,), _ = run(spark, feed(spark, header, rows))
    assert [r["merchant"] for r in records] == ["call [REDACTED-PHONE]"] * 2
    assert facts["n_findings"] == 2 and facts["pii_types"] == ["phone"]


def test_duplicates_are_per_file_and_many_copies_combine(spark):
    header = ("transaction_id", "date", "amount", "merchant", "category")
    rows = [("T", "2026-01-01", "1", "m", "c")] * 300
    records, facts, _ = run(spark, feed(spark, header, rows, "a.csv"), feed(spark, header, rows, "b.csv"))
    assert [r["source_file"] for r in records] == ["a.csv", "b.csv"]
    assert [f["fixes"][-1] for f in facts] == ["dropped 299 exact duplicate row(s)"] * 2


def test_values_equal_after_repair_are_duplicates_and_all_are_counted(spark):
    header = ("transaction_id", "date", "amount", "merchant", "category")
    rows = [("T", "2026-01-01", "1", "m", "c"), ("T", "01/01/2026", "AED 1", "m", "c")]
    records, (facts,), _ = run(spark, feed(spark, header, rows))
    assert len(records) == 1
    assert facts["fixes"][-3:] == [
        "normalised 1 value(s) in 'date' to ISO dates", "coerced 1 value(s) in 'amount' to numeric",
        "dropped 1 exact duplicate row(s)",
    ]


def test_unparsed_value_with_personal_data_is_redacted_in_the_issue(spark):
    records, (facts,), issues = run(spark, feed(spark, CONTRACT, [("T", "055-987-6543", "056-987-6543", "AED", "m", "c")]))
    assert [i["issue"] for i in issues] == [
        "unparseable date '[REDACTED-PHONE]' in column 'date'", "unparseable number '[REDACTED-PHONE]' in column 'amount'",
    ]
    assert facts["n_findings"] == 2 and facts["present"] == 3


def test_profile(spark):
    (row,) = profile(feed(spark, ("a", "b"), [("1", ""), ("2", "x"), (" \t", None)])).collect()
    assert row["row_count"] == 3 and row["columns"] == ["a", "b"] and row["null_rates"] == {"a": 0.333, "b": 0.667}


def test_drift(spark):
    rows = spark.createDataFrame([(list(CONTRACT[::-1]),), (["transaction_id", "amount"],)], "c array<string>")
    same, other = [r["d"] for r in rows.select(drift(F.col("c"), TRANSACTIONS).alias("d")).collect()]
    assert not same["has_drift"] and same["missing_columns"] == []
    assert other["has_drift"] and other["unexpected_columns"] == ["transaction_id"]
    assert other["missing_columns"] == ["category", "currency", "date", "merchant", "txn_id"]
