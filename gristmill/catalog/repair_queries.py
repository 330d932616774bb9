"""Profile, drift, value repair and feed repair over the order tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..contracts import TRANSACTIONS
from ..functions.coerce import coerce_date, coerce_number, is_plain_number
from ..operators.profile import drift, profile
from ..operators.quality import completeness, gate, verdict
from ..operators.repair import (
    Feed,
    deduplicate,
    feed_facts,
    plan_table,
    repair_and_redact,
    row_issues,
)
from ..session import spread
from .feeds import order_feeds, order_headers, order_rows, table
from .oracle_parts import ORDER_FACTS, ORDER_ROWS


def repaired_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    plans = plan_table(spark, order_headers(), TRANSACTIONS)
    return repair_and_redact(order_feeds(spark, sf_dir), TRANSACTIONS, plans)


def repaired_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicate(repaired_rows(spark, sf_dir), TRANSACTIONS)


def order_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    plans = plan_table(spark, order_headers(), TRANSACTIONS)
    return feed_facts(repaired_records(spark, sf_dir), plans, TRANSACTIONS)


def profile_null_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Null rates per month; blanks planted by key."""
    rows = table(spark, sf_dir, "orders").selectExpr(
        "concat('orders_', date_format(CAST(o_orderdate AS date), 'yyyy-MM'), '.csv') AS file",
        "o_orderkey",
        "concat('T-', o_orderkey) AS txn_id",
        "IF(o_orderkey % 7 = 0, '', o_orderpriority) AS priority",
        "IF(o_orderkey % 7 = 1, ' \t ', IF(o_orderkey % 7 = 2, NULL, o_orderstatus)) AS status",
    )
    feed = Feed.of(rows, F.col("file"), F.col("o_orderkey"), ("txn_id", "priority", "status"))
    return profile(feed).select(
        "source_file",
        "row_count",
        F.array_join("columns", ",").alias("columns"),
        *[F.col("null_rates")[c].alias(f"null_rate_{c}") for c in ("txn_id", "priority", "status")],
    )


def detect_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Header of one feed per customer, with renames, gaps, extras and another order."""
    header = F.expr(
        """CASE c_custkey % 5
             WHEN 0 THEN array('txn_id', 'date', 'amount', 'currency', 'merchant', 'category')
             WHEN 1 THEN array('category', 'merchant', 'currency', 'amount', 'date', 'txn_id')
             WHEN 2 THEN array('transaction_id', 'amount')
             WHEN 3 THEN array('TXN_ID', 'date', 'amount', 'currency', 'merchant', 'category', concat('x', c_nationkey))
             ELSE CAST(array() AS array<string>) END"""
    )
    found = table(spark, sf_dir, "customer").select("c_custkey", drift(header, TRANSACTIONS).alias("d"))
    return found.select(
        "c_custkey",
        "d.has_drift",
        F.array_join("d.missing_columns", ",").alias("missing_columns"),
        F.array_join("d.unexpected_columns", ",").alias("unexpected_columns"),
    )


def coerce_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = order_rows(spark, sf_dir).where("copy = 1")
    iso = coerce_date(F.col("date_text"))
    return rows.select(
        "k", iso.alias("iso_date"), F.coalesce(iso != F.col("date_text"), F.lit(False)).alias("changed")
    )


def coerce_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spread(table(spark, sf_dir, "lineitem")).selectExpr(
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        """CASE l_partkey % 7
             WHEN 0 THEN format_string('%.2f', l_extendedprice)
             WHEN 1 THEN format_number(l_extendedprice, 2)
             WHEN 2 THEN concat('AED ', format_string('%.2f', l_extendedprice))
             WHEN 3 THEN concat('(', format_string('%.2f', l_extendedprice), ')')
             WHEN 4 THEN concat('-', format_number(l_extendedprice, 2), ' ')
             WHEN 5 THEN concat(format_string('%.2f', l_extendedprice), '-')
             ELSE concat(' ', CAST(CAST(l_quantity AS int) AS string), 'e2') END AS v""",
    )
    return rows.select(
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        coerce_number(F.col("v")).alias("number"),
        is_plain_number(F.col("v")).alias("is_plain"),
    )


def repair_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repaired_records(spark, sf_dir).select("source_file", *TRANSACTIONS.columns)


def repair_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    fixes = order_facts(spark, sf_dir).select(
        "source_file",
        F.lit("fix").alias("part"),
        F.posexplode_outer("fixes").alias("pos", "message"),
    )
    fixes = fixes.where("message IS NOT NULL")
    issues = row_issues(repaired_rows(spark, sf_dir), TRANSACTIONS)
    return fixes.select(
        "source_file", "part", F.lit(0).cast("bigint").alias("stage"), F.col("pos").cast("bigint").alias("pos"), "message"
    ).unionByName(
        issues.select(
            "source_file", F.lit("issue").alias("part"), F.col("stage").cast("bigint").alias("stage"), "pos",
            F.col("issue").alias("message"),
        )
    )


def feed_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Confidence, completeness and gate of every order file."""
    complete = completeness(F.col("present"), F.col("n_records"), F.col("record_kind"))
    return (
        order_facts(spark, sf_dir)
        .withColumn("completeness", complete)
        .withColumn("score", gate(F.col("confidence"), F.col("completeness")))
        .select(
            "source_file", "method", "confidence", "n_records", "n_issues", "completeness", "score",
            verdict(F.col("score")).alias("action"),
        )
    )


QUERIES = {
    "profile_null_rates": profile_null_rates,
    "detect_drift": detect_drift,
    "coerce_dates": coerce_dates,
    "coerce_numbers": coerce_numbers,
    "repair_transactions": repair_transactions,
    "repair_log": repair_log,
    "feed_gate": feed_gate,
}

ORACLES = {
    "profile_null_rates": """
        SELECT 'orders_' || strftime(o_orderdate, '%Y-%m') || '.csv' AS source_file, count(*) AS row_count,
               'txn_id,priority,status' AS columns, CAST(0.0 AS DOUBLE) AS null_rate_txn_id,
               round_even(count(*) FILTER (o_orderkey % 7 = 0) / count(*), 3) AS null_rate_priority,
               round_even(count(*) FILTER (o_orderkey % 7 IN (1, 2)) / count(*), 3) AS null_rate_status
        FROM orders GROUP BY ALL""",
    "detect_drift": """
        SELECT c_custkey, c_custkey % 5 >= 2 AS has_drift,
               CASE c_custkey % 5 WHEN 2 THEN 'category,currency,date,merchant,txn_id' WHEN 3 THEN 'txn_id'
                 WHEN 4 THEN 'amount,category,currency,date,merchant,txn_id' ELSE '' END AS missing_columns,
               CASE c_custkey % 5 WHEN 2 THEN 'transaction_id' WHEN 3 THEN 'TXN_ID,x' || c_nationkey ELSE '' END AS unexpected_columns
        FROM customer""",
    "coerce_dates": """
        SELECT o_orderkey AS k,
               CASE WHEN o_orderkey % 5003 <> 7 THEN strftime(o_orderdate, '%Y-%m-%d') END AS iso_date,
               o_orderkey % 5003 <> 7 AND o_orderkey % 6 <> 0 AS changed
        FROM orders""",
    "coerce_numbers": """
        SELECT l_orderkey, l_linenumber, l_partkey,
               CASE l_partkey % 7 WHEN 4 THEN -l_extendedprice WHEN 5 THEN NULL
                 WHEN 6 THEN CAST(CAST(CAST(l_quantity AS INT) AS VARCHAR) || '2' AS DOUBLE)
                 ELSE l_extendedprice END AS number,
               l_partkey % 7 IN (0, 6) OR (l_partkey % 7 IN (1, 4) AND l_extendedprice < 1000) AS is_plain
        FROM lineitem""",
    "repair_transactions": f"""
        WITH {ORDER_ROWS}
        SELECT source_file, txn_id, date, amount, currency, merchant, category FROM records""",
    "repair_log": f"""
        WITH {ORDER_ROWS},{ORDER_FACTS}
        SELECT source_file, 'fix' AS part, CAST(0 AS BIGINT) AS stage,
               row_number() OVER (PARTITION BY source_file ORDER BY pos) - 1 AS pos, message
        FROM order_log
        UNION ALL
        SELECT source_file, 'issue', stage, pos, issue FROM order_issues""",
    "feed_gate": f"""
        WITH {ORDER_ROWS},{ORDER_FACTS}
        SELECT source_file, method, confidence, n_records, n_issues, completeness, score,
               CASE WHEN score >= 0.75 THEN 'LOAD' ELSE 'REVIEW' END AS action
        FROM order_decisions""",
}
