"""Decisions, loading, lineage and reports over files of every kind."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..contracts import TRANSACTIONS
from ..operators import quality
from ..operators.invoice import invoice_facts, invoice_records
from ..operators.mail import mail_facts
from ..operators.repair import deduplicate, feed_facts, header_issues, plan_table, row_issues
from ..plans.refine import explode_findings, refine
from ..session import scratch_root, stage
from ..sinks.warehouse import Warehouse, current_rows, lineage_rows, load_counts, lineage_report
from .feeds import invoice_files, mail_files, order_files, order_headers, table, unknown_files
from .oracle_parts import ALL_DECISIONS, AUDIT, INVOICES, LOADED, MAILS, ORDER_ROWS
from .repair_queries import order_facts, repaired_records, repaired_rows
from .text_queries import extracted_invoices, mail_messages


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = [f(spark, sf_dir) for f in (order_files, mail_files, invoice_files, unknown_files)]
    return reduce(DataFrame.unionByName, parts)


def _decisions(spark: SparkSession, sf_dir: str, facts_of_orders: DataFrame | None = None) -> DataFrame:
    facts = [
        order_facts(spark, sf_dir) if facts_of_orders is None else facts_of_orders,
        mail_facts(mail_messages(spark, sf_dir)),
        invoice_facts(extracted_invoices(spark, sf_dir)),
    ]
    return quality.decide(_files(spark, sf_dir), reduce(DataFrame.unionByName, facts))


def _decided(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Decisions and issues; what both read is staged as the batch job does, so that no row is repaired twice."""
    rows = stage(repaired_rows(spark, sf_dir), "feed-rows")
    facts = feed_facts(deduplicate(rows, TRANSACTIONS), plan_table(spark, order_headers(), TRANSACTIONS), TRANSACTIONS)
    decided = stage(_decisions(spark, sf_dir, facts), "decisions")
    return decided, header_issues(decided).unionByName(row_issues(rows, TRANSACTIONS))


def decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _decisions(spark, sf_dir).select(
        "source_file", "file_type", "record_kind", "method", "confidence", "completeness", "action", "quality_score",
        "quarantine", F.col("records_loaded").cast("bigint").alias("records_loaded"),
        F.col("n_findings").cast("bigint").alias("n_findings"), F.col("n_issues").cast("bigint").alias("n_issues"),
        F.array_join("pii_types", ",").alias("pii_types"),
    )


def load_counts_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load_counts(_decisions(spark, sf_dir))


def lineage(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lineage_rows(*_decided(spark, sf_dir))
    return rows.withColumns(
        {"records_loaded": F.col("records_loaded").cast("bigint"), "n_unfixed": F.col("n_unfixed").cast("bigint")}
    )


def lineage_report_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lineage_rows(*_decided(spark, sf_dir)).withColumn("records_loaded", F.col("records_loaded").cast("bigint"))
    rows = rows.withColumn("processed_at", F.to_timestamp(F.lit("2026-01-01 00:00:00")))
    return lineage_report(rows)


def audit_trail(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _decisions(spark, sf_dir).select("source_file", F.posexplode_outer("audit").alias("pos", "line"))
    return lines.select("source_file", F.col("pos").cast("bigint").alias("pos"), "line")


def review_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    queue = quality.review_queue(*_decided(spark, sf_dir))
    return queue.select("source_file", "file_type", "quality_score", "reason")


def decision_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.reasons(*_decided(spark, sf_dir)).select("source_file", "reason")


def quarantine_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings of every flagged file, in scan order."""
    mails = stage(mail_messages(spark, sf_dir), "messages")
    extracted = stage(extracted_invoices(spark, sf_dir), "invoices").withColumn("pos", F.lit(0).cast("bigint"))
    found = [
        explode_findings(repaired_records(spark, sf_dir), "findings", 1),
        explode_findings(mails, "raw_findings", 0),
        explode_findings(mails, "findings", 1),
        explode_findings(extracted, "raw_findings", 0),
        explode_findings(invoice_records(extracted), "findings", 1),
    ]
    return reduce(DataFrame.unionByName, found).select(
        "source_file", F.col("part").cast("bigint").alias("part"), "pos", F.col("ord").cast("bigint").alias("ord"), "type", "preview"
    )


def loaded_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only records of files that pass the gate reach the table."""
    records = deduplicate(stage(repaired_rows(spark, sf_dir), "feed-rows"), TRANSACTIONS)
    facts = feed_facts(records, plan_table(spark, order_headers(), TRANSACTIONS), TRANSACTIONS)
    passed = quality.decide(order_files(spark, sf_dir), facts).where("action = 'LOAD'").select("source_file")
    records = records.join(passed, "source_file", "left_semi")
    return records.select(*TRANSACTIONS.columns, "source_file")


def loaded_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plain SQL over the loaded records."""
    return spark.sql(
        """SELECT category, currency, count(*) AS n, round(sum(amount), 2) AS total, min(date) AS first_date
           FROM {transactions} GROUP BY category, currency""",
        transactions=loaded_transactions(spark, sf_dir),
    )


def latest_run_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as rows of one file per user, loaded in two runs; the second run
    covers some files only and sends some of those to review."""
    events = table(spark, sf_dir, "events")
    rows = events.selectExpr(
        "concat('user_', user_id) AS source_file", "event_id", "value", "IF(event_id % 2 = 0, 'r1', 'r2') AS run_id"
    )
    runs = (
        events.selectExpr("user_id").distinct()
        .selectExpr(
            "concat('user_', user_id) AS source_file",
            """explode(CASE WHEN user_id % 3 = 0 THEN array(named_struct('run_id', 'r1', 'decision', 'LOAD'))
                 WHEN user_id % 3 = 1 THEN array(named_struct('run_id', 'r1', 'decision', 'LOAD'), named_struct('run_id', 'r2', 'decision', 'LOAD'))
                 ELSE array(named_struct('run_id', 'r1', 'decision', 'LOAD'), named_struct('run_id', 'r2', 'decision', 'REVIEW')) END) AS r""",
        )
        .selectExpr("source_file", "r.run_id", "r.decision", "IF(r.run_id = 'r1', 1, 2) AS processed_at")
    )
    return current_rows(rows, runs).select("source_file", "run_id", "event_id", "value")


def _export_folder(spark: SparkSession, sf_dir: str) -> str:
    """A folder of order rows written as delimited files with a drifted header."""
    folder = f"{scratch_root(spark)}/gristmill/exports-{uuid.uuid4().hex}"
    rows = table(spark, sf_dir, "orders").selectExpr(
        "concat('T-', o_orderkey) AS transaction_id",
        "date_format(CAST(o_orderdate AS date), 'dd/MM/yyyy') AS transaction_date",
        "format_number(o_totalprice, 2) AS amount_usd",
        "concat('Shop \"', o_custkey % 100, '\",\nfloor ', o_custkey % 5) AS merchant_name",
        "o_orderpriority AS merchant_category",
    )
    # Quoted line breaks and doubled quotes: the reader must put them together.
    rows.repartition(8).write.option("header", True).option("escape", '"').csv(folder)
    return folder


def refine_exports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The batch job from files to tables, over exports of the order table."""
    result = refine(spark, _export_folder(spark, sf_dir))
    warehouse = Warehouse(spark, f"{scratch_root(spark)}/gristmill/warehouse-{uuid.uuid4().hex}")
    warehouse.load(result)
    return warehouse.table("transactions").select(*TRANSACTIONS.columns)


QUERIES = {
    "decisions": decisions,
    "load_counts": load_counts_all,
    "lineage": lineage,
    "lineage_report": lineage_report_all,
    "audit_trail": audit_trail,
    "review_queue": review_queue,
    "decision_reasons": decision_reasons,
    "quarantine_findings": quarantine_findings,
    "loaded_transactions": loaded_transactions,
    "loaded_sql": loaded_sql,
    "latest_run_view": latest_run_view,
    "refine_exports": refine_exports,
}

_ACTION = "CASE WHEN score >= 0.75 THEN 'LOAD' ELSE 'REVIEW' END"
_LOADED_ROWS = f"""
    loaded AS (SELECT * FROM records WHERE source_file IN ({LOADED}))"""
_LINEAGE = f"""
    WITH {ALL_DECISIONS},{AUDIT}
    SELECT d.source_file, d.file_type, {_ACTION} AS decision, d.record_kind,
           CAST(CASE WHEN score >= 0.75 THEN n_records ELSE 0 END AS BIGINT) AS records_loaded,
           CAST(score AS DOUBLE) AS quality_score, method AS extraction_method,
           '[' || coalesce((SELECT string_agg('"' || message || '"', ',' ORDER BY pos) FROM order_log l WHERE l.source_file = d.source_file), '') || ']' AS fixes,
           '[' || coalesce((SELECT string_agg('"' || issue || '"', ',' ORDER BY stage, pos) FROM order_issues l WHERE l.source_file = d.source_file), '') || ']' AS unfixed,
           CAST(n_issues AS BIGINT) AS n_unfixed, pii_types, n_findings > 0 AS quarantined,
           '[' || (SELECT string_agg('"' || line || '"', ',' ORDER BY pos) FROM audit a WHERE a.source_file = d.source_file) || ']' AS audit
    FROM decisions d"""
_REASONS = f"""
    reasons AS (
      SELECT source_file, 'unclassified file type; needs a human to route it' AS reason FROM u
      UNION ALL SELECT source_file, message FROM order_log
      UNION ALL SELECT source_file, 'UNFIXED: ' || issue FROM order_issues
      UNION ALL SELECT source_file, 'PII redacted before load (' || pii_types || '); original quarantined' FROM decisions WHERE n_findings > 0)"""

ORACLES = {
    "decisions": f"""
        WITH {ALL_DECISIONS}
        SELECT source_file, file_type, record_kind, method, CAST(confidence AS DOUBLE) AS confidence,
               CAST(completeness AS DOUBLE) AS completeness, {_ACTION} AS action, CAST(score AS DOUBLE) AS quality_score,
               n_findings > 0 AS quarantine, CAST(CASE WHEN score >= 0.75 THEN n_records ELSE 0 END AS BIGINT) AS records_loaded,
               CAST(n_findings AS BIGINT) AS n_findings, CAST(n_issues AS BIGINT) AS n_issues, pii_types
        FROM decisions""",
    "load_counts": f"""
        WITH {ALL_DECISIONS}
        SELECT CAST(sum(n_records) FILTER (score >= 0.75 AND record_kind = 'transactions') AS BIGINT) AS transactions,
               CAST(sum(n_records) FILTER (score >= 0.75 AND record_kind = 'invoices') AS BIGINT) AS invoices,
               CAST(sum(n_records) FILTER (score >= 0.75 AND record_kind = 'documents') AS BIGINT) AS documents,
               CAST(sum(CASE WHEN record_kind = 'transactions' THEN 1 ELSE n_records END) FILTER (score >= 0.75) AS BIGINT) AS chunks,
               count(*) FILTER (score < 0.75) AS review
        FROM decisions""",
    "lineage": _LINEAGE,
    "lineage_report": f"""
        SELECT source_file, file_type, decision, CAST(records_loaded AS BIGINT) AS records_loaded, quality_score, pii_types, quarantined
        FROM ({_LINEAGE}) ORDER BY source_file""",
    "audit_trail": f"""
        WITH {ALL_DECISIONS},{AUDIT}
        SELECT source_file, row_number() OVER (PARTITION BY source_file ORDER BY pos) - 1 AS pos, line FROM audit""",
    "review_queue": f"""
        WITH {ALL_DECISIONS},{_REASONS}
        SELECT d.source_file, file_type, CAST(score AS DOUBLE) AS quality_score, reason
        FROM decisions d LEFT JOIN reasons r ON r.source_file = d.source_file WHERE score < 0.75""",
    "decision_reasons": f"""
        WITH {ALL_DECISIONS},{_REASONS} SELECT source_file, reason FROM reasons""",
    "quarantine_findings": f"""
        WITH {ORDER_ROWS},{INVOICES},{MAILS}
        SELECT source_file, CAST(1 AS BIGINT) AS part, k * 2 + copy AS pos, CAST(0 AS BIGINT) AS ord, 'phone' AS type, '+971***' AS preview
        FROM c WHERE kept AND has_phone
        UNION ALL SELECT source_file, part, 0, 0, 'email', role[1:4] || '***' FROM m, unnest([0, 1]) p(part)
        UNION ALL SELECT source_file, 0, 0, 0, 'phone', '+971***' FROM i WHERE has_phone""",
    "loaded_transactions": f"""
        WITH {ALL_DECISIONS},{_LOADED_ROWS}
        SELECT txn_id, date, amount, currency, merchant, category, source_file FROM loaded""",
    "loaded_sql": f"""
        WITH {ALL_DECISIONS},{_LOADED_ROWS}
        SELECT category, currency, count(*) AS n, round(sum(amount), 2) AS total, min(date) AS first_date FROM loaded GROUP BY ALL""",
    "latest_run_view": """
        WITH runs AS (
          SELECT DISTINCT user_id, 'r1' AS run_id, 1 AS processed_at, 'LOAD' AS decision FROM events
          UNION ALL SELECT DISTINCT user_id, 'r2', 2, CASE user_id % 3 WHEN 1 THEN 'LOAD' ELSE 'REVIEW' END FROM events WHERE user_id % 3 <> 0),
        last AS (SELECT * FROM runs QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY processed_at DESC) = 1)
        SELECT 'user_' || e.user_id AS source_file, l.run_id, event_id, value
        FROM events e JOIN last l ON l.user_id = e.user_id AND l.decision = 'LOAD'
          AND l.run_id = CASE WHEN event_id % 2 = 0 THEN 'r1' ELSE 'r2' END""",
    "refine_exports": """
        SELECT 'T-' || o_orderkey AS txn_id, strftime(o_orderdate, '%Y-%m-%d') AS date, o_totalprice AS amount, 'USD' AS currency,
               'Shop "' || o_custkey % 100 || '",' || chr(10) || 'floor ' || o_custkey % 5 AS merchant, o_orderpriority AS category
        FROM orders""",
}
