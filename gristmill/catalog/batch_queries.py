"""The whole job, from a folder of mixed files to tables that are read back."""

from __future__ import annotations

import re
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.refine import RefineResult, refine
from ..session import scratch_root, spread, stage
from ..sinks.batch import run_batch
from ..sinks.warehouse import Warehouse
from .feeds import table

AGREED = "txn_id,date,amount,currency,merchant,category"
DRIFTED = "transaction_id,transaction_date,amount_usd,merchant_name,merchant_category"


def write_files(contents: DataFrame, folder: str) -> None:
    """Write ``source_file``, ``content`` as files of those names, by the tasks that hold them."""

    def run(batches):
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", folder))
        store.create_dir(root, recursive=True)
        n = 0
        for batch in batches:
            for name, content in zip(batch.column("source_file").to_pylist(), batch.column("content").to_pylist()):
                # Written aside first, so that an attempt that ends half-way leaves no half file.
                aside = f"{root}/.{name}-{uuid.uuid4().hex}"
                with store.open_output_stream(aside) as out:
                    out.write(content.encode())
                store.move(aside, f"{root}/{name}")
                n += 1
        yield pa.RecordBatch.from_arrays([pa.array([n])], names=["n"])

    stage(contents.mapInArrow(run, "n long"), "files")


def order_exports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Delimited files of the orders, 2,000 keys a file; every other file has a drifted header."""
    rows = table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey AS k", "o_orderkey div 2000 AS file", "(o_orderkey div 2000) % 2 = 1 AS drifted",
        "CASE o_orderkey % 3 WHEN 0 THEN date_format(o_orderdate, 'yyyy-MM-dd') WHEN 1 THEN date_format(o_orderdate, 'dd/MM/yyyy') ELSE date_format(o_orderdate, 'yyyy/MM/dd') END AS day",
        "CASE WHEN o_orderkey % 9001 = 11 THEN 'n/a' WHEN o_orderkey % 2 = 0 THEN format_string('%.2f', o_totalprice) ELSE concat('\"', format_number(o_totalprice, 2), '\"') END AS price",
        "concat('\"Shop, ', o_custkey % 100, IF(o_orderkey % 97 = 5, concat(' +97150', lpad(o_orderkey % 10000000, 7, '0')), ''), '\nfloor 2\"') AS shop",
        "o_orderpriority AS kind",
    )
    line = F.expr("concat('T-', k, ',', day, ',', price, IF(drifted, ',', ',AED,'), shop, ',', kind)").alias("line")
    lines = rows.groupBy("file", "drifted").agg(F.array_sort(F.collect_list(F.struct("k", line))).alias("lines"))
    head = F.when(F.col("drifted"), DRIFTED).otherwise(AGREED)
    text = F.concat(head, F.lit("\n"), F.array_join("lines.line", "\n"), F.lit("\n"))
    return lines.select(F.expr("concat('orders_', file, '.csv')").alias("source_file"), text.alias("content"))


def mail_exports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A mailbox export of each conversation, a message a turn."""
    message = F.expr(
        r"concat('From: ', role, '.', conv_id, '@mail.example\nSubject: Turn ', turn, '\nDate: 2026-01-', lpad(turn % 28 + 1, 2, '0'), '\n---\n', text)"
    ).alias("message")
    turns = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", message))).alias("m"))
    return turns.select(F.expr("concat('conv_', conv_id, '.txt')").alias("source_file"), F.array_join("m.message", "\n=====\n").alias("content"))


def supplier_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By key: an invoice, a file of unknown type, an empty feed, a feed that is a header alone."""
    return spread(table(spark, sf_dir, "supplier")).selectExpr(
        "CASE s_suppkey % 4 WHEN 0 THEN concat('invoice_', s_suppkey, '.pdf') WHEN 1 THEN concat('note_', s_suppkey, '.docx') ELSE concat('feed_', s_suppkey, '.csv') END AS source_file",
        rf"""CASE s_suppkey % 4 WHEN 0 THEN concat('INVOICE\nInvoice Number: INV-', s_suppkey, '\nVendor: ', s_name, '\nInvoice Date: 2026-07-01\nDue Date: 01/08/2026\n',
               IF(s_suppkey % 8 = 0, 'Contact: +971 50 664 2083\n', ''), 'Total: AED ', format_number(abs(s_acctbal) + 1, 2))
             WHEN 1 THEN s_name WHEN 2 THEN '' ELSE '{AGREED}\n' END AS content""",
    )


def mixed_job(spark: SparkSession, sf_dir: str) -> tuple[RefineResult, Warehouse, str, DataFrame]:
    """The job over a folder of all these files: its result, the loaded warehouse, the restricted folder, the counts."""
    folder = f"{scratch_root(spark)}/gristmill/mixed-{uuid.uuid4().hex}"
    for contents in (order_exports(spark, sf_dir), mail_exports(spark, sf_dir), supplier_files(spark, sf_dir)):
        write_files(contents, f"{folder}/inbox")
    texts = supplier_files(spark, sf_dir).where("source_file LIKE '%.pdf'").withColumnRenamed("content", "raw_text")
    result = refine(spark, f"{folder}/inbox", texts=texts)
    warehouse = Warehouse(spark, f"{folder}/warehouse")
    counts = run_batch(result, warehouse, f"{folder}/restricted")
    return result, warehouse, f"{folder}/restricted", counts


def batch_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    result, *_ = mixed_job(spark, sf_dir)
    return result.report().withColumn("records_loaded", F.col("records_loaded").cast("bigint"))


def batch_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed_job(spark, sf_dir)[3]


def batch_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of every table as readers of the warehouse see them."""
    warehouse = mixed_job(spark, sf_dir)[1]
    none = F.lit(None).cast("string")
    return (
        warehouse.table("transactions").select(F.lit("transactions").alias("kind"), "source_file", F.col("txn_id").alias("id"), "date", F.col("merchant").alias("party"), "currency", "amount")
        .union(warehouse.table("invoices").select(F.lit("invoices"), "source_file", "invoice_number", F.concat("invoice_date", F.lit(" "), "due_date"), "vendor", "currency", "total_amount"))
        .union(warehouse.table("documents").select(F.lit("documents"), "source_file", "subject", "date", "sender", F.md5("body"), F.lit(None).cast("double")))
        .union(warehouse.table("chunks").where("kind <> 'transactions'").select(F.lit("chunks"), "source_file", "kind", F.col("chunk_ord").cast("string"), F.md5("text"), none, F.lit(None).cast("double")))
    )


def batch_originals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digest of every quarantined original, put together again from the restricted folder."""
    restricted = mixed_job(spark, sf_dir)[2]
    lines = spark.read.parquet(f"{restricted}/originals")
    whole = lines.groupBy("source_file", "length").agg(F.array_sort(F.collect_list(F.struct("block", "seq", "line"))).alias("l"))
    text = F.array_join(F.transform("l", lambda x: x["line"].cast("string")), "\n")
    # A last line feed is told by the file's length.
    text = F.when(F.octet_length(text) < F.col("length"), F.concat(text, F.lit("\n"))).otherwise(text)
    return whole.select("source_file", F.octet_length(text).cast("bigint").alias("size"), F.md5(text).alias("content_md5"))


QUERIES = {
    "batch_report": batch_report,
    "batch_counts": batch_counts,
    "batch_tables": batch_tables,
    "batch_originals": batch_originals,
}

_FILES = f"""
o AS (
  SELECT o_orderkey AS k, o_orderkey // 2000 AS file, (o_orderkey // 2000) % 2 = 1 AS drifted, strftime(o_orderdate, '%Y-%m-%d') AS day,
         CASE o_orderkey % 3 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 1 THEN strftime(o_orderdate, '%d/%m/%Y') ELSE strftime(o_orderdate, '%Y/%m/%d') END AS written_day,
         CASE WHEN o_orderkey % 9001 = 11 THEN 'n/a' WHEN o_orderkey % 2 = 0 THEN printf('%.2f', o_totalprice) ELSE '"' || format('{{:,.2f}}', o_totalprice) || '"' END AS price,
         o_orderkey % 9001 = 11 AS bad, o_orderkey % 97 = 5 AS phone, 'Shop, ' || o_custkey % 100 AS shop, o_orderpriority AS category, o_totalprice AS amount
  FROM orders),
orders_files AS (
  SELECT 'orders_' || file || '.csv' AS source_file, count(*) AS n, count(*) FILTER (bad) AS n_bad, count(*) FILTER (phone) AS n_phone,
         CASE WHEN any_value(drifted) THEN '{DRIFTED}' ELSE '{AGREED}' END || chr(10) || string_agg('T-' || k || ',' || written_day || ',' || price
           || CASE WHEN drifted THEN ',' ELSE ',AED,' END || '"' || shop || CASE WHEN phone THEN ' +97150' || lpad(CAST(k % 10000000 AS VARCHAR), 7, '0') ELSE '' END
           || chr(10) || 'floor 2",' || category, chr(10) ORDER BY k) || chr(10) AS content
  FROM o GROUP BY file),
m AS (
  SELECT 'conv_' || conv_id || '.txt' AS source_file, conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS pos,
         '2026-01-' || lpad(CAST(turn % 28 + 1 AS VARCHAR), 2, '0') AS date, trim(text, E' \\n\\t\\r') AS body FROM conversations),
mail_files AS (
  SELECT source_file, count(*) AS n,
         string_agg('From: ' || role || '.' || conv_id || '@mail.example' || chr(10) || 'Subject: Turn ' || turn || chr(10) || 'Date: ' || date || chr(10) || '---' || chr(10) || text,
           chr(10) || '=====' || chr(10) ORDER BY turn) AS content
  FROM m GROUP BY source_file),
invoices AS (
  SELECT 'invoice_' || s_suppkey || '.pdf' AS source_file, 'INV-' || s_suppkey AS invoice_number, s_name, abs(s_acctbal) + 1 AS total, s_suppkey % 8 = 0 AS phone,
         'INVOICE' || chr(10) || 'Invoice Number: INV-' || s_suppkey || chr(10) || 'Vendor: ' || s_name || chr(10) || 'Invoice Date: 2026-07-01' || chr(10) || 'Due Date: 01/08/2026' || chr(10)
           || CASE WHEN s_suppkey % 8 = 0 THEN 'Contact: +971 50 664 2083' || chr(10) ELSE '' END || 'Total: AED ' || format('{{:,.2f}}', abs(s_acctbal) + 1) AS content
  FROM supplier WHERE s_suppkey % 4 = 0),
report AS (
  SELECT source_file, 'csv' AS file_type, CASE WHEN n_bad = 0 THEN 1.0 ELSE 0.5 END AS score, n_phone > 0 AS quarantine, n, 'transactions' AS kind FROM orders_files
  UNION ALL SELECT source_file, 'email', 1.0, true, n, 'documents' FROM mail_files
  UNION ALL SELECT source_file, 'pdf', 1.0, phone, 1, 'invoices' FROM invoices
  UNION ALL SELECT 'note_' || s_suppkey || '.docx', 'unknown', 0.0, false, 0, NULL FROM supplier WHERE s_suppkey % 4 = 1
  UNION ALL SELECT 'feed_' || s_suppkey || '.csv', 'csv', 0.0, false, 0, 'transactions' FROM supplier WHERE s_suppkey % 4 > 1)"""

ORACLES = {
    "batch_report": f"""
        WITH {_FILES}
        SELECT source_file, file_type, CASE WHEN score >= 0.75 THEN 'LOAD' ELSE 'REVIEW' END AS action, CAST(score AS DOUBLE) AS quality_score, quarantine,
               CAST(CASE WHEN score >= 0.75 THEN n ELSE 0 END AS BIGINT) AS records_loaded FROM report""",
    "batch_counts": f"""
        WITH {_FILES}
        SELECT CAST(coalesce(sum(n) FILTER (score >= 0.75 AND kind = 'transactions'), 0) AS BIGINT) AS transactions, CAST(coalesce(sum(n) FILTER (score >= 0.75 AND kind = 'invoices'), 0) AS BIGINT) AS invoices,
               CAST(coalesce(sum(n) FILTER (score >= 0.75 AND kind = 'documents'), 0) AS BIGINT) AS documents,
               CAST(sum(CASE WHEN kind = 'transactions' THEN 1 ELSE n END) FILTER (score >= 0.75) AS BIGINT) AS chunks, count(*) FILTER (score < 0.75) AS review
        FROM report""",
    "batch_tables": f"""
        WITH {_FILES},
        t AS (SELECT o.*, 'orders_' || file || '.csv' AS source_file FROM o)
        SELECT 'transactions' AS kind, source_file, 'T-' || k AS id, day AS date, shop || CASE WHEN phone THEN ' [REDACTED-PHONE]' ELSE '' END || chr(10) || 'floor 2' AS party,
               CASE WHEN drifted THEN 'USD' ELSE 'AED' END AS currency, amount
        FROM t WHERE source_file IN (SELECT source_file FROM report WHERE score >= 0.75)
        UNION ALL SELECT 'invoices', source_file, invoice_number, '2026-07-01 2026-08-01', s_name, 'AED', round(total, 2) FROM invoices
        UNION ALL SELECT 'documents', source_file, 'Turn ' || turn, date, '[REDACTED-EMAIL]', md5(body), NULL FROM m
        UNION ALL SELECT 'chunks', source_file, 'invoices', '0', md5('Invoice ' || invoice_number || ' from ' || s_name || ': total ' || CAST(round(total, 2) AS VARCHAR) || ' AED, invoice date 2026-07-01, due date 2026-08-01.'), NULL, NULL FROM invoices
        UNION ALL SELECT 'chunks', source_file, 'documents', CAST(pos AS VARCHAR), md5('Email from [REDACTED-EMAIL] on ' || date || ', subject ''Turn ' || turn || ''': ' || body), NULL, NULL FROM m""",
    "batch_originals": f"""
        WITH {_FILES}
        SELECT r.source_file, strlen(content) AS size, md5(content) AS content_md5
        FROM report r JOIN (SELECT source_file, content FROM orders_files UNION ALL SELECT source_file, content FROM mail_files UNION ALL SELECT source_file, content FROM invoices) f
          ON f.source_file = r.source_file WHERE quarantine""",
}
