"""Input feeds derived from the shared tables.

Clean columns are rendered the way messy sources write them, so that the
operators have something to repair and the clean columns say what must come
out.  Everything is row-local except the join that brings in a name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..contracts import TRANSACTIONS
from ..operators.classify import file_type, looks_like_mail
from ..operators.repair import Feeds, header_table
from ..session import spread

DRIFTED_HEADER = (
    "transaction_id",
    "transaction_date",
    "amount_aed",
    "merchant_name",
    "merchant_category",
    "batch_note",
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def order_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as rows of monthly files: five date shapes, four amount shapes,
    some unusable values, some rows twice, some phone numbers."""
    orders = spread(table(spark, sf_dir, "orders"))
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    return (
        orders.join(customers, orders.o_custkey == customers.c_custkey)
        .selectExpr("o_orderkey AS k", "CAST(o_orderdate AS date) AS d", "o_totalprice AS p", "c_name", "o_orderpriority")
        .selectExpr(
            "k",
            "d",
            "concat('orders_', date_format(d, 'yyyy-MM'), '.csv') AS source_file",
            "month(d) % 2 = 1 AS drifted",
            "concat('T-', k) AS txn_id",
            """CASE WHEN k % 5003 = 7 THEN 'soon'
                    WHEN k % 6 = 1 THEN date_format(d, 'dd/MM/yyyy')
                    WHEN k % 6 = 2 THEN date_format(d, 'd-M-yyyy')
                    WHEN k % 6 = 3 THEN date_format(d, 'yyyy/MM/dd')
                    WHEN k % 6 = 4 THEN date_format(d, 'd MMM yyyy')
                    WHEN k % 6 = 5 THEN concat(' ', CAST(d AS string), ' ')
                    ELSE CAST(d AS string) END AS date_text""",
            """CASE WHEN k % 4001 = 11 THEN 'n/a'
                    WHEN k % 4003 = 12 THEN ''
                    WHEN k % 4 = 1 THEN format_number(p, 2)
                    WHEN k % 4 = 2 THEN concat('AED ', format_string('%.2f', p))
                    WHEN k % 4 = 3 THEN concat(format_number(p, 2), ' AED')
                    ELSE format_string('%.2f', p) END AS amount_text""",
            "IF(k % 997 = 5, concat(c_name, ' +97150', lpad(k % 10000000, 7, '0')), c_name) AS merchant",
            "o_orderpriority AS category",
            "explode(sequence(1, IF(k % 10 = 3, 2, 1))) AS copy",
        )
    )


def order_feeds(spark: SparkSession, sf_dir: str) -> Feeds:
    """Odd months come with a drifted header, even months with the agreed one."""
    rows = order_rows(spark, sf_dir).selectExpr(
        "source_file",
        "k * 2 + copy AS pos",
        "IF(drifted, 0L, 1L) AS plan_id",
        """IF(drifted, array(txn_id, date_text, amount_text, merchant, category, concat('batch ', k % 3)),
                       array(txn_id, date_text, amount_text, 'AED', merchant, category)) AS values""",
    )
    return Feeds(rows, header_table(spark, order_headers()))


def order_headers() -> list[tuple[str, ...]]:
    return [DRIFTED_HEADER, TRANSACTIONS.columns]


def mail_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One small mailbox export per conversation turn: the turn as a message,
    and an acknowledgement that has no body separator."""
    turns = spread(table(spark, sf_dir, "conversations"))
    return turns.selectExpr(
        "conv_id",
        "turn",
        "role",
        "text",
        "concat('conv_', conv_id, '_', turn, '.txt') AS source_file",
        r"""concat('From: ', role, '.', conv_id, '@mail.example\n',
                   'Subject: Turn ', turn, ' of conversation ', conv_id, '\n',
                   'Date: 2026-01-', lpad(turn % 28 + 1, 2, '0'), '\n---\n', text,
                   '\n=====\nTO: desk\nfrom: bot\nAcknowledged turn ', turn, '\n') AS raw_text""",
    )


def invoice_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as the text of invoice documents, with labels left out by key."""
    orders = spread(table(spark, sf_dir, "orders"))
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    return (
        orders.join(customers, orders.o_custkey == customers.c_custkey)
        .selectExpr("o_orderkey AS k", "CAST(o_orderdate AS date) AS d", "o_totalprice AS p", "c_name")
        .selectExpr(
            "k",
            "concat('invoice_', k, '.pdf') AS source_file",
            r"""concat('INVOICE\n',
                IF(k % 25 = 4, '', concat('Invoice Number: INV-', k, '\n')),
                IF(k % 5 = 1, '', concat('Vendor: ', c_name, '\n')),
                IF(k % 5 = 2, '', concat('Invoice Date: ', date_format(d, 'dd/MM/yyyy'), '\n')),
                IF(k % 5 = 4, '', concat('Due Date: ', CAST(d + 30 AS string), '\n')),
                IF(k % 7 = 0, concat('Contact: +971 50 ', lpad(k % 1000, 3, '0'), ' 4567\n'), ''),
                IF(k % 5 = 3, '', concat('Total: AED ', format_number(p, 2)))) AS raw_text""",
        )
    )


def unknown_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").selectExpr(
        "concat('supplier_', s_suppkey, '.docx') AS source_file",
        "octet_length(s_name) AS size_bytes",
        "'unknown' AS file_type",
    )


def planted_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers with identity numbers, IBANs, addresses and phone numbers in
    free text, in every shape the detectors know."""
    return table(spark, sf_dir, "customer").selectExpr(
        "c_custkey",
        "c_mktsegment",
        "c_acctbal",
        "c_name",
        """concat('Client ', c_name, ' ref INV-2026-', lpad(c_custkey % 1000, 3, '0'), ' ',
           CASE c_custkey % 8
             WHEN 0 THEN concat('id 784-1990-', lpad(c_custkey, 7, '0'), '-1')
             WHEN 1 THEN concat('id 7841990', lpad(c_custkey, 7, '0'), '1')
             WHEN 2 THEN concat('iban AE07', lpad(c_custkey, 19, '0'))
             WHEN 3 THEN concat('mail c.', c_custkey, '@shop.example and x@y.ae')
             WHEN 4 THEN concat('call +97150', lpad(c_custkey % 10000000, 7, '1'))
             WHEN 5 THEN concat('call 05012', lpad(c_custkey % 100000, 5, '2'))
             WHEN 6 THEN concat('call (04) 321-', lpad(c_custkey % 10000, 4, '3'), ' or +971 50 123 4567')
             ELSE 'dated 2026-08-01 for AED 4,520.00' END) AS note""",
        "concat('c', c_custkey, '@mail.example') AS contact",
    )


def mail_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """File-grain listing of the mail exports, classified by content."""
    return mail_texts(spark, sf_dir).select(
        "source_file",
        F.octet_length("raw_text").cast("bigint").alias("size_bytes"),
        file_type(F.col("source_file"), looks_like_mail(F.col("raw_text"))).alias("file_type"),
    )


def invoice_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return invoice_texts(spark, sf_dir).select(
        "source_file",
        F.octet_length("raw_text").cast("bigint").alias("size_bytes"),
        file_type(F.col("source_file"), F.lit(False)).alias("file_type"),
    )


def order_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listing of the monthly order files (one byte per order stands for size)."""
    return (
        table(spark, sf_dir, "orders")
        .selectExpr("concat('orders_', date_format(CAST(o_orderdate AS date), 'yyyy-MM'), '.csv') AS source_file")
        .groupBy("source_file")
        .agg(F.count(F.lit(1)).alias("size_bytes"))
        .withColumn("file_type", file_type(F.col("source_file"), F.lit(False)))
    )
