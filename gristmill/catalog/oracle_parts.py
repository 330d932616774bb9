"""Shared pieces of the check SQL: what each derived feed must come out as,
computed from the clean columns."""

from __future__ import annotations

ORDER_ROWS = """
o AS (
  SELECT o_orderkey AS k, CAST(o_orderdate AS DATE) AS d, o_totalprice AS p, c_name, o_orderpriority AS category,
         'orders_' || strftime(o_orderdate, '%Y-%m') || '.csv' AS source_file,
         month(o_orderdate) % 2 = 1 AS drifted,
         o_orderkey % 5003 = 7 AS bad_date,
         o_orderkey % 4001 = 11 OR o_orderkey % 4003 = 12 AS bad_amount,
         o_orderkey % 997 = 5 AS has_phone
  FROM orders JOIN customer ON o_custkey = c_custkey),
c AS (SELECT o.*, copy, copy = 1 OR NOT drifted AS kept
      FROM o, unnest(range(1, 2 + CAST(k % 10 = 3 AS INT))) t(copy)),
records AS (
  SELECT source_file, k, copy, 'T-' || k AS txn_id,
         CASE WHEN bad_date THEN 'soon' ELSE strftime(d, '%Y-%m-%d') END AS date,
         CASE WHEN NOT bad_amount THEN p END AS amount, 'AED' AS currency,
         CASE WHEN has_phone THEN c_name || ' [REDACTED-PHONE]' ELSE c_name END AS merchant, category
  FROM c WHERE kept)"""

ORDER_FACTS = """
f AS (
  SELECT source_file, any_value(drifted) AS drifted, count(*) AS n_rows,
         count(*) FILTER (kept) AS n_records,
         count(*) FILTER (k % 6 <> 0 AND NOT bad_date) AS n_dates,
         count(*) FILTER (NOT bad_amount AND (k % 4 IN (2, 3) OR (k % 4 = 1 AND p >= 1000))) AS n_numbers,
         count(*) FILTER (bad_date) + count(*) FILTER (bad_amount) AS n_issues,
         count(*) FILTER (kept AND has_phone) AS n_findings,
         3 * count(*) FILTER (kept) - count(*) FILTER (kept AND k % 4003 = 12 AND k % 4001 <> 11) AS present
  FROM c GROUP BY source_file),
order_log AS (
  SELECT source_file, pos, message FROM f,
    unnest([
      CASE WHEN drifted THEN 'renamed column ''amount_aed'' -> ''amount''' END,
      CASE WHEN drifted THEN 'renamed column ''merchant_category'' -> ''category''' END,
      CASE WHEN drifted THEN 'renamed column ''merchant_name'' -> ''merchant''' END,
      CASE WHEN drifted THEN 'renamed column ''transaction_date'' -> ''date''' END,
      CASE WHEN drifted THEN 'renamed column ''transaction_id'' -> ''txn_id''' END,
      CASE WHEN drifted THEN 'filled missing column ''currency'' with default ''AED''' END,
      CASE WHEN drifted THEN 'dropped unexpected column(s): batch_note' END,
      CASE WHEN n_dates > 0 THEN 'normalised ' || n_dates || ' value(s) in ''date'' to ISO dates' END,
      CASE WHEN n_numbers > 0 THEN 'coerced ' || n_numbers || ' value(s) in ''amount'' to numeric' END,
      CASE WHEN n_rows > n_records THEN 'dropped ' || (n_rows - n_records) || ' exact duplicate row(s)' END
    ]) WITH ORDINALITY t(message, pos)
  WHERE message IS NOT NULL),
order_issues AS (
  SELECT source_file, 1 AS stage, k * 2 + copy AS pos, 'unparseable date ''soon'' in column ''date''' AS issue
  FROM c WHERE bad_date
  UNION ALL
  SELECT source_file, 2, k * 2 + copy,
         'unparseable number ''' || CASE WHEN k % 4001 = 11 THEN 'n/a' ELSE '' END || ''' in column ''amount'''
  FROM c WHERE bad_amount),
order_decisions AS (
  SELECT f.*, CASE WHEN n_issues = 0 THEN 1.0 ELSE 0.5 END AS confidence,
         round_even(present / (3.0 * n_records), 3) AS completeness,
         round_even(CASE WHEN n_issues = 0 THEN 1.0 ELSE 0.5 END * round_even(present / (3.0 * n_records), 3), 3) AS score,
         CASE WHEN drifted THEN 'csv+fixers' WHEN n_dates + n_numbers > 0 THEN 'csv+coerce' ELSE 'csv' END AS method,
         (SELECT count(*) FROM order_log l WHERE l.source_file = f.source_file) AS n_fixes
  FROM f)"""

INVOICES = """
i0 AS (
  SELECT o_orderkey AS k, 'invoice_' || o_orderkey || '.pdf' AS source_file,
         CAST(o_orderdate AS DATE) AS d, o_totalprice AS p, c_name
  FROM orders JOIN customer ON o_custkey = c_custkey),
i AS (
  SELECT k, source_file, k % 25 <> 4 AS numbered, k % 7 = 0 AS has_phone,
         'INV-' || k AS invoice_number,
         CASE WHEN k % 5 = 1 THEN 'UNKNOWN' ELSE c_name END AS vendor,
         CASE WHEN k % 5 <> 2 THEN strftime(d, '%Y-%m-%d') END AS invoice_date,
         CASE WHEN k % 5 <> 4 THEN CAST(d + 30 AS VARCHAR) END AS due_date,
         CASE WHEN k % 5 <> 3 THEN p END AS total_amount, 'AED' AS currency,
         CASE WHEN k % 25 = 4 THEN 0.0 ELSE CASE k % 5 WHEN 1 THEN 0.8 WHEN 2 THEN 0.8 WHEN 3 THEN 0.6 ELSE 1.0 END END AS confidence,
         CASE WHEN k % 25 = 4 THEN 0.0 WHEN k % 5 = 3 THEN 0.667 ELSE 1.0 END AS completeness,
         CASE WHEN k % 25 = 4 THEN 0.0 ELSE CASE k % 5 WHEN 1 THEN 0.8 WHEN 2 THEN 0.8 WHEN 3 THEN 0.4 ELSE 1.0 END END AS score,
         'INVOICE' || chr(10)
           || CASE WHEN k % 25 = 4 THEN '' ELSE 'Invoice Number: INV-' || k || chr(10) END
           || CASE WHEN k % 5 = 1 THEN '' ELSE 'Vendor: ' || c_name || chr(10) END
           || CASE WHEN k % 5 = 2 THEN '' ELSE 'Invoice Date: ' || strftime(d, '%d/%m/%Y') || chr(10) END
           || CASE WHEN k % 5 = 4 THEN '' ELSE 'Due Date: ' || CAST(d + 30 AS VARCHAR) || chr(10) END
           || CASE WHEN k % 7 = 0 THEN 'Contact: +971 50 ' || lpad(CAST(k % 1000 AS VARCHAR), 3, '0') || ' 4567' || chr(10) ELSE '' END
           || CASE WHEN k % 5 = 3 THEN '' ELSE 'Total: AED ' || format('{:,.2f}', p) END AS raw_text
  FROM i0)"""

MAILS = r"""
m AS (
  SELECT conv_id, turn, 'conv_' || conv_id || '_' || turn || '.txt' AS source_file, role,
         'Turn ' || turn || ' of conversation ' || conv_id AS subject,
         '2026-01-' || lpad(CAST(turn % 28 + 1 AS VARCHAR), 2, '0') AS date,
         trim(text, E' \n\t\r') AS body,
         strlen('From: ' || role || '.' || conv_id || '@mail.example' || 'Subject: Turn ' || turn || ' of conversation ' || conv_id
           || 'Date: 2026-01-00---' || text || '=====TO: deskfrom: botAcknowledged turn ' || turn) + 9 AS size_bytes
  FROM conversations),
messages AS (
  SELECT source_file, 0 AS pos, subject, '[REDACTED-EMAIL]' AS sender, date, body FROM m
  UNION ALL
  SELECT source_file, 1, '', 'bot', '', 'TO: desk' || chr(10) || 'from: bot' || chr(10) || 'Acknowledged turn ' || turn FROM m)"""

UNKNOWN = """
u AS (SELECT 'supplier_' || s_suppkey || '.docx' AS source_file, strlen(s_name) AS size_bytes FROM supplier)"""

DECISIONS = """
decisions AS (
  SELECT source_file, 'csv' AS file_type, 'transactions' AS record_kind, method, confidence, completeness, score,
         n_records, n_findings, CASE WHEN n_findings > 0 THEN 'phone' ELSE '' END AS pii_types, n_issues,
         (SELECT count(*) FROM o WHERE o.source_file = order_decisions.source_file) AS size_bytes
  FROM order_decisions
  UNION ALL
  SELECT source_file, 'email', 'documents', 'email_parser', 1.0, 1.0, 1.0, 2, 2, 'email', 0, size_bytes FROM m
  UNION ALL
  SELECT source_file, 'pdf', 'invoices', 'regex', confidence, completeness, score, CAST(numbered AS BIGINT),
         CAST(has_phone AS BIGINT), CASE WHEN has_phone THEN 'phone' ELSE '' END, 0, strlen(raw_text) FROM i
  UNION ALL
  SELECT source_file, 'unknown', NULL, NULL, NULL, NULL, 0.0, 0, 0, '', 0, size_bytes FROM u)"""

ALL_DECISIONS = ",".join([ORDER_ROWS, ORDER_FACTS, INVOICES, MAILS, UNKNOWN, DECISIONS])

AUDIT = """
audit AS (
  SELECT d.source_file, pos, line
  FROM decisions d
  LEFT JOIN order_decisions x ON x.source_file = d.source_file
  LEFT JOIN i ON i.source_file = d.source_file,
  unnest([
    'ingest: ' || d.source_file || ' (' || d.size_bytes || ' bytes)',
    'classify: ' || d.file_type,
    CASE WHEN d.file_type = 'csv' THEN 'profile: ' || x.n_rows || ' rows, ' || CASE WHEN x.drifted
      THEN 'drift detected (missing=[''amount'', ''category'', ''currency'', ''date'', ''merchant'', ''txn_id''], unexpected=[''amount_aed'', ''batch_note'', ''merchant_category'', ''merchant_name'', ''transaction_date'', ''transaction_id''])'
      ELSE 'schema matches baseline' END END,
    CASE WHEN d.file_type = 'csv' THEN CASE WHEN x.drifted
      THEN 'fix: ' || x.n_fixes || ' repair(s), ' || d.n_issues || ' unfixed issue(s)'
      ELSE 'fix: schema matches baseline; ' || x.n_fixes || ' value normalisation(s), ' || d.n_issues || ' unfixed' END END,
    CASE WHEN d.file_type = 'pdf' THEN 'extract_pdf: ' || length(i.raw_text) || ' chars of text' END,
    CASE WHEN d.file_type = 'pdf' THEN 'extract_records: ' || d.n_records || ' record(s) via regex, confidence=' || printf('%.2f', d.confidence) END,
    CASE WHEN d.file_type = 'email' THEN 'parse_email: 2 message(s)' END,
    CASE WHEN d.file_type <> 'unknown' THEN 'pii_scan: ' || d.n_findings || ' finding(s)' || CASE WHEN d.pii_types <> '' THEN ' [' || d.pii_types || ']' ELSE '' END END,
    CASE WHEN d.file_type <> 'unknown' THEN 'quality_gate: score=' || printf('%.2f', d.score) || ' -> ' || CASE WHEN d.score >= 0.75 THEN 'LOAD' ELSE 'REVIEW' END END,
    'decide: ' || CASE WHEN d.score >= 0.75 THEN 'LOAD' ELSE 'REVIEW' END || ' (score=' || printf('%.2f', d.score) || ')'
  ]) WITH ORDINALITY t(line, pos)
  WHERE line IS NOT NULL)"""

LOADED = "SELECT source_file FROM decisions WHERE score >= 0.75"

# Sparse hashed vectors of (id, text) rows in CTE ``src``; weights are unit length.
def hashed(src: str, out: str) -> str:
    return f"""
{out}_t AS (SELECT id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS token FROM {src}),
{out}_c AS (SELECT id, CAST(('0x' || md5(token))::UHUGEINT % 384 AS INT) AS bucket, count(*) AS n FROM {out}_t GROUP BY ALL),
{out} AS (SELECT id, bucket, n / sqrt(sum(CAST(n * n AS DOUBLE)) OVER (PARTITION BY id)) AS weight FROM {out}_c)"""
