"""Queries over the invoice-domain views: checks, decisions, hand-offs, reports and logs.

Each is one SQL statement that both Spark and DuckDB run; Catalyst plans it over the Parquet tables.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyweave.functions import ids, text
from tallyweave.plans.views import SPARK_VIEWS, SUPPLIER_TAX_ID, with_views
from tallyweave.sources.shared import folder

TABLES = "region nation customer supplier part orders lineitem events documents labels pages benchmark conversations".split()

CHECK = "SELECT id, name, status, kind, match_id FROM {}"
SQL = {
    "review_flagship": "SELECT id, outcome, confidence, n_hard, lead_rank FROM decisions",
    "check_completeness": CHECK.format("completeness"),
    "check_math": CHECK.format("math"),
    "check_duplicate": CHECK.format("duplicate"),
    "check_vendor": CHECK.format("vendor_check"),
    "check_po": CHECK.format("po_check"),
    "check_bank": CHECK.format("bank_check"),
    "check_tax": CHECK.format("tax_check"),
    "check_results": CHECK.format("checks"),
    "po_balance": "SELECT po_number, amount, invoiced, remaining FROM po_balance",
    "line_item_sums": "SELECT l_orderkey AS id, cast(n_lines AS bigint) AS n_lines, cast(sub AS double) AS line_sum FROM lines",
    "duplicate_same_hash": "SELECT d.doc_id AS id, min(h.doc_id) AS match_id FROM documents d JOIN documents h ON d.text = h.text AND h.doc_id < d.doc_id GROUP BY d.doc_id",
    "duplicate_same_number": "SELECT id, match_id, kind FROM same_number",
    "duplicate_amount_date": "SELECT id, match_id FROM same_amount_date",
    "bank_shared_account": "SELECT id, other FROM bank_shared",
    "bank_changed_vs_history": "SELECT id, same, last_id FROM bank_history",
    "decision_rollup": "SELECT outcome, confidence, count(*) AS n FROM decisions GROUP BY outcome, confidence",
    "lead_reason": "SELECT id, min_by(name, lead_rank) AS lead_check FROM ranked WHERE status IN ('fail', 'warn') GROUP BY id",
    "pros_cons": "SELECT id, cast(count_if(status = 'pass') AS bigint) AS pros, cast(count_if(status IN ('fail', 'warn')) AS bigint) AS cons, cast(count_if(status = 'skip') AS bigint) AS skipped FROM checks GROUP BY id",
    "stage_key": "SELECT id, stage FROM stages",
    "stage_counts": "SELECT r.stage, r.role, count(s.id) AS n FROM stage_roles r LEFT JOIN stages s ON s.stage = r.stage GROUP BY r.stage, r.role",
    "open_items": "SELECT c.id, c.name, c.status, c.kind FROM checks c JOIN stages s ON s.id = c.id WHERE s.stage <> 'done' AND c.status IN ('fail', 'warn')",
    "stage_changes": """SELECT a.id, a.stage AS now_stage, b.stage AS before_stage FROM stages a
        LEFT JOIN (SELECT id, CASE WHEN id % 3 = 0 THEN 'ap_review' ELSE stage END AS stage FROM stages WHERE id % 10 <> 0) b ON b.id = a.id
        WHERE a.stage <> 'done' AND a.stage IS DISTINCT FROM b.stage""",
    "mine": "SELECT s.id, s.stage FROM stages s LEFT SEMI JOIN (SELECT stage FROM stage_roles WHERE role = 'approver') r ON s.stage = r.stage",
    "status_counts": "SELECT d.status, count(i.id) AS n FROM (VALUES ('pending'), ('approved'), ('rejected')) AS d(status) LEFT JOIN live i ON i.status = d.status GROUP BY d.status",
    "outcome_crosstab": """SELECT outcome, cast(count_if(status = 'approved') AS bigint) AS approved, cast(count_if(status = 'rejected') AS bigint) AS rejected,
        cast(count_if(status = 'pending') AS bigint) AS pending FROM decisions GROUP BY outcome""",
    "overrides": """SELECT cast(count_if(decided_by NOT LIKE 'AI%' AND ((outcome = 'auto_approve' AND status <> 'approved') OR (outcome = 'reject' AND status = 'approved'))) AS bigint) AS overrides,
        cast(count_if(decided_by LIKE 'AI%' AND status = 'approved') AS bigint) AS ai_approved, cast(count_if(decided_by LIKE 'AI%' AND status = 'rejected') AS bigint) AS ai_rejected,
        cast(count_if(decided_by NOT LIKE 'AI%' AND status = 'approved') AS bigint) AS person_approved FROM decisions""",
    "overview_flow": "SELECT r.role, count(*) AS waiting FROM stages s JOIN stage_roles r ON r.stage = s.stage GROUP BY r.role",
    "overview_by_check": "SELECT name, count(*) AS n, min(id) AS first_seen FROM checks WHERE status = 'fail' GROUP BY name ORDER BY n DESC, first_seen",
    "overview_caught_top12": "SELECT id, total, currency FROM decisions WHERE outcome = 'reject' AND status <> 'approved' ORDER BY id DESC LIMIT 12",
    "value_by_currency": "SELECT coalesce(currency, '?') AS currency, count(*) AS n, cast(sum(cast(total AS decimal(18,2))) AS double) AS total FROM live WHERE total IS NOT NULL GROUP BY coalesce(currency, '?')",
    "protected_value": """SELECT coalesce(currency, '?') AS currency, cast(sum(cast(total AS decimal(18,2))) AS double) AS protected FROM decisions
        WHERE n_hard > 0 AND status <> 'approved' AND total IS NOT NULL GROUP BY coalesce(currency, '?')""",
    "waiting_by_stage": "SELECT stage, count(*) AS n FROM stages WHERE stage <> 'done' GROUP BY stage",
    "usage_daily": "SELECT cast(ts AS date) AS day, count(*) AS calls, cast(count_if(ok) AS bigint) AS ok, cast(sum(tokens) AS bigint) AS tokens, cast(sum(cost) AS double) AS cost FROM usage GROUP BY cast(ts AS date)",
    "usage_monthly": "SELECT extract(year FROM ts) * 100 + extract(month FROM ts) AS month, count(*) AS calls, cast(sum(tokens) AS bigint) AS tokens, cast(sum(cost) AS double) AS cost FROM usage GROUP BY extract(year FROM ts) * 100 + extract(month FROM ts)",
    "usage_by_model": "SELECT provider, model, count(*) AS calls, cast(sum(cost) AS double) AS cost FROM usage GROUP BY provider, model",
    "budget_flag": """SELECT id, calls_before >= 300 AS day_full, cost_before >= 100 AS month_full FROM (SELECT id,
        count(*) OVER (PARTITION BY cast(ts AS date) ORDER BY ts, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS calls_before,
        coalesce(sum(cost) OVER (PARTITION BY extract(year FROM ts) * 100 + extract(month FROM ts) ORDER BY ts, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS cost_before FROM usage) u""",
    "activity_feed": "SELECT a.id, a.actor, a.action, i.vendor FROM activity a LEFT JOIN invoices i ON i.id = a.invoice_id ORDER BY a.id DESC LIMIT 1000",
    "latest_request": "SELECT i.id, r.request_status, r.request_id FROM live i LEFT JOIN latest_request r ON r.invoice_id = i.id",
    "first_request": "SELECT p.po_number, min(r.request_id) AS request_id FROM pos p LEFT JOIN requests r ON r.po_number = p.po_number GROUP BY p.po_number",
    "requests_by_status": "SELECT status, count(*) AS n FROM requests GROUP BY status",
    "next_po_number": "SELECT greatest(6000, max(cast(regexp_extract(po_number, '^PO-([0-9]+)$', 1) AS bigint))) + 1 AS next_po FROM pos",
    "unread_notifications": """SELECT a.actor, count(*) AS n, cast(count_if(a.id > coalesce(s.last_id, 0)) AS bigint) AS unread FROM activity a
        LEFT JOIN (SELECT user_id AS actor, max(event_id) AS last_id FROM events WHERE event_type = 'view' GROUP BY user_id) s ON s.actor = a.actor GROUP BY a.actor""",
    "notifications_feed": "SELECT id, actor, action FROM activity WHERE action IN ('purchase', 'error') AND actor <> 7 ORDER BY id DESC LIMIT 30",
    "monotone_seen": "SELECT user_id, max(event_id) AS last_id FROM events GROUP BY user_id",
    "edits_fold": "SELECT user_id, max_by(event_type, event_id) AS last_type, max_by(value, event_id) AS last_value FROM events GROUP BY user_id",
    "replace_last_write": "SELECT user_id, event_type, event_id, value FROM (SELECT e.*, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) AS place FROM events e) x WHERE place = 1",
    "upsert_vendor": """SELECT coalesce(n.vendor, v.vendor) AS vendor, coalesce(n.name, v.name) AS name, coalesce(n.given_status, v.given_status) AS given_status, coalesce(n.bank_account, v.bank_account) AS bank_account
        FROM vendors v FULL OUTER JOIN (SELECT s_suppkey AS vendor, cast(NULL AS string) AS name, CASE WHEN s_suppkey % 2 = 0 THEN 'approved' END AS given_status, concat('NEW', cast(s_suppkey AS string)) AS bank_account
        FROM supplier WHERE s_suppkey % 9 = 0) n ON n.vendor = v.vendor""",
    "soft_delete": "SELECT id, status FROM invoices WHERE removed",
    "history_before": "SELECT i.id, count(h.id) AS earlier FROM live i LEFT JOIN live h ON h.vendor = i.vendor AND h.id < i.id GROUP BY i.id",
    "anti_unused_vendors": "SELECT v.vendor, v.name FROM vendors v LEFT ANTI JOIN (SELECT vendor FROM live WHERE status = 'approved' AND vendor % 3 <> 0) i ON i.vendor = v.vendor",
    "semi_known_vendors": "SELECT i.id, i.vendor FROM live i LEFT SEMI JOIN vendors v ON v.vendor = i.vendor",
    "search_q": """SELECT i.id, i.number FROM live i LEFT JOIN supplier s ON s.s_suppkey = i.vendor WHERE contains(lower(i.number), lower('V-00004')) OR contains(lower(cast(i.inv_date AS string)), '1995-03')
        OR contains(lower(s.s_name), lower('R#000000007')) OR contains(lower(concat('Scan_', cast(i.id AS string), '.PDF')), lower('_77.pdf'))""",
    "missing_to_pay": """SELECT * FROM (SELECT id, vendor IS NULL OR cast(vendor AS string) = '' AS no_vendor, total IS NULL AS no_total, currency IS NULL OR currency = '' AS no_currency FROM live) x
        WHERE no_vendor OR no_total OR no_currency""",
    "within_limit": """SELECT i.id, c.approval_limit IS NULL OR i.total IS NULL OR i.total <= c.approval_limit AS allowed FROM live i
        LEFT JOIN (SELECT c_custkey, CASE WHEN c_acctbal > 0 THEN cast(c_acctbal AS double) * 100 END AS approval_limit FROM customer) c ON c.c_custkey = i.cust""",
    "field_edits": """SELECT a.id, f.field, CASE f.field WHEN 'currency' THEN a.currency ELSE cast(a.po_number AS string) END AS old_value,
        CASE f.field WHEN 'currency' THEN CASE WHEN a.id % 5 = 1 THEN 'EUR' ELSE a.currency END ELSE CASE WHEN a.id % 7 = 1 THEN 'PO-1' ELSE a.po_number END END AS new_value
        FROM live a CROSS JOIN (VALUES ('currency'), ('po_number')) AS f(field)
        WHERE CASE f.field WHEN 'currency' THEN a.currency ELSE a.po_number END IS DISTINCT FROM
              CASE f.field WHEN 'currency' THEN CASE WHEN a.id % 5 = 1 THEN 'EUR' ELSE a.currency END ELSE CASE WHEN a.id % 7 = 1 THEN 'PO-1' ELSE a.po_number END END""",
    "sessions_by_gap": """SELECT user_id, cast(session AS bigint) AS session, count(*) AS n, min(event_id) AS first_id, max(event_id) AS last_id FROM (
        SELECT user_id, event_id, sum(opens) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS session FROM (
        SELECT user_id, event_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) <= INTERVAL '8' HOUR THEN 0 ELSE 1 END AS opens FROM events) e) s GROUP BY user_id, session""",
    "sliding_counts": """SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL '10' MINUTE PRECEDING AND CURRENT ROW) AS n FROM events""",
}

#: How Spark computes some of these: no self-join of texts or of a vendor's invoices, no month in one task. The statements above
#: remain their oracles.
SPARK_SQL = {
    "duplicate_same_hash": """SELECT d.doc_id AS id, f.first_id AS match_id FROM (SELECT doc_id, sha2(text, 256) AS hash FROM documents) d
        JOIN (SELECT sha2(text, 256) AS hash, min(doc_id) AS first_id FROM documents WHERE text IS NOT NULL GROUP BY sha2(text, 256) HAVING count(*) > 1) f ON f.hash = d.hash
        WHERE d.doc_id > f.first_id""",
    # what came before: within an hour by a window, before it by running sums over the hours of a day and a month
    "budget_flag": """SELECT e.id, e.calls + coalesce(h.calls_before, 0) >= 300 AS day_full, e.cost + coalesce(h.cost_before, 0) >= 100 AS month_full
        FROM (SELECT id, date_trunc('hour', ts) AS hour, count(*) OVER w AS calls, coalesce(sum(cost) OVER w, 0) AS cost FROM usage
              WINDOW w AS (PARTITION BY date_trunc('hour', ts) ORDER BY ts, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) e
        JOIN (SELECT hour, sum(calls) OVER (PARTITION BY cast(hour AS date) ORDER BY hour ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS calls_before,
                     sum(cost) OVER (PARTITION BY extract(year FROM hour) * 100 + extract(month FROM hour) ORDER BY hour ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS cost_before
              FROM (SELECT date_trunc('hour', ts) AS hour, count(*) AS calls, sum(cost) AS cost FROM usage GROUP BY date_trunc('hour', ts)) x) h ON h.hour = e.hour""",
}

# ranks within blocks of ids, after the counts of earlier blocks: no vendor is one task
SPARK_SQL["history_before"] = """SELECT r.id, cast(CASE WHEN r.vendor IS NULL THEN 0 ELSE r.place - 1 + coalesce(b.before, 0) END AS bigint) AS earlier
    FROM (SELECT id, vendor, block, rank() OVER (PARTITION BY vendor, block ORDER BY id) AS place FROM (SELECT id, vendor, cast(floor(id / 4096) AS bigint) AS block FROM live) x) r
    LEFT JOIN (SELECT vendor, block, sum(n) OVER (PARTITION BY vendor ORDER BY block ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before
    FROM (SELECT vendor, cast(floor(id / 4096) AS bigint) AS block, count(*) AS n FROM live GROUP BY vendor, cast(floor(id / 4096) AS bigint)) y) b ON b.vendor = r.vendor AND b.block = r.block"""

#: DuckDB writes two joins differently.
DIALECT = (("LEFT SEMI JOIN", "SEMI JOIN"), ("LEFT ANTI JOIN", "ANTI JOIN"))


def tax_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """supp, status and kind of the check of every supplier's tax id: none is skipped, a wrong GSTIN fails, other invalid ids warn."""
    given = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.col("s_suppkey").alias("supp"), F.expr(SUPPLIER_TAX_ID).alias("tax_id"))
    checked, none = given.withColumn("t", ids.tax_id(F.col("tax_id"))), text.missing(F.col("tax_id"))
    status = F.when(none, "skip").when(F.col("t.valid"), "pass").when(F.col("t.kind") == "GSTIN", "fail").otherwise("warn")
    return checked.select("supp", status.alias("status"), F.when(~none, F.col("t.kind")).alias("kind"))


#: Views that are written once where a statement uses them at least so often: Spark would work out each use anew.
WRITTEN, USES = "live", 3


def statement(spark: SparkSession, sf_dir: str, sql: str, views: dict[str, str] | None = None, tables: dict[str, DataFrame] | None = None) -> DataFrame:
    """sql over the views, more views if given, and the tables of a folder; tables stand in for views of their names."""
    tables = dict(tables or {})
    instead = SPARK_VIEWS | (views or {}) | dict.fromkeys(tables)
    whole = with_views(sql, instead)
    if len(re.findall(rf"\b(?:FROM|JOIN)\s+{WRITTEN}\b", whole)) >= USES:
        path = f"{folder(spark)}/{WRITTEN}"
        found = statement(spark, sf_dir, f"SELECT * FROM {WRITTEN}")
        found.write.parquet(path)
        tables[WRITTEN] = spark.read.schema(found.schema).parquet(path)
        whole = with_views(sql, instead | {WRITTEN: None})  # once, whatever else is written
    used = [t for t in (*TABLES, "tax_ids", *tables) if re.search(rf"\b(FROM|JOIN)\s+{t}\b", whole)]
    tables = {t: tables[t] if t in tables else tax_ids(spark, sf_dir) if t == "tax_ids" else spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in used}
    return spark.sql(re.sub(rf"\b(FROM|JOIN)(\s+)({'|'.join(used)})\b", r"\1\2{\3}", whole), **tables)


def query(name: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return statement(spark, sf_dir, SPARK_SQL.get(name, SQL[name]))

    run.__name__ = name
    return run


def oracle(name: str) -> str:
    sql = with_views(SQL[name])
    for ours, theirs in DIALECT:
        sql = sql.replace(ours, theirs)
    return sql


QUERIES = {name: query(name) for name in SQL}
ORACLE_SQL = {name: oracle(name) for name in SQL}
