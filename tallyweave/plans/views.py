"""Invoice-domain views over the standard tables, as SQL that Spark and DuckDB read alike.

orders and lineitem become invoices (a tampered total for every 97th), suppliers become vendors, customers'
orders become purchase orders, and events become usage and activity logs. Money is summed as DECIMAL and
then handed on as DOUBLE. Each view names the views it needs by using them.
"""

from __future__ import annotations

import re

#: Tax ids of suppliers: an Indian one (one in 36 with the right check character), an invalid Emirati one, none, else a German or an Emirati one.
SUPPLIER_TAX_ID = """CASE s_suppkey % 20 WHEN 0 THEN concat('06AABCO', lpad(cast(s_suppkey % 10000 AS string), 4, '0'), 'D1Z', substr('0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ', cast(s_suppkey * 7 % 36 AS int) + 1, 1))
    WHEN 18 THEN concat('200', lpad(cast(s_suppkey AS string), 12, '0')) WHEN 19 THEN NULL
    ELSE CASE WHEN s_suppkey % 2 = 0 THEN concat('DE', lpad(cast(s_suppkey AS string), 9, '0')) ELSE concat('100', lpad(cast(s_suppkey AS string), 12, '0')) END END"""

VIEWS = {
    "lines": """
SELECT l_orderkey, min(l_suppkey) AS supp, count(*) AS n_lines,
       sum(cast(l_extendedprice AS decimal(18,2))) AS sub,
       round(sum(cast(l_extendedprice AS decimal(18,2)) * cast(l_tax AS decimal(4,2))), 2) AS tax
FROM lineitem GROUP BY l_orderkey""",
    "invoices": """
SELECT o_orderkey AS id, o_custkey AS cust, supp,
       CASE WHEN o_orderkey % 211 = 0 THEN NULL ELSE concat('INV-', lpad(cast(o_orderkey - CASE WHEN o_orderkey % 50 = 0 AND o_orderkey > 1 THEN 1 ELSE 0 END AS string), 7, '0')) END AS number,
       CASE WHEN o_orderkey % 50 = 0 THEN supp - supp % 5 ELSE supp END AS vendor,
       cast(o_orderdate AS date) AS inv_date,
       CASE supp % 6 WHEN 0 THEN 'EUR' WHEN 1 THEN 'USD' WHEN 2 THEN 'INR' WHEN 3 THEN 'GBP' WHEN 4 THEN 'AED' WHEN 5 THEN 'PLN' END AS currency,
       cast(sub AS double) AS subtotal, cast(tax AS double) AS tax_amount,
       cast(CASE WHEN o_orderkey % 97 = 0 THEN round((sub + tax) * 1.1 + 7, 2) ELSE sub + tax END AS double) AS total,
       CASE o_orderstatus WHEN 'F' THEN 'approved' WHEN 'P' THEN 'rejected' ELSE 'pending' END AS status,
       CASE WHEN o_orderkey % 5 = 0 THEN NULL WHEN o_orderkey % 11 = 0 THEN concat('PO-9', cast(o_custkey AS string)) ELSE concat('PO-', cast(o_custkey AS string)) END AS po_number,
       CASE WHEN o_orderkey % 7 = 0 THEN NULL WHEN o_orderkey % 53 = 0 THEN 'ACX' || cast(supp AS string) ELSE 'ACC' || cast(supp - supp % 40 AS string) END AS bank_account,
       o_orderkey % 101 = 0 AS removed,
       CASE WHEN o_orderkey % 3 = 0 THEN NULL WHEN o_orderkey % 3 = 1 THEN 'AI copilot' ELSE 'Dana' END AS decided_by,
       o_orderkey % 4 <> 0 AS ap_ok, o_orderpriority AS priority
FROM orders LEFT JOIN lines ON l_orderkey = o_orderkey""",
    "live": "SELECT * FROM invoices WHERE NOT removed",
    "vendors": """
SELECT s_suppkey AS vendor, s_name AS name,
       CASE s_suppkey % 10 WHEN 0 THEN 'rejected' WHEN 1 THEN 'pending' WHEN 2 THEN 'verified' WHEN 3 THEN NULL ELSE 'approved' END AS given_status,
       CASE WHEN s_suppkey % 6 = 0 THEN NULL ELSE concat('ACC', cast(s_suppkey - s_suppkey % 40 AS string)) END AS bank_account
FROM supplier WHERE s_suppkey % 13 <> 0""",
    "pos": """
SELECT concat('PO-', cast(o_custkey AS string)) AS po_number, min(o_orderkey) % 100 AS vendor_tag,
       cast(sum(cast(o_totalprice AS decimal(18,2))) / 2 AS double) AS amount
FROM orders GROUP BY o_custkey""",
    "po_invoiced": """
SELECT po_number, cast(sum(cast(total AS decimal(18,2))) AS double) AS invoiced
FROM live WHERE status = 'approved' AND total IS NOT NULL AND total <> 0 AND po_number IS NOT NULL GROUP BY po_number""",
    "po_balance": """
SELECT p.po_number, p.amount, coalesce(i.invoiced, 0.0) AS invoiced, p.amount - coalesce(i.invoiced, 0.0) AS remaining
FROM pos p LEFT JOIN po_invoiced i ON p.po_number = i.po_number""",
    "completeness": """
SELECT id, 'completeness' AS name,
       CASE WHEN number IS NULL OR number = '' OR total IS NULL THEN 'fail' WHEN vendor IS NULL OR inv_date IS NULL OR currency IS NULL OR currency = '' THEN 'warn' ELSE 'pass' END AS status,
       cast(NULL AS string) AS kind, cast(NULL AS bigint) AS match_id
FROM live""",
    "math": """
SELECT id, 'math' AS name,
       CASE WHEN total IS NOT NULL AND total <= 0 THEN 'fail' WHEN subtotal IS NULL OR tax_amount IS NULL OR total IS NULL THEN 'skip'
            WHEN abs(subtotal + tax_amount - total) > 0.02 THEN 'fail' ELSE 'pass' END AS status,
       cast(NULL AS string) AS kind, cast(NULL AS bigint) AS match_id
FROM live""",
    "same_number": """
SELECT i.id, min(h.id) AS match_id, min_by(CASE WHEN abs(i.total - h.total) > 0.02 THEN 'same_number_different_amount' ELSE 'same_number' END, h.id) AS kind
FROM live i JOIN live h ON i.vendor = h.vendor AND i.number = h.number AND h.id < i.id GROUP BY i.id""",
    "same_amount_date": """
SELECT i.id, min(h.id) AS match_id
FROM live i JOIN live h ON i.vendor = h.vendor AND i.inv_date = h.inv_date AND h.id < i.id
WHERE abs(i.total - h.total) <= CASE WHEN i.number IS NULL THEN 0.02 ELSE greatest(0.02, 0.005 * abs(h.total)) END AND (i.number IS NULL OR h.number IS NULL OR i.number <> h.number)
GROUP BY i.id""",
    "duplicate": """
SELECT i.id, 'duplicate' AS name, CASE WHEN s.id IS NOT NULL THEN 'fail' WHEN a.id IS NOT NULL THEN 'warn' WHEN i.number IS NULL THEN 'skip' ELSE 'pass' END AS status,
       CASE WHEN s.id IS NOT NULL THEN s.kind WHEN a.id IS NOT NULL THEN 'same_amount_date' END AS kind,
       cast(coalesce(s.match_id, a.match_id) AS bigint) AS match_id
FROM live i LEFT JOIN same_number s ON s.id = i.id LEFT JOIN same_amount_date a ON a.id = i.id""",
    "vendor_check": """
SELECT i.id, 'vendor' AS name,
       CASE WHEN i.vendor IS NULL THEN 'skip' WHEN v.vendor IS NULL THEN 'warn'
            WHEN coalesce(v.given_status, 'approved') = 'rejected' THEN 'fail' WHEN coalesce(v.given_status, 'approved') = 'approved' THEN 'pass' ELSE 'warn' END AS status,
       CASE WHEN i.vendor IS NULL THEN NULL WHEN v.vendor IS NULL THEN 'new' WHEN v.given_status = 'verified' THEN 'awaiting_approval'
            WHEN v.given_status IN ('rejected', 'pending') THEN v.given_status END AS kind, cast(NULL AS bigint) AS match_id
FROM live i LEFT JOIN vendors v ON v.vendor = i.vendor""",
    "po_check": """
SELECT i.id, 'po_match' AS name,
       CASE WHEN i.po_number IS NULL THEN 'skip' WHEN b.po_number IS NULL THEN 'warn' WHEN i.total > b.remaining * 1.02 + 0.02 THEN 'fail'
            WHEN i.total > b.remaining + 0.02 THEN 'warn' ELSE 'pass' END AS status,
       CASE WHEN i.po_number IS NOT NULL AND b.po_number IS NULL THEN 'po_unknown' END AS kind, cast(NULL AS bigint) AS match_id
FROM live i LEFT JOIN po_balance b ON b.po_number = i.po_number""",
    "bank_history": """
SELECT i.id, bool_or(h.bank_account = i.bank_account) AS same, max(h.id) AS last_id
FROM live i JOIN live h ON h.vendor = i.vendor AND h.id < i.id AND h.status = 'approved' AND h.bank_account IS NOT NULL
WHERE i.bank_account IS NOT NULL GROUP BY i.id""",
    "bank_shared": """
SELECT i.id, min(v.name) AS other FROM live i JOIN vendors v ON v.bank_account = i.bank_account AND v.vendor <> i.vendor GROUP BY i.id""",
    "bank_check": """
SELECT i.id, 'bank' AS name,
       CASE WHEN i.bank_account IS NULL THEN 'skip' WHEN v.bank_account = i.bank_account THEN 'pass' WHEN v.bank_account IS NOT NULL THEN 'fail'
            WHEN h.same = false THEN 'fail' WHEN s.id IS NOT NULL THEN 'warn' WHEN h.id IS NOT NULL THEN 'pass' WHEN v.vendor IS NOT NULL THEN 'warn' ELSE 'pass' END AS status,
       CASE WHEN i.bank_account IS NULL OR v.bank_account = i.bank_account THEN NULL WHEN v.bank_account IS NOT NULL OR h.same = false THEN 'changed'
            WHEN s.id IS NOT NULL THEN 'shared' WHEN h.id IS NULL AND v.vendor IS NOT NULL THEN 'new' END AS kind, cast(NULL AS bigint) AS match_id
FROM live i LEFT JOIN vendors v ON v.vendor = i.vendor LEFT JOIN bank_history h ON h.id = i.id LEFT JOIN bank_shared s ON s.id = i.id""",
    # DuckDB's statement of the check of supplier tax ids; Spark takes it from functions.ids
    "tax_ids": f"""
SELECT supp, CASE WHEN tax_id IS NULL THEN 'skip' WHEN regexp_matches(tax_id, '^(100[0-9]{{12}}|DE[0-9]{{9}})$') THEN 'pass' WHEN NOT contains(tax_id, 'AABCO') THEN 'warn'
            WHEN right(tax_id, 1) = substr('0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ', cast((36 - total % 36) % 36 AS int) + 1, 1) THEN 'pass' ELSE 'fail' END AS status,
       CASE WHEN contains(tax_id, 'AABCO') THEN 'GSTIN' WHEN starts_with(tax_id, 'DE') THEN 'EU_VAT' WHEN tax_id IS NOT NULL THEN 'UAE_TRN' END AS kind
FROM (SELECT supp, tax_id, list_sum(list_transform(list_transform(range(1, 15), lambda i: (strpos('0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ', substr(tax_id, i, 1)) - 1) * (1 + (i - 1) % 2)), lambda p: p // 36 + p % 36)) AS total
      FROM (SELECT s_suppkey AS supp, {SUPPLIER_TAX_ID} AS tax_id FROM supplier) x) y""",
    "tax_check": """
SELECT i.id, 'tax_id' AS name, coalesce(t.status, 'skip') AS status, t.kind, cast(NULL AS bigint) AS match_id
FROM live i LEFT JOIN tax_ids t ON t.supp = i.supp""",
    "checks": """
SELECT * FROM completeness UNION ALL SELECT * FROM math UNION ALL SELECT * FROM duplicate UNION ALL SELECT * FROM vendor_check
UNION ALL SELECT * FROM po_check UNION ALL SELECT * FROM bank_check UNION ALL SELECT * FROM tax_check""",
    "ranked": """
SELECT c.*, CASE name WHEN 'bank' THEN 0 WHEN 'completeness' THEN 1 WHEN 'vendor' THEN 2 WHEN 'duplicate' THEN 3 WHEN 'math' THEN 4 WHEN 'po_match' THEN 5 ELSE 6 END AS lead_rank,
       status = 'fail' AND name <> 'completeness' AS hard,
       CASE WHEN name IN ('completeness', 'math', 'duplicate', 'vendor') THEN status <> 'pass' ELSE status NOT IN ('pass', 'skip') END AS blocks
FROM checks c""",
    "rollup": """
SELECT id, count_if(hard) AS n_hard, min(CASE WHEN hard THEN lead_rank END) AS hard_lead, bool_or(blocks) AS blocked, bool_or(status IN ('fail', 'warn')) AS not_ok,
       min(CASE WHEN status IN ('fail', 'warn') THEN lead_rank END) AS lead_problem
FROM ranked GROUP BY id""",
    "decisions": """
SELECT i.id, i.status, i.total, i.currency, i.decided_by,
       CASE WHEN r.n_hard > 0 THEN 'reject' WHEN NOT r.blocked AND NOT r.not_ok AND coalesce(i.total, 0) <= 50000 THEN 'auto_approve' ELSE 'needs_review' END AS outcome,
       CASE WHEN r.n_hard > 1 OR r.hard_lead IN (0, 3, 4) THEN 'high' WHEN r.n_hard > 0 THEN 'medium' WHEN NOT r.blocked AND NOT r.not_ok AND coalesce(i.total, 0) <= 50000 THEN 'high'
            WHEN r.not_ok THEN 'low' ELSE 'medium' END AS confidence,
       cast(r.n_hard AS bigint) AS n_hard, cast(coalesce(r.hard_lead, r.lead_problem) AS bigint) AS lead_rank
FROM live i JOIN rollup r ON r.id = i.id""",
    # the log's errors are no requests: they never reach the order book
    "requests": """
SELECT event_id AS request_id, 1 + user_id * 7 % 1500 AS invoice_id, CASE event_type WHEN 'click' THEN 'requested' WHEN 'view' THEN 'prepared' WHEN 'purchase' THEN 'approved' ELSE 'rejected' END AS status,
       concat('PO-', cast(user_id AS string)) AS po_number, value AS amount
FROM events WHERE event_type <> 'error'""",
    "latest_request": "SELECT invoice_id, max_by(status, request_id) AS request_status, max(request_id) AS request_id FROM requests GROUP BY invoice_id",
    "stages": """
SELECT i.id, CASE WHEN i.status <> 'pending' THEN 'done' WHEN NOT i.ap_ok THEN 'ap_review'
       WHEN v.status = 'warn' AND v.kind = 'pending' THEN 'vendor_verify' WHEN v.status = 'warn' AND v.kind = 'awaiting_approval' THEN 'vendor_approve'
       WHEN p.kind = 'po_unknown' THEN CASE WHEN r.request_status = 'prepared' THEN 'po_approval' ELSE 'po_missing' END ELSE 'approval' END AS stage
FROM live i JOIN vendor_check v ON v.id = i.id JOIN po_check p ON p.id = i.id LEFT JOIN latest_request r ON r.invoice_id = i.id""",
    "stage_roles": """
SELECT * FROM (VALUES ('ap_review', 'ap'), ('vendor_verify', 'procurement'), ('vendor_approve', 'approver'), ('po_approval', 'approver'), ('po_missing', 'procurement'),
  ('receipt', 'procurement'), ('approval', 'approver')) AS t(stage, role)""",
    "usage": """
SELECT event_id AS id, ts, event_type AS provider, concat('m', cast(user_id % 4 AS string)) AS model, cast(regexp_extract(props, '([0-9]+)', 1) AS bigint) AS tokens,
       cast(value AS decimal(18,4)) AS cost, event_type <> 'error' AS ok
FROM events""",
    "activity": "SELECT event_id AS id, ts, user_id AS actor, event_type AS action, 1 + event_id % 2000 AS invoice_id FROM events",
}


#: How Spark computes some views: running windows and aggregates by key in place of the self-joins that state them above.
SPARK_VIEWS = {
    "tax_ids": None,  # a DataFrame, see reports.statement
    "same_number": """
SELECT id, first_id AS match_id, CASE WHEN abs(total - first_total) > 0.02 THEN 'same_number_different_amount' ELSE 'same_number' END AS kind
FROM (SELECT l.id, l.total, f.first_id, f.first_total FROM live l
      JOIN (SELECT vendor, number, min(id) AS first_id, min_by(total, id) AS first_total FROM live WHERE vendor IS NOT NULL AND number IS NOT NULL GROUP BY vendor, number HAVING count(*) > 1) f
        ON f.vendor = l.vendor AND f.number = l.number) x
WHERE id > first_id""",
    "bank_history": """
SELECT l.id, coalesce(a.first_id < l.id, false) AS same, max(p.last_id) AS last_id
FROM live l JOIN bank_runs p ON p.vendor = l.vendor AND p.block = cast(floor(l.id / 4096) AS bigint) AND p.id = l.id
LEFT JOIN (SELECT vendor, bank_account, min(id) AS first_id FROM live WHERE status = 'approved' AND bank_account IS NOT NULL GROUP BY vendor, bank_account) a
  ON a.vendor = l.vendor AND a.bank_account = l.bank_account
WHERE l.bank_account IS NOT NULL AND p.last_id IS NOT NULL GROUP BY l.id, coalesce(a.first_id < l.id, false)""",
    # the last earlier approved invoice with an account: within a block of ids by a window, before it by the blocks' largest ids
    "bank_runs": """
SELECT w.id, w.vendor, w.block, coalesce(w.inside, b.before) AS last_id
FROM (SELECT id, vendor, block, max(known) OVER (PARTITION BY vendor, block ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS inside FROM bank_known) w
LEFT JOIN (SELECT vendor, block, max(known) OVER (PARTITION BY vendor ORDER BY block ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before
           FROM (SELECT vendor, block, max(known) AS known FROM bank_known GROUP BY vendor, block) y) b ON b.vendor = w.vendor AND b.block = w.block""",
    "bank_known": """
SELECT id, vendor, cast(floor(id / 4096) AS bigint) AS block, CASE WHEN status = 'approved' AND bank_account IS NOT NULL THEN id END AS known FROM live WHERE vendor IS NOT NULL""",
}


def with_views(sql: str, instead: dict[str, str | None] | None = None) -> str:
    """sql with the views that it uses, directly or through others, as common table expressions; views may be
    stated otherwise, or be tables (None)."""
    views, needed = {n: v for n, v in (VIEWS | (instead or {})).items() if v is not None}, []

    def visit(text: str) -> None:
        for name in views:
            if re.search(rf"\b(FROM|JOIN)\s+{name}\b", text) and name not in needed:
                visit(views[name])
                if name not in needed:
                    needed.append(name)

    visit(sql)
    return "WITH " + ",\n".join(f"{n} AS ({views[n]})" for n in needed) + "\n" + sql if needed else sql
