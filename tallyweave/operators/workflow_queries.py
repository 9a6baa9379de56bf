"""Queries over vendors' histories, guards, readings under a budget, evidence on pages, and records of several schemas.

The oracles go one action, or one document, after another in recursive queries, or state where things were printed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyweave.functions import answers
from tallyweave.operators import cascade, evidence, guards, layout, matching, review, vendor_states
from tallyweave.plans.reports import statement
from tallyweave.plans.views import SUPPLIER_TAX_ID, with_views
from tallyweave.sources import generations, printed
from tallyweave.sources.generations import Field
from tallyweave.sources.shared import folder
from tallyweave.streaming.recheck import Recheck

#: What the event log does to vendors: an action, who acts, in which role, and why.
ACTIONS = """SELECT user_id AS vendor, event_id AS seq, action, concat('p', cast(event_id * 7 % 5 AS string)) AS actor,
    CASE WHEN event_id % 9 = 0 THEN 'viewer' WHEN action = 'propose' THEN 'ap' WHEN action IN ('approve', 'reject') THEN 'approver' ELSE 'procurement' END AS role, CASE WHEN event_id % 2 = 0 THEN 'why' END AS note
    FROM (SELECT e.*, CASE (event_id * 13 + user_id) % 12 WHEN 2 THEN 'verify' WHEN 3 THEN 'verify' WHEN 4 THEN 'verify' WHEN 5 THEN 'refuse' WHEN 6 THEN 'approve' WHEN 7 THEN 'approve' WHEN 8 THEN 'approve'
                      WHEN 9 THEN 'reject' WHEN 10 THEN 'add' ELSE 'propose' END AS action FROM events e) x"""


def vendor_state_history(spark, sf_dir):
    """The state of each vendor after every action, and why an action was refused."""
    return vendor_states.histories(statement(spark, sf_dir, ACTIONS), block=256)


#: Who looks at an invoice, and who touched it.
ASKED = """SELECT i.id, i.status, s.stage, i.id % 103 = 0 AS removed, i.total, CASE i.id % 5 WHEN 0 THEN 'ap' WHEN 1 THEN 'approver' WHEN 2 THEN 'procurement' WHEN 3 THEN 'admin' ELSE 'approver' END AS role,
    cast(i.id % 9 AS string) AS name, cast(i.id % 7 AS string) AS uploader, CASE WHEN i.id % 4 > 0 THEN cast(40000.0 * (i.id % 4) AS double) END AS approval_limit FROM live i JOIN stages s ON s.id = i.id"""


def invoice_guards(spark, sf_dir):
    """Why a person may not review, approve, remove or edit an invoice; null where they may."""
    asked = statement(spark, sf_dir, ASKED)
    c = F.col
    return asked.select(
        "id", guards.review(c("role"), c("stage")).alias("review"), guards.approve(c("role"), c("name"), c("approval_limit"), c("removed"), F.array("uploader"), c("total")).alias("approve"),
        guards.remove(c("role"), c("removed"), c("status")).alias("remove"), guards.edit(c("role"), c("removed"), c("stage")).alias("edit"),
    )


ORDERS = """SELECT request_id, status, amount, concat('p', cast(request_id % 5 AS string)) AS requested_by, CASE WHEN request_id % 3 > 0 THEN concat('p', cast(request_id % 4 AS string)) END AS prepared_by,
    CASE WHEN request_id % 6 = 0 THEN 'procurement' ELSE 'approver' END AS role, concat('p', cast(request_id % 11 AS string)) AS name, CASE WHEN request_id % 2 = 0 THEN cast(50 AS double) END AS approval_limit FROM requests"""


def order_guards(spark, sf_dir):
    """Why a person may not approve an order."""
    c = F.col
    return statement(spark, sf_dir, ORDERS).select("request_id", guards.approve_request(c("role"), c("name"), c("approval_limit"), c("status"), c("amount"), c("requested_by"), c("prepared_by")).alias("reason"))


#: Documents to read, by the event log, and what three models answer for each text.
READINGS = """SELECT key, tier, (key * 3 + tier) % 4 <> 0 AS ok, (key + tier) % 3 = 0 AS complete, cast(key * tier % 10 AS int) AS score, cast(key % 5 * tier AS double) / 64 AS cost
    FROM (SELECT DISTINCT user_id % 211 AS key FROM events WHERE user_id % 13 <> 0) k CROSS JOIN (VALUES (1), (2), (3)) AS t(tier)"""
CALLS, BUDGET = 7, 3.0


def budgeted_readings(spark, sf_dir):
    """Which documents are read, found in the cache, or refused for the day's calls or the month's cost."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("at", F.col("ts").cast("timestamp"))
    documents = events.select((F.unix_timestamp("at") * 1_000_000_000 + F.col("event_id")).alias("seq"), "at", (F.col("user_id") % 211).alias("key"))
    return cascade.read_under_budget(documents, statement(spark, sf_dir, READINGS), CALLS, BUDGET, block=3600 * 1_000_000_000)


WIDTH, HEIGHT = 595.0, 842.0


def evidence_marks(spark, sf_dir):
    """Where the total, the number and the account of each printed invoice stand on its page."""
    facts = statement(spark, sf_dir, "SELECT id, total, printed_number, bank_account, way, iban, digits FROM facts", printed.PRINTED)
    some = lambda c: F.array(F.coalesce(c, F.lit("")))
    account = F.when(F.col("bank_account").isNull(), "").when(F.col("way") == 2, F.col("iban")).otherwise(F.col("digits"))
    item = lambda name, needles, amount: F.struct(F.lit(name).alias("item"), needles.alias("needles"), F.lit(amount).alias("numeric"), F.lit(amount).alias("lowest"))
    items = F.array(item("total", evidence.amount_forms(F.col("total")), True), item("number", some(F.col("printed_number")), False), item("bank", some(account), False))
    needles = facts.select(F.col("id").alias("doc_id"), F.inline(items))
    found = evidence.find(needles, layout.lines(printed.printed_words(spark, sf_dir), dealt=True), WIDTH, HEIGHT)
    return found.select("doc_id", "item", "page", *(F.round(c, 6).alias(c) for c in ("x", "y", "w", "h")))


VENDOR = [Field("name", "string"), Field("tax_id", "string", before=("tax",)), Field("status", "string", "approved"), Field("bank_account", "string"), Field("score", "int", 0)]


def schema_generations(spark, sf_dir):
    """Vendors that were stored under three schemas, read as one table."""
    at = folder(spark, "vendors")
    supplier = spark.read.parquet(f"{sf_dir}/supplier.parquet")
    key = F.col("s_suppkey")
    old = supplier.filter(key % 3 == 0).select(F.col("s_name").alias("name"), F.concat(F.lit("T"), key.cast("string")).alias("tax"), F.lit("x@y").alias("email_domains"))
    later = supplier.filter(key % 3 == 1).select(F.col("s_name").alias("name"), F.concat(F.lit("T"), key.cast("string")).alias("tax_id"), F.when(key % 2 == 0, "rejected").when(key % 5 == 0, "").alias("status"))
    now = supplier.filter(key % 3 == 2).select(F.col("s_name").alias("name"), F.concat(F.lit("T"), key.cast("string")).alias("tax_id"), F.lit("pending").alias("status"), F.concat(F.lit("ACC"), key.cast("string")).alias("bank_account"), F.concat(key.cast("string"), F.when(key % 7 == 0, "?").otherwise("")).alias("score"))
    folders = [f"{at}/{k}" for k in range(3)]
    for f, rows in zip(folders, (old, later, now), strict=True):
        rows.write.json(f)
    return generations.read_generations(spark, folders, VENDOR)


def truth_records(spark, sf_dir):
    """The facts of printed invoices, from JSON files that hold an object of many documents and notes."""
    at = f"{folder(spark, 'truth')}/objects"
    facts = statement(spark, sf_dir, "SELECT id, number, total FROM facts", printed.PRINTED)
    pair = F.concat(F.lit('"'), F.col("id").cast("string"), F.lit('":'), F.to_json(F.struct("number", "total")))
    files = facts.groupBy(F.floor(F.col("id") / 500).alias("file")).agg(F.concat(F.lit('{"_note": "by hand", '), F.array_join(F.collect_list(pair), ",\n"), F.lit("}")).alias("value"))
    files.write.partitionBy("file").text(at)
    return generations.keyed_objects(spark, f"{at}/*", "struct<number:string,total:double>").select(F.col("key").cast("long").alias("id"), "value.number", "value.total")


#: Invoices with what the checks in full compare: names in several spellings, repeats of the order before, changed accounts, printed charges, receipts.
CLAIMS = f"""SELECT l.id, CASE WHEN l.id % 29 = 0 THEN NULL WHEN l.id % 10 = 3 THEN upper(vendor_name) ELSE vendor_name END AS vendor,
    CASE WHEN number IS NULL THEN '' WHEN l.id % 8 = 1 THEN lower(replace(number, '-', ' ')) WHEN l.id % 150 = 0 THEN concat(number, '7') ELSE number END AS number, cast(day AS date) AS inv_date, currency, subtotal, tax_amount,
    total + CASE WHEN l.id % 12 = 5 THEN 12.5 WHEN l.id % 100 = 0 THEN 100.0 ELSE 0.0 END AS total, CASE WHEN l.id % 41 = 0 THEN 'DE999999999' ELSE tax_id END AS tax_id,
    CASE WHEN l.id % 3 = 0 THEN lower(po_number) ELSE po_number END AS po_number, CASE WHEN l.id % 67 = 0 THEN 'NL50INGB0683251300' WHEN bank_account LIKE 'ACX%' THEN concat('99', digits) ELSE digits END AS bank_account, status,
    concat('h', cast(CASE WHEN l.id % 91 = 0 THEN l.id - 1 ELSE l.id END AS string)) AS file_hash, CASE WHEN l.id % 12 = 5 THEN 'Shipping 12.50' END AS doc_text, l.id % 17 = 0 AS ocr,
    CASE WHEN l.id % 31 = 0 THEN subtotal + 5 WHEN l.id % 2 = 0 THEN subtotal END AS line_sum, CASE WHEN l.id % 14 = 0 THEN l.id % 28 <> 0 END AS receipt, l.id % 422 = 0 AS waives
    FROM (SELECT f.*, i.status FROM repeated f JOIN live i ON i.id = f.id) l"""
#: Every fiftieth invoice repeats the one before it.
REPEATED = "SELECT a.id, coalesce(b.vendor_name, a.vendor_name) AS vendor_name, coalesce(b.number, a.number) AS number, a.currency, coalesce(b.subtotal, a.subtotal) AS subtotal, coalesce(b.tax_amount, a.tax_amount) AS tax_amount, coalesce(b.total, a.total) AS total, CASE WHEN a.id % 100 = 50 THEN coalesce(b.day, a.day) ELSE a.day END AS day, a.tax_id, a.po_number, a.bank_account, a.digits FROM facts a LEFT JOIN facts b ON b.id = CASE WHEN a.id % 50 = 0 THEN a.id - 1 END"
#: How Spark joins them: other invoices meet by their own id and fail the condition, as a null key would put all of them into one task.
SPARK_REPEATED = REPEATED.replace("CASE WHEN a.id % 50 = 0 THEN a.id - 1 END", "CASE WHEN a.id % 50 = 0 THEN a.id - 1 ELSE a.id END AND a.id % 50 = 0")
LISTED = f"""SELECT {printed.VENDOR_NAME.format('s_suppkey')} AS name, {SUPPLIER_TAX_ID} AS tax_id, CASE s_suppkey % 10 WHEN 0 THEN 'rejected' WHEN 1 THEN 'pending' WHEN 2 THEN 'verified' WHEN 3 THEN NULL ELSE 'approved' END AS status,
    CASE WHEN s_suppkey % 6 = 0 THEN NULL WHEN s_suppkey % 11 = 0 THEN 'Direct debit' ELSE concat('77', lpad(cast(s_suppkey - s_suppkey % 40 AS string), 8, '0')) END AS bank_account FROM supplier WHERE s_suppkey % 13 <> 0"""
PLACED = f"""SELECT b.po_number, {printed.VENDOR_NAME.format('(1 + length(b.po_number) * 7)')} AS vendor, CASE WHEN b.amount > 900000 THEN 'EUR' END AS currency, b.amount, b.invoiced FROM po_balance b"""


def _claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statement(spark, sf_dir, CLAIMS, printed.PRINTED | {"repeated": SPARK_REPEATED})


def duplicate_any_vendor(spark, sf_dir):
    """The first earlier invoice of any vendor with the same date, amount and (almost) the same number."""
    return matching.any_vendor_duplicates(_claims(spark, sf_dir).select("id", F.nullif("number", F.lit("")).alias("number"), "total", "inv_date"))


def _reviewed(spark: SparkSession, sf_dir: str) -> DataFrame:
    claims = _claims(spark, sf_dir)
    waived = F.when(F.col("waives"), F.array(F.lit("number"), F.lit("inv_date")))
    claims = claims.withColumn("waived", waived).drop("waives")
    # the checks look at the invoices from many sides: they are worked out once
    claims.write.parquet(at := f"{folder(spark, 'claims')}/invoices")
    return review.review(spark.read.schema(claims.schema).parquet(at), statement(spark, sf_dir, LISTED), statement(spark, sf_dir, PLACED))


def review_in_full(spark, sf_dir):
    """All seven checks of every invoice, with names as they were read."""
    return review.checks(_reviewed(spark, sf_dir))


def recommendations(spark, sf_dir):
    """The recommendation for every invoice, with its reasons in the order in which they are told."""
    return review.decide(_reviewed(spark, sf_dir)).withColumn("reasons", F.array_join("reasons", ","))


#: Changes of vendors and orders, by the event log.
CHANGES = """SELECT CASE WHEN event_type = 'view' THEN 'order' ELSE 'vendor' END AS kind, CASE WHEN event_type = 'view' THEN concat('PO-', cast(user_id AS string)) ELSE cast(user_id % 40 AS string) END AS key, event_id AS seq,
    CASE WHEN event_type <> 'view' THEN CASE event_id % 4 WHEN 0 THEN 'approved' WHEN 1 THEN 'pending' WHEN 2 THEN 'verified' ELSE 'rejected' END END AS status, CASE WHEN event_type = 'view' THEN value * 1000 END AS remaining FROM events"""
WAITING = "SELECT id, vendor, po_number, total FROM live WHERE status = 'pending'"


def recheck_after_changes(spark, sf_dir):
    """Pending invoices as they stand after a stream of changes, of which each reached invoice was checked again."""
    at = folder(spark, "recheck")
    kept = Recheck(spark, at, 16)
    kept.begin(statement(spark, sf_dir, WAITING), statement(spark, sf_dir, "SELECT vendor, given_status AS status FROM vendors"), statement(spark, sf_dir, "SELECT po_number, remaining FROM po_balance"))
    statement(spark, sf_dir, CHANGES).write.parquet(f"{at}/changes")
    schema = spark.read.parquet(f"{at}/changes").schema
    query = kept.follow(spark.readStream.schema(schema).parquet(f"{at}/changes"), f"{at}/checkpoint")
    query.awaitTermination()
    return kept.results.get()


#: What a model answers for a printed invoice: plain, in fences, in prose, or cut off; numbers as numbers or as printed.
ANSWERS = f"""SELECT id, CASE id % 5 WHEN 0 THEN body WHEN 1 THEN concat('```json', chr(10), body, chr(10), '```') WHEN 2 THEN concat('Here it is: ', body, ' as asked.') WHEN 3 THEN substr(body, 1, 40) ELSE concat('[', body, ']') END AS answer
    FROM (SELECT id, concat(chr(123), '"vendor": "', vendor_name, '", "invoice_number": ', CASE WHEN number IS NULL THEN 'null' ELSE concat('" ', printed_number, ' "') END, ', "invoice_date": "', CASE WHEN id % 2 = 0 THEN day ELSE concat(substr(day, 9, 2), '.', substr(day, 6, 2), '.', substr(day, 1, 4)) END,
        '", "currency": "', CASE WHEN id % 3 = 0 THEN '€' ELSE lower(currency) END, '", "total": ', CASE WHEN id % 2 = 0 THEN cast(cast(total AS decimal(18,2)) AS string) ELSE concat('"€ ', {printed._amount("total")}, '"') END, ', "subtotal": "", "po_number": [], "line_items": [', chr(123), '"description": "x", "amount": "1,50"', chr(125), ', 7]', chr(125)) AS body FROM facts) b"""


def model_answers(spark, sf_dir):
    """The fields of models' answers."""
    read = statement(spark, sf_dir, ANSWERS, printed.PRINTED).withColumn("f", answers.coerced(answers.answer_object(F.col("answer"))))
    item = F.get("f.line_items", F.lit(0))["amount"]
    return read.select("id", "f.vendor", "f.invoice_number", F.col("f.invoice_date").cast("string").alias("invoice_date"), "f.currency", "f.total", "f.subtotal", "f.po_number", F.size("f.line_items").alias("n_items"), item.alias("item"))


def invoice_labels(spark, sf_dir):
    """How each invoice is called in messages."""
    c = F.col
    return _claims(spark, sf_dir).select("id", answers.label(c("id"), c("number"), c("vendor"), c("total"), c("currency")).alias("label"))


def vendor_suggestions(spark, sf_dir):
    """The card of a new vendor, filled from an invoice, with its tax id and account checked."""
    rows = _claims(spark, sf_dir).withColumns({"t": answers.tax_check(F.col("tax_id")), "bank_valid": answers.account_check(F.col("bank_account"))})
    return rows.select("id", "vendor", "tax_id", F.col("t.kind").alias("tax_kind"), F.col("t.valid").alias("tax_valid"), "bank_account", "bank_valid")


def existing_vendor(spark, sf_dir):
    """For a name that someone proposes, the vendor that is already on the list under (almost) the same one."""
    names = statement(spark, sf_dir, LISTED).select("name")
    proposed = statement(spark, sf_dir, f"SELECT s_suppkey AS id, upper({printed.VENDOR_NAME.format('s_suppkey')}) AS vendor FROM supplier")
    return matching.first_vendor(proposed, names, 92).select("id", "vendor", "match")


QUERIES = {f.__name__: f for f in (model_answers, invoice_labels, vendor_suggestions, existing_vendor, duplicate_any_vendor, review_in_full, recommendations, recheck_after_changes, vendor_state_history, invoice_guards, order_guards, budgeted_readings, evidence_marks, schema_generations, truth_records)}

_JITTER = f"{printed.TOP} + {printed.ROW} * (nth % {printed.PAGE_ROWS}) + ((id * 7 + k * 3 + place) % 3) * 0.7"
_PLAIN = "regexp_replace(regexp_replace(lower(number), '[^a-z0-9]', '', 'g'), '(^|[^0-9])0+([0-9])', '\\1\\2', 'g')"
ORACLE_SQL = {
    # only repeats, some with a digit more, agree in number, date and amount
    "duplicate_any_vendor": with_views("""SELECT a.id, min(h.id) AS match_id FROM claimed a JOIN claimed h ON h.inv_date = a.inv_date AND h.id < a.id AND abs(a.total - h.total) <= 0.02 AND length(a.n) >= 6
        AND (h.n = a.n OR h.n || '7' = a.n OR a.n || '7' = h.n) GROUP BY a.id""", printed.PRINTED | {"repeated": REPEATED, "claimed": f"SELECT id, {_PLAIN} AS n, total, inv_date FROM ({CLAIMS}) x WHERE number <> '' AND total IS NOT NULL"}),
    # one action after another
    "vendor_state_history": f"""WITH RECURSIVE a AS (SELECT *, row_number() OVER (PARTITION BY vendor ORDER BY seq) AS n FROM ({ACTIONS}) x),
        f AS (SELECT vendor, cast(0 AS bigint) AS seq, cast(0 AS bigint) AS n, 'none' AS status, cast(NULL AS string) AS p, cast(NULL AS string) AS v, cast(NULL AS string) AS reason FROM (SELECT DISTINCT vendor FROM a) d
              UNION ALL
              SELECT vendor, seq, n, CASE WHEN reason IS NOT NULL THEN status WHEN action = 'propose' THEN 'pending' WHEN action IN ('add', 'verify') THEN 'verified' WHEN action = 'approve' THEN 'approved' ELSE 'rejected' END,
                     CASE WHEN reason IS NULL AND action IN ('propose', 'add') THEN actor ELSE p END, CASE WHEN reason IS NULL AND action = 'propose' THEN NULL WHEN reason IS NULL AND action IN ('add', 'verify') THEN actor ELSE v END, reason
              FROM (SELECT a.vendor, a.seq, a.n, f.status, f.p, f.v, a.action, a.actor, CASE
                      WHEN a.role = 'viewer' THEN 'not allowed'
                      WHEN a.action = 'propose' AND f.status <> 'none' THEN 'already on the vendor list'
                      WHEN a.action IN ('verify', 'refuse') AND f.status <> 'pending' THEN 'not waiting for verification'
                      WHEN a.action IN ('verify', 'refuse') AND f.p = a.actor THEN 'you proposed this supplier'
                      WHEN a.action IN ('approve', 'reject') AND f.status <> 'verified' THEN 'not waiting for approval'
                      WHEN a.action IN ('approve', 'reject') AND (f.p = a.actor OR f.v = a.actor) THEN 'you proposed or verified this supplier'
                      WHEN a.action IN ('refuse', 'reject') AND a.note IS NULL THEN 'give a reason' END AS reason
                    FROM f JOIN a ON a.vendor = f.vendor AND a.n = f.n + 1) s)
        SELECT vendor, seq, status, reason FROM f WHERE n > 0""",
    "invoice_guards": with_views(f"""SELECT id, CASE WHEN role <> 'ap' THEN 'accounts payable reviews invoices' WHEN stage <> 'ap_review' THEN 'not waiting for the review' END AS review,
        CASE WHEN role IN ('ap', 'procurement') THEN 'managers approve invoices' WHEN id % 103 = 0 THEN 'removed, so it is not paid' WHEN id % 9 = id % 7 THEN 'you uploaded or corrected it'
             WHEN id % 4 <> 0 AND total > 40000 * (id % 4) THEN 'above your approval limit' END AS approve,
        CASE WHEN role = 'procurement' THEN 'accounts payable or a manager removes' WHEN id % 103 = 0 THEN 'already removed' WHEN status IN ('approved', 'rejected') THEN 'already decided' END AS remove,
        CASE WHEN NOT (role = 'ap' AND id % 103 <> 0 AND stage = 'ap_review') THEN 'accounts payable corrects while reviewing' END AS edit FROM ({ASKED}) a"""),
    "order_guards": with_views(f"""SELECT request_id, CASE WHEN request_id % 6 = 0 THEN 'managers approve orders' WHEN status = 'requested' THEN 'procurement prepares it first' WHEN status IN ('approved', 'rejected') THEN 'already decided'
        WHEN request_id % 11 = request_id % 5 OR (request_id % 3 <> 0 AND request_id % 11 = request_id % 4) THEN 'you requested or prepared it' WHEN request_id % 2 = 0 AND amount > 50 THEN 'above your approval limit' END AS reason FROM ({ORDERS}) o"""),
    # one document after another
    "budgeted_readings": f"""WITH RECURSIVE r AS ({READINGS}),
        c AS (SELECT key, CASE WHEN f1 THEN 1 WHEN f2 OR (o1 AND o2) THEN 2 ELSE 3 END AS calls, o1, o2, o3, c1, c2, c3
              FROM (SELECT key, bool_or(ok AND complete) FILTER (WHERE tier = 1) AS f1, bool_or(ok AND complete) FILTER (WHERE tier = 2) AS f2, 
                           bool_or(ok) FILTER (WHERE tier = 1) AS o1, bool_or(ok) FILTER (WHERE tier = 2) AS o2, bool_or(ok) FILTER (WHERE tier = 3) AS o3,
                           max(cost) FILTER (WHERE tier = 1) AS c1, max(cost) FILTER (WHERE tier = 2) AS c2, max(cost) FILTER (WHERE tier = 3) AS c3 FROM r GROUP BY key) x),
        p AS (SELECT key, calls, c1 + CASE WHEN calls > 1 THEN c2 ELSE 0 END + CASE WHEN calls > 2 THEN c3 ELSE 0 END AS cost, o1 OR (calls > 1 AND o2) OR (calls > 2 AND o3) AS works FROM c),
        d AS (SELECT cast(floor(epoch(cast(ts AS timestamp))) AS bigint) * 1000000000 + event_id AS seq, cast(ts AS date) AS day, strftime(cast(ts AS date), '%Y-%m') AS month, user_id % 211 AS key FROM events),
        q AS (SELECT d.*, p.calls, p.cost, p.works, row_number() OVER (ORDER BY seq) AS n FROM d LEFT JOIN p ON p.key = d.key),
        f AS (SELECT cast(0 AS bigint) AS n, cast(0 AS bigint) AS seq, cast(-1 AS bigint) AS key, cast(NULL AS date) AS day, '' AS month, 0 AS used, cast(0 AS double) AS spent, cast([] AS bigint[]) AS cached, '' AS outcome
              UNION ALL
              SELECT n, seq, key, day, month, used0 + CASE WHEN outcome IN ('read', 'failed') THEN calls ELSE 0 END, spent0 + CASE WHEN outcome IN ('read', 'failed') THEN cost ELSE 0 END, CASE WHEN outcome = 'read' THEN list_append(cached, key) ELSE cached END, outcome
              FROM (SELECT *, CASE WHEN calls IS NULL THEN 'none' WHEN list_contains(cached, key) THEN 'cache' WHEN used0 >= {CALLS} OR spent0 >= {BUDGET} THEN 'refused' WHEN works THEN 'read' ELSE 'failed' END AS outcome
                    FROM (SELECT q.n, q.seq, q.key, q.day, q.month, q.calls, q.cost, q.works, f.cached, CASE WHEN f.day = q.day THEN f.used ELSE 0 END AS used0, CASE WHEN f.month = q.month THEN f.spent ELSE 0 END AS spent0 FROM f JOIN q ON q.n = f.n + 1) s) t)
        SELECT seq, cast(key AS string) AS key, outcome FROM f WHERE n > 0""",
    "evidence_marks": with_views(f"""SELECT id AS doc_id, item, cast(floor(nth / {printed.PAGE_ROWS}) AS int) AS page, round((50 + 6 * skipped) / {WIDTH}, 6) AS x, round(({_JITTER}) / {HEIGHT}, 6) AS y, round(6 * size / {WIDTH}, 6) AS w, round({printed.HEIGHT} / {HEIGHT}, 6) AS h
        FROM (SELECT r.id, r.place, r.nth, CASE WHEN place = 320 THEN 'total' WHEN place = 400 THEN 'bank' ELSE 'number' END AS item, len(string_split(text, ' ')) - 1 AS k, length(text) - length(list_last(string_split(text, ' '))) AS skipped, length(list_last(string_split(text, ' '))) AS size
              FROM (SELECT *, dense_rank() OVER (PARTITION BY id ORDER BY place) - 1 AS nth FROM printed_rows) r JOIN facts f ON f.id = r.id
              WHERE r.x = 50 AND (place IN (320, 400) OR (number IS NOT NULL AND ((place = 30 AND way <> 1) OR (place = 32 AND way = 1))))) m""", printed.PRINTED),
    "schema_generations": """SELECT s_name AS name, concat('T', s_suppkey) AS tax_id, CASE s_suppkey % 3 WHEN 1 THEN CASE WHEN s_suppkey % 2 = 0 THEN 'rejected' ELSE 'approved' END WHEN 2 THEN 'pending' ELSE 'approved' END AS status,
        CASE WHEN s_suppkey % 3 = 2 THEN concat('ACC', s_suppkey) END AS bank_account, cast(CASE WHEN s_suppkey % 3 = 2 AND s_suppkey % 7 <> 0 THEN s_suppkey ELSE 0 END AS int) AS score FROM supplier""",
    "model_answers": with_views("""SELECT id, CASE WHEN told THEN vendor_name END AS vendor, CASE WHEN told THEN printed_number END AS invoice_number, CASE WHEN told THEN day END AS invoice_date, CASE WHEN told AND id % 3 <> 0 THEN currency END AS currency,
        CASE WHEN told THEN total END AS total, cast(NULL AS double) AS subtotal, cast(NULL AS string) AS po_number, CASE WHEN told THEN 1 END AS n_items, CASE WHEN told THEN 1.5 END AS item FROM (SELECT *, id % 5 < 3 AS told FROM facts) f""", printed.PRINTED),
    "invoice_labels": with_views(f"""SELECT id, concat('invoice ', CASE WHEN number = '' THEN concat('#', id) ELSE number END, ' from ', coalesce(vendor, 'an unknown supplier'), CASE WHEN total IS NULL THEN '' ELSE concat(' (', format('{{:,.2f}}', total), ' ', currency, ')') END) AS label FROM ({CLAIMS}) c""", printed.PRINTED | {"repeated": REPEATED}),
    "vendor_suggestions": with_views(f"""SELECT c.id, c.vendor, c.tax_id, CASE WHEN c.tax_id IS NULL THEN NULL WHEN c.id % 41 = 0 THEN 'EU_VAT' ELSE t.kind END AS tax_kind, CASE WHEN c.tax_id IS NULL THEN NULL WHEN c.id % 41 = 0 THEN true ELSE t.status = 'pass' END AS tax_valid, c.bank_account,
        CASE WHEN c.id % 67 = 0 THEN false END AS bank_valid FROM ({CLAIMS}) c JOIN facts f ON f.id = c.id LEFT JOIN tax_ids t ON t.supp = f.supp""", printed.PRINTED | {"repeated": REPEATED}),
    "existing_vendor": f"SELECT s_suppkey AS id, upper({printed.VENDOR_NAME.format('s_suppkey')}) AS vendor, CASE WHEN s_suppkey % 13 <> 0 THEN {printed.VENDOR_NAME.format('s_suppkey')} END AS match FROM supplier",
    # everything checked once, against each vendor's and each order's last change
    "recheck_after_changes": with_views(f"""SELECT w.id, w.vendor, CASE WHEN w.vendor IS NULL THEN 'skip' WHEN v.vendor IS NULL THEN 'warn' WHEN v.status = 'rejected' THEN 'fail' WHEN coalesce(v.status, 'approved') = 'approved' THEN 'pass' ELSE 'warn' END AS vendor_status,
        CASE WHEN w.vendor IS NULL THEN NULL WHEN v.vendor IS NULL THEN 'new' WHEN v.status = 'verified' THEN 'awaiting_approval' WHEN v.status IN ('rejected', 'pending') THEN v.status END AS vendor_kind,
        CASE WHEN w.po_number IS NULL THEN 'skip' WHEN o.po_number IS NULL THEN 'warn' WHEN w.total > o.remaining * 1.02 + 0.02 THEN 'fail' WHEN w.total > o.remaining + 0.02 THEN 'warn' ELSE 'pass' END AS po_status
        FROM ({WAITING}) w
        LEFT JOIN (SELECT coalesce(c.vendor, g.vendor) AS vendor, CASE WHEN c.vendor IS NOT NULL THEN c.status ELSE g.given_status END AS status FROM vendors g FULL OUTER JOIN (SELECT cast(key AS bigint) AS vendor, arg_max(status, seq) AS status FROM ({CHANGES}) x WHERE kind = 'vendor' GROUP BY 1) c ON c.vendor = g.vendor) v ON v.vendor = w.vendor
        LEFT JOIN (SELECT coalesce(c.po_number, g.po_number) AS po_number, CASE WHEN c.po_number IS NOT NULL THEN c.remaining ELSE g.remaining END AS remaining FROM po_balance g FULL OUTER JOIN (SELECT key AS po_number, arg_max(remaining, seq) AS remaining FROM ({CHANGES}) x WHERE kind = 'order' GROUP BY 1) c ON c.po_number = g.po_number) o ON o.po_number = w.po_number"""),
    "truth_records": with_views("SELECT id, number, total FROM facts", printed.PRINTED),
}
