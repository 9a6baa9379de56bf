"""Lists, lookups, state folds and scores of the invoice domain as DataFrame operations.

The oracles are written apart from them, by other means where there are any: a fold of one row after another
for the request states, the figures that a text was made of for charges, joins for an exploded lookup.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyweave.functions import text
from tallyweave.plans.reports import statement
from tallyweave.plans.views import with_views
from tallyweave.sources.shared import by_key

FIELDS = ("vendor", "number", "inv_date", "currency", "subtotal", "tax_amount", "total", "po_number", "bank_account")

#: US dollars for a million tokens read and written, by prefix of the model's name; other models cost the default.
PRICES, DEFAULT_PRICE = (("m0", 0.0, 0.0), ("m1", 0.15, 0.6), ("m2", 3.0, 15.0)), (1.0, 5.0)

#: Texts that print charges, and totals that hold all, one or none of them.
PRINTED = """SELECT id, subtotal, tax_amount, ship, less, round(subtotal + tax_amount + CASE id % 4 WHEN 0 THEN ship WHEN 1 THEN ship - less WHEN 2 THEN 3 ELSE 0 END, 2) AS total,
    concat('Subtotal ', coalesce(cast(cast(subtotal AS decimal(18,2)) AS string), ''), chr(10), 'Shipping & handling  ', cast(cast(ship AS decimal(18,2)) AS string), chr(10),
           CASE WHEN less > 0 THEN concat('Discount (', cast(cast(less AS decimal(18,2)) AS string), ')', chr(10)) ELSE '' END, 'Total incl. shipping 1.00') AS doc_text
    FROM (SELECT id, subtotal, tax_amount, cast(5 + id % 7 AS double) AS ship, CASE WHEN id % 3 = 0 THEN cast(1 + id % 2 AS double) ELSE 0.0 END AS less FROM live) x"""


def _view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return statement(spark, sf_dir, f"SELECT * FROM {name}")


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def list_by_status(spark, sf_dir):
    """Pending invoices, newest first."""
    return _view(spark, sf_dir, "live").filter("status = 'pending'").select("id", "number", "vendor", "total", "currency").orderBy(F.desc("id"))


def flag_counts(spark, sf_dir):
    """Each invoice with the number of its checks that warn or fail."""
    flagged = F.count_if(F.col("status").isin("warn", "fail"))
    return _view(spark, sf_dir, "checks").groupBy("id").agg(flagged.alias("flags"))


def invoice_audit(spark, sf_dir):
    """What was done to invoice 17, oldest first."""
    return _view(spark, sf_dir, "activity").filter("invoice_id = 17").select("id", "actor", "action").orderBy("id")


def found_fields(spark, sf_dir):
    """The names of the fields that an invoice has, in their fixed order."""
    given = F.array_compact(F.array(*(F.when(~text.missing(F.col(f)), F.lit(f)) for f in FIELDS)))
    return _view(spark, sf_dir, "live").select("id", F.array_join(given, ",").alias("found"))


def input_faults(spark, sf_dir):
    """The first constraint on what is typed in that an order breaks; null if none."""
    fault = F.when(F.col("o_totalprice") <= 0, "amount").when(F.col("o_totalprice") >= 300000, "too_much").when(F.length("o_orderpriority") > 8, "priority_length")
    return _read(spark, sf_dir, "orders").select("o_orderkey", fault.alias("fault"))


def po_lookup_case(spark, sf_dir):
    """The order that an invoice cites: as written, else in upper case, else in lower case."""
    cited = _view(spark, sf_dir, "live").filter("po_number IS NOT NULL").select("id", F.expr("CASE WHEN id % 3 = 0 THEN lower(po_number) ELSE po_number END").alias("cited"))
    known = _view(spark, sf_dir, "pos").select(F.expr("CASE WHEN amount > 400000 THEN lower(po_number) ELSE po_number END").alias("po"), "amount")
    spelled = F.posexplode(F.array("cited", F.upper("cited"), F.lower("cited"))).alias("tried", "po")
    hits = cited.select("id", spelled).join(known, "po").groupBy("id").agg(F.min_by(F.struct("po", "amount"), "tried").alias("hit"))
    return cited.join(hits, "id", "left").select("id", "cited", F.col("hit.po").alias("po"), F.col("hit.amount").alias("amount"))


def explained_charges(spark, sf_dir):
    """Whether printed charges make up the gap between an invoice's parts and its total; null without a gap."""
    # short as the rows are, their texts take much work: they are dealt over all tasks
    printed = by_key(statement(spark, sf_dir, PRINTED), "id").withColumn("gap", F.col("total") - F.col("subtotal") - F.col("tax_amount")).withColumn("found", text.charges(F.col("doc_text")))
    answer = F.when(F.abs("gap") > 0.02, text.explained(F.col("gap"), F.col("found")))
    return printed.select("id", F.size("found").alias("n_charges"), F.round(F.aggregate("found", F.lit(0.0), lambda a, x: a + x["amount"]), 2).alias("charges"), answer.alias("explained"))


def touched_by(spark, sf_dir):
    """Everyone who edited an invoice, and who uploaded it, once each."""
    editors = _view(spark, sf_dir, "activity").filter("action = 'click'").select(F.col("invoice_id").alias("id"), F.col("actor").cast("long"))
    uploaders = _view(spark, sf_dir, "live").select("id", (F.col("id") % 9).cast("long").alias("actor"))
    each = editors.join(uploaders.select("id"), "id", "left_semi").union(uploaders).distinct()
    return each.groupBy("id").agg(F.array_join(F.array_sort(F.collect_list("actor")), ",").alias("names"))


def ai_cost_per_invoice(spark, sf_dir):
    """What the readings cost for each invoice; 0 without invoices."""
    cost = _view(spark, sf_dir, "usage").agg(F.sum("cost").cast("double").alias("cost"), F.lit(0).cast("long").alias("n"))
    count = _view(spark, sf_dir, "live").agg(F.lit(0.0).alias("cost"), F.count(F.lit(1)).alias("n"))
    both = cost.union(count).agg(F.coalesce(F.sum("cost"), F.lit(0.0)).alias("cost"), F.sum("n").alias("n"))
    return both.select("n", F.when(F.col("n") > 0, F.col("cost") / F.col("n")).otherwise(0.0).alias("each"))


def price(model: Column) -> tuple[Column, Column]:
    """Prices for tokens read and written of the first prefix that a model's name begins with."""
    read, wrote = F.lit(DEFAULT_PRICE[0]), F.lit(DEFAULT_PRICE[1])
    for prefix, r, w in reversed(PRICES):
        hit = F.startswith(model, F.lit(prefix))
        read, wrote = F.when(hit, r).otherwise(read), F.when(hit, w).otherwise(wrote)
    return read, wrote


def estimate_cost(spark, sf_dir):
    """The estimated cost of each reading."""
    read, wrote = price(F.col("model"))
    tokens = F.coalesce("tokens", F.lit(0))
    return _view(spark, sf_dir, "usage").select("id", "model", F.round((tokens * read + F.floor(tokens / 2) * wrote) / 1e6, 6).alias("estimate"))


def best_try(spark, sf_dir):
    """Of each user's readings with a score, the best; of equals the first."""
    tries = _read(spark, sf_dir, "events").select("user_id", "event_id", F.when(F.col("event_type") != "error", F.col("value")).alias("score"))
    best = tries.filter("score IS NOT NULL").groupBy("user_id").agg(F.max_by(F.struct("event_id", "score"), F.struct("score", -F.col("event_id"))).alias("best"))
    return best.select("user_id", "best.event_id", "best.score")


def detection_by_scenario(spark, sf_dir):
    """Of the invoices with a planted fault, those whose check noticed it."""
    faults = (
        ("total_tampered", "math", "id % 97 = 0"),
        ("number_repeated", "duplicate", "id % 50 = 0 AND id > 1"),
        ("number_missing", "completeness", "id % 211 = 0"),
        ("order_unknown", "po_match", "id % 11 = 0 AND id % 5 <> 0"),
        ("account_changed", "bank", "id % 53 = 0 AND bank_account IS NOT NULL"),
    )
    planted = F.array_compact(F.array(*(F.when(F.expr(where), F.struct(F.lit(s).alias("scenario"), F.lit(n).alias("name"))) for s, n, where in faults)))
    each = _view(spark, sf_dir, "live").select("id", F.explode(planted).alias("p")).select("id", "p.*")
    noticed = each.join(_view(spark, sf_dir, "checks").select("id", "name", "status"), ["id", "name"])
    return noticed.groupBy("scenario").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("status").isin("warn", "fail")).alias("noticed"), F.count_if(F.col("status") == "fail").alias("failed"))


def truth_scores(spark, sf_dir):
    """Readings against the truth of the line items, by field: an amount is right within 0.011."""
    truth = _view(spark, sf_dir, "lines").select(F.col("l_orderkey").alias("id"), F.col("sub").cast("double").alias("t_sub"), (F.col("sub") + F.col("tax")).cast("double").alias("t_total"))
    pairs = F.array(*(F.struct(F.lit(n).alias("field"), F.col(a).alias("got"), F.col(b).alias("want")) for n, a, b in (("subtotal", "subtotal", "t_sub"), ("total", "total", "t_total"))))
    each = _view(spark, sf_dir, "live").join(truth, "id").select(F.explode(pairs).alias("p")).select("p.*").filter("want IS NOT NULL")
    return each.groupBy("field").agg(F.count(F.lit(1)).alias("scored"), F.count_if(F.abs(F.col("got") - F.col("want")) < 0.011).alias("correct"))


def hard_delete(spark, sf_dir):
    """The vendors that are left when those of a list go."""
    gone = _read(spark, sf_dir, "supplier").filter("s_acctbal < 0").select(F.col("s_suppkey").alias("vendor"))
    return _view(spark, sf_dir, "vendors").join(gone, "vendor", "left_anti").select("vendor", "name")


def request_states(spark, sf_dir):
    """The state of each invoice's order after all its requests: requested, then prepared, then approved or rejected,
    which is final; what comes out of turn is ignored. Each state is entered at its first request after the one before
    it was entered, so three aggregates find them: no key's history is gathered."""
    requests = _view(spark, sf_dir, "requests").select("invoice_id", "request_id", "status")
    begun = requests.groupBy("invoice_id").agg(F.min(F.when(F.col("status") == "requested", F.col("request_id"))).alias("at"))

    def entered(before: DataFrame, *states: str) -> DataFrame:
        later = requests.filter(F.col("status").isin(*states)).join(before.filter("at IS NOT NULL"), "invoice_id").filter("request_id > at")
        return later.groupBy("invoice_id").agg(F.min("request_id").alias("at"), F.min_by("status", "request_id").alias("state"))

    prepared = entered(begun, "prepared")
    ended = entered(prepared.select("invoice_id", "at"), "approved", "rejected")
    states = begun.join(prepared.select("invoice_id", F.col("state").alias("p")), "invoice_id", "left").join(ended.select("invoice_id", F.col("state").alias("e")), "invoice_id", "left")
    return states.select("invoice_id", F.coalesce("e", "p", F.when(F.col("at").isNotNull(), "requested")).alias("state"))


def cache_key(spark, sf_dir):
    """The key under which a reading of a text is kept."""
    return _read(spark, sf_dir, "documents").select("doc_id", F.sha2(F.concat(F.lit("v1\n"), F.coalesce("text", F.lit(""))), 256).alias("key"))


def printed_amounts(spark, sf_dir):
    """The forms in which a document may print an amount, each once: with and without thousands, either decimal sign."""
    grouped = F.format_number("total", 2)
    plain = F.replace(grouped, F.lit(","), F.lit(""))
    forms = F.array_distinct(F.array(grouped, F.translate(grouped, ",.", ".,"), plain, F.translate(plain, ".", ",")))
    return _view(spark, sf_dir, "live").filter("total IS NOT NULL").select("id", F.array_join(forms, "|").alias("forms"))


def json_fields(spark, sf_dir):
    """A JSON column decoded; a missing list of edits is an empty one."""
    decoded = F.from_json("props", "k bigint, edits array<string>")
    return _read(spark, sf_dir, "events").select("event_id", decoded.alias("p")).select("event_id", F.col("p.k").alias("k"), F.size(F.coalesce("p.edits", F.array().cast("array<string>"))).alias("n_edits"))


def line_windows(spark, sf_dir, cue: str = "enge"):
    """Lines of a text: whether a cue stands in it or in one of the two above (a zone to leave out), and in how many
    of the five around it."""
    lines = _read(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "words"))
    has = F.contains(F.lower("words"), F.lit(cue)).cast("int")
    order = Window.partitionBy("doc_id").orderBy("line")
    return lines.select("doc_id", F.col("line").cast("long").alias("line"), (F.max(has).over(order.rowsBetween(-2, 0)) == 1).alias("in_zone"), F.sum(has).over(order.rowsBetween(-2, 2)).alias("around"))


def median_decision(spark, sf_dir):
    """The median minutes, to a tenth, between an invoice's first mention in the log and its last purchase, of those that a person decided."""
    log = _view(spark, sf_dir, "activity").withColumn("at", F.unix_timestamp(F.col("ts").cast("timestamp")))
    times = log.groupBy("invoice_id").agg(F.min("at").alias("uploaded"), F.max(F.when(F.col("action") == "purchase", F.col("at"))).alias("decided"))
    people = _view(spark, sf_dir, "live").filter("decided_by NOT LIKE 'AI%' AND status <> 'pending'").join(times, F.col("id") == F.col("invoice_id")).filter("decided IS NOT NULL")
    return people.groupBy("status").agg(F.count(F.lit(1)).alias("n"), F.bround(F.median((F.col("decided") - F.col("uploaded")) / 60), 1).alias("minutes"))


def saved_hours(spark, sf_dir, manual: float = 7.0, assisted: float = 2.0):
    """Hours saved at so many minutes an invoice by hand and with help, and the percentage that was decided (half to even)."""
    hours = F.greatest(F.lit(0.0), F.count(F.lit(1)) * manual - F.count(F.lit(1)) * assisted) / 60
    share = F.when(F.count(F.lit(1)) > 0, F.bround(100 * F.count_if(F.col("status") != "pending") / F.count(F.lit(1)))).otherwise(0.0)
    return _view(spark, sf_dir, "live").agg(F.bround(hours, 1).alias("hours"), share.cast("long").alias("decided_share"))


QUERIES = {
    f.__name__: f
    for f in (
        list_by_status, flag_counts, invoice_audit, found_fields, input_faults, po_lookup_case, explained_charges, touched_by, ai_cost_per_invoice, estimate_cost, best_try,
        detection_by_scenario, truth_scores, hard_delete, request_states, cache_key, printed_amounts, json_fields, line_windows, median_decision, saved_hours,
    )
}

_CASES = " UNION ALL ".join(
    f"SELECT '{scenario}' AS scenario, c.status FROM live i JOIN checks c ON c.id = i.id AND c.name = '{name}' WHERE {where}"
    for scenario, name, where in (
        ("total_tampered", "math", "mod(i.id, 97) = 0"),
        ("number_repeated", "duplicate", "mod(i.id, 50) = 0 AND i.id <> 0"),
        ("number_missing", "completeness", "i.number IS NULL"),
        ("order_unknown", "po_match", "i.po_number LIKE 'PO-9%' AND mod(i.id, 11) = 0"),
        ("account_changed", "bank", "i.bank_account LIKE 'ACX%'"),
    )
)
ORACLE_SQL = {
    "list_by_status": with_views("SELECT id, number, vendor, total, currency FROM live WHERE status NOT IN ('approved', 'rejected') ORDER BY id DESC"),
    "flag_counts": with_views("SELECT i.id, count(c.id) AS flags FROM live i LEFT JOIN checks c ON c.id = i.id AND c.status NOT IN ('pass', 'skip') GROUP BY i.id"),
    "invoice_audit": "SELECT event_id AS id, user_id AS actor, event_type AS action FROM events WHERE event_id % 2000 = 16 ORDER BY event_id",
    "found_fields": with_views("SELECT id, concat_ws(',', " + ", ".join(f"CASE WHEN cast({f} AS string) <> '' THEN '{f}' END" for f in FIELDS) + ") AS found FROM live"),
    "input_faults": """SELECT o_orderkey, CASE WHEN NOT o_totalprice > 0 THEN 'amount' WHEN NOT o_totalprice < 300000 THEN 'too_much' WHEN o_orderpriority LIKE '_________%' THEN 'priority_length' END AS fault FROM orders""",
    "po_lookup_case": with_views("""SELECT c.id, c.cited, coalesce(a.po, b.po, d.po) AS po, coalesce(a.amount, b.amount, d.amount) AS amount
        FROM (SELECT id, CASE WHEN id % 3 = 0 THEN lower(po_number) ELSE po_number END AS cited FROM live WHERE po_number IS NOT NULL) c
        LEFT JOIN (SELECT CASE WHEN amount > 400000 THEN lower(po_number) ELSE po_number END AS po, amount FROM pos) a ON a.po = c.cited
        LEFT JOIN (SELECT CASE WHEN amount > 400000 THEN lower(po_number) ELSE po_number END AS po, amount FROM pos) b ON b.po = upper(c.cited)
        LEFT JOIN (SELECT CASE WHEN amount > 400000 THEN lower(po_number) ELSE po_number END AS po, amount FROM pos) d ON d.po = lower(c.cited)"""),
    # from the figures that the texts were made of
    "explained_charges": with_views(f"""SELECT id, CASE WHEN less > 0 THEN 2 ELSE 1 END AS n_charges, round(ship - less, 2) AS charges,
        CASE WHEN abs(total - subtotal - tax_amount) <= 0.02 THEN NULL ELSE abs(ship - less - (total - subtotal - tax_amount)) <= 0.02 OR abs(ship - (total - subtotal - tax_amount)) <= 0.02
            OR (less > 0 AND abs(less + (total - subtotal - tax_amount)) <= 0.02) END AS explained FROM ({PRINTED}) p"""),
    "touched_by": with_views("""SELECT i.id, array_to_string(list_sort(list_distinct(list_append(coalesce(list(a.actor) FILTER (WHERE a.actor IS NOT NULL), []), cast(i.id % 9 AS bigint)))), ',') AS names
        FROM live i LEFT JOIN activity a ON a.invoice_id = i.id AND a.action = 'click' GROUP BY i.id"""),
    "ai_cost_per_invoice": with_views("SELECT count(*) AS n, (SELECT cast(sum(cost) AS double) FROM usage) / count(*) AS each FROM live"),
    "estimate_cost": with_views("""SELECT u.id, u.model, round((coalesce(u.tokens, 0) * coalesce(p.r, 1.0) + coalesce(u.tokens, 0) // 2 * coalesce(p.w, 5.0)) / cast(1000000 AS double), 6) AS estimate FROM usage u
        LEFT JOIN (VALUES ('m0', cast(0 AS double), cast(0 AS double)), ('m1', cast(0.15 AS double), cast(0.6 AS double)), ('m2', cast(3 AS double), cast(15 AS double))) AS p(prefix, r, w) ON u.model LIKE p.prefix || '%'"""),
    "best_try": """SELECT user_id, event_id, score FROM (SELECT user_id, event_id, value AS score, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS place
        FROM events WHERE event_type <> 'error' AND value IS NOT NULL) x WHERE place = 1""",
    "detection_by_scenario": with_views(f"SELECT scenario, count(*) AS n, count(CASE WHEN status IN ('warn', 'fail') THEN 1 END) AS noticed, count(CASE WHEN status = 'fail' THEN 1 END) AS failed FROM ({_CASES}) x GROUP BY scenario"),
    "truth_scores": """WITH t AS (SELECT l_orderkey, sum(cast(l_extendedprice AS decimal(18,2))) AS sub FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE l_orderkey % 101 <> 0 GROUP BY l_orderkey)
        SELECT 'subtotal' AS field, count(*) AS scored, count(*) AS correct FROM t UNION ALL SELECT 'total', count(*), count(*) FILTER (WHERE l_orderkey % 97 <> 0) FROM t""",
    "hard_delete": with_views("SELECT vendor, name FROM vendors WHERE vendor NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal < 0)"),
    # one request after another
    "request_states": f"""WITH RECURSIVE q AS (SELECT *, row_number() OVER (PARTITION BY invoice_id ORDER BY request_id) AS n FROM ({with_views("SELECT * FROM requests")}) r),
        f AS (SELECT invoice_id, n, CASE WHEN status = 'requested' THEN status END AS state FROM q WHERE n = 1
              UNION ALL SELECT q.invoice_id, q.n, CASE WHEN f.state IS NULL AND q.status = 'requested' THEN 'requested' WHEN f.state = 'requested' AND q.status = 'prepared' THEN 'prepared'
                               WHEN f.state = 'prepared' AND q.status IN ('approved', 'rejected') THEN q.status ELSE f.state END
              FROM f JOIN q ON q.invoice_id = f.invoice_id AND q.n = f.n + 1)
        SELECT invoice_id, state FROM (SELECT *, row_number() OVER (PARTITION BY invoice_id ORDER BY n DESC) AS last FROM f) x WHERE last = 1""",
    "median_decision": with_views("""SELECT status, count(*) AS n, round_even(median((decided - uploaded) / 60.0), 1) AS minutes FROM live i
        JOIN (SELECT invoice_id, floor(min(epoch(cast(ts AS timestamp)))) AS uploaded, floor(max(epoch(cast(ts AS timestamp))) FILTER (WHERE action = 'purchase')) AS decided FROM activity GROUP BY 1) a ON a.invoice_id = i.id
        WHERE decided_by = 'Dana' AND status IN ('approved', 'rejected') AND decided IS NOT NULL GROUP BY status"""),
    "saved_hours": with_views("SELECT round_even(count(*) * 5 / 60.0, 1) AS hours, cast(round_even(100.0 * count(*) FILTER (WHERE status IN ('approved', 'rejected')) / count(*), 0) AS bigint) AS decided_share FROM live"),
    "cache_key": "SELECT doc_id, sha256('v1' || chr(10) || coalesce(text, '')) AS key FROM documents",
    "printed_amounts": with_views("""SELECT id, CASE WHEN abs(total) < 1000 THEN concat_ws('|', p, replace(p, '.', ',')) ELSE concat_ws('|', format('{:,.2f}', total), translate(format('{:,.2f}', total), ',.', '.,'), p, replace(p, '.', ',')) END AS forms
        FROM (SELECT id, total, cast(cast(total AS decimal(18,2)) AS string) AS p FROM live WHERE total IS NOT NULL) x"""),
    "json_fields": """SELECT event_id, cast(json_extract_string(props, '$.k') AS bigint) AS k, cast(coalesce(json_array_length(props, '$.edits'), 0) AS int) AS n_edits FROM events""",
    "line_windows": """WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS words, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line FROM documents WHERE text IS NOT NULL)
        SELECT a.doc_id, a.line, coalesce(bool_or(contains(lower(b.words), 'enge')) FILTER (WHERE b.line <= a.line), false) AS in_zone, count(*) FILTER (WHERE contains(lower(b.words), 'enge')) AS around
        FROM l a JOIN l b ON b.doc_id = a.doc_id AND b.line BETWEEN a.line - 2 AND a.line + 2 GROUP BY a.doc_id, a.line""",
}
