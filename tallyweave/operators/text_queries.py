"""Normalisation and checksums applied to the standard tables, with the same in DuckDB's SQL where it can."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyweave.functions import ids, spans, text
from tallyweave.operators import matching
from tallyweave.plans.reports import SQL
from tallyweave.plans.views import with_views
from tallyweave.streaming import limits, replay, stateful


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def norm_number(spark, sf_dir):
    return _read(spark, sf_dir, "documents").select("doc_id", text.norm_number(F.col("text")).alias("number"))


def date_readings(spark, sf_dir):
    """All dates that a printed text may mean: one both ways round, the next day with its month's name."""
    day = F.col("o_orderdate").cast("date")
    months = F.array(*(F.lit(m) for m in ("January", "février", "März", "avril", "mei", "June", "juli", "août", "Sept", "oktober", "Nov", "décembre")))
    later = F.date_add(day, 1)
    printed = F.concat(F.lit("Order of "), F.date_format(day, "d/M/yyyy"), F.lit(", due "), F.day(later).cast("string"), F.lit(" "), F.element_at(months, F.month(later)), F.lit(" "), F.year(later).cast("string"))
    found = F.transform(spans.all_dates(printed), lambda d: d.cast("string"))
    return _read(spark, sf_dir, "orders").select("o_orderkey", F.array_join(found, ",").alias("readings"))


def money_figures(spark, sf_dir):
    """The amounts of a printed text: thousands with spaces beside a currency, European ones, cents alone; no shares or counts."""
    us = F.format_number(F.col("o_totalprice").cast("decimal(18,2)"), 2)
    printed = F.concat(F.lit("Total $ "), F.translate(us, ",", " "), F.lit(" or "), F.translate(us, ",.", ".,"), F.lit(" incl. 21% of 3 parts at 40.50"))
    found = F.transform(spans.find_money(printed), lambda v: v.cast("decimal(18,2)").cast("string"))
    return _read(spark, sf_dir, "orders").select("o_orderkey", F.array_join(found, "|").alias("figures"))


def scanned_numbers(spark, sf_dir):
    """Numbers in which a scan took digits for letters, mended; words stay."""
    number = F.concat(F.col("o_orderkey").cast("string"), F.lit("SOl"))
    return _read(spark, sf_dir, "orders").select("o_orderkey", spans.fix_scanned_numbers(F.concat(number, F.lit(" SOIL"))).alias("fixed"))


def ocr_fold(spark, sf_dir):
    return _read(spark, sf_dir, "documents").select("doc_id", text.ocr_fold(F.col("text")).alias("folded"))


def compact_text(spark, sf_dir):
    return _read(spark, sf_dir, "documents").select("doc_id", text.compact_text(F.col("text")).alias("text"))


def find_amounts(spark, sf_dir):
    return _read(spark, sf_dir, "documents").select("doc_id", text.find_amounts(F.col("text")).alias("amounts"))


def detect_currency(spark, sf_dir):
    return _read(spark, sf_dir, "documents").select("doc_id", text.detect_currency(F.col("text")).alias("currency"))


def parse_date(spark, sf_dir):
    return _read(spark, sf_dir, "documents").select("doc_id", text.parse_date(F.col("text")).alias("date"))


def iban_make(spark, sf_dir):
    bban = F.lpad((F.col("s_suppkey") * 7919).cast("string"), 18, "0")
    made = _read(spark, sf_dir, "supplier").select("s_suppkey", ids.make_iban(F.lit("DE"), bban).alias("iban"))
    return made.withColumn("valid", ids.iban_valid(F.col("iban")))


def gstin_checksum(spark, sf_dir):
    first = F.concat(F.lit("06AABCO"), F.lpad((F.col("s_suppkey") % 10000).cast("string"), 4, "0"), F.lit("D1Z"))
    made = _read(spark, sf_dir, "supplier").select("s_suppkey", F.concat(first, ids.gstin_check_char(first)).alias("gstin"))
    return made.withColumn("valid", ids.tax_id(F.col("gstin"))["valid"])


#: Tax ids of suppliers: none, Indian (one in 36 with the right check character), Emirati, German, none of these.
TAX_ID = """CASE s_suppkey % 5 WHEN 0 THEN NULL WHEN 1 THEN concat('06AABCO', lpad(cast(s_suppkey % 10000 AS string), 4, '0'), 'D1Z', substr('0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ', cast(s_suppkey * 7 % 36 AS int) + 1, 1))
    WHEN 2 THEN concat(CASE WHEN s_suppkey % 3 = 0 THEN '200' ELSE '100' END, lpad(cast(s_suppkey AS string), 12, '0')) WHEN 3 THEN concat('DE', lpad(cast(s_suppkey AS string), CASE WHEN s_suppkey % 3 = 0 THEN 8 ELSE 9 END, '0'))
    ELSE concat('X', cast(s_suppkey AS string)) END"""


def check_tax_id(spark, sf_dir):
    """Status and kind of the tax-id check: none is skipped, a wrong GSTIN fails, other invalid ids warn."""
    given = _read(spark, sf_dir, "supplier").select("s_suppkey", F.expr(TAX_ID).alias("tax_id")).withColumn("t", ids.tax_id(F.col("tax_id")))
    none = text.missing(F.col("tax_id"))
    status = F.when(none, "skip").when(F.col("t.valid"), "pass").when(F.col("t.kind") == "GSTIN", "fail").otherwise("warn")
    return given.select("s_suppkey", "tax_id", status.alias("status"), F.when(~none, F.col("t.kind")).alias("kind"))


def _named(spark, sf_dir):
    """Distinct names spelled from a hash, so that suppliers are no near copies of each other."""
    letters = F.translate(F.md5(F.col("s_suppkey").cast("string")), "0123456789", "ghijklmnop")
    return _read(spark, sf_dir, "supplier").select("s_suppkey", F.concat_ws(" ", F.left(letters, F.lit(8)), F.substr(letters, F.lit(9), F.lit(8)), F.lit("Ltd")).alias("name"))


def vendor_first_match(spark, sf_dir):
    names = _named(spark, sf_dir)
    printed = names.select(F.col("s_suppkey").alias("id"), F.upper(F.regexp_replace("name", "Ltd$", "Limited")).alias("vendor"))
    return matching.first_vendor(printed, names)


def duplicate_fuzzy(spark, sf_dir):
    tables = {t: _read(spark, sf_dir, t) for t in ("orders", "lineitem")}
    sql = with_views("SELECT id, vendor AS vendor_key, number, total FROM live")
    rows = spark.sql(sql.replace("FROM orders", "FROM {orders}").replace("FROM lineitem", "FROM {lineitem}"), **tables)
    return matching.near_duplicates(rows)


def _attempts(events: DataFrame) -> DataFrame:
    """Sign-ins of the event log; every seventh account is exempt from lockouts."""
    return limits.prepared(events).withColumn("exempt", F.col("user_id") % 7 == 0)


def rate_limit(spark, sf_dir):
    """Which requests are accepted, at most 3 a user and day."""
    return limits.rate_limit(limits.prepared(_read(spark, sf_dir, "events")), limit=3, seconds=86400)


def lockout(spark, sf_dir):
    """The outcome of every attempt: two failures lock, but not an exempt account."""
    return limits.lockout(_attempts(_read(spark, sf_dir, "events")), failures=2, seconds=86400)


def session_requests(spark, sf_dir):
    """What every request meets: a session opened, valid, touched, expired or none."""
    events = _read(spark, sf_dir, "events")
    return limits.sessions(limits.prepared(events).withColumn("ok", F.col("ok") & (F.col("event_id") % 5 == 0)), lifetime=86400)


def rate_limit_stream(spark, sf_dir):
    """rate_limit over the events as a stream."""
    events = limits.prepared(replay.as_stream(spark, f"{sf_dir}/events.parquet")).withColumnRenamed("user_id", "key")
    done = replay.drained(stateful.rate_limit(events, limit=3, seconds=86400))
    return done.withColumnsRenamed({"key": "user_id", "value": "accepted"})


def lockout_stream(spark, sf_dir):
    """lockout over the events as a stream."""
    events = _attempts(replay.as_stream(spark, f"{sf_dir}/events.parquet")).withColumn("ok", F.when(F.col("ok") | ~F.col("exempt"), F.col("ok")))
    done = replay.drained(stateful.lockout(events.withColumnRenamed("user_id", "key"), failures=2, seconds=86400))
    return done.withColumnsRenamed({"key": "user_id", "value": "outcome"})


def session_stream(spark, sf_dir):
    """session_requests over the events as a stream."""
    events = limits.prepared(replay.as_stream(spark, f"{sf_dir}/events.parquet")).withColumn("ok", F.col("ok") & (F.col("event_id") % 5 == 0))
    done = replay.drained(stateful.sessions(events.withColumnRenamed("user_id", "key"), lifetime=86400))
    return done.withColumnsRenamed({"key": "user_id", "value": "session"})


QUERIES = {
    f.__name__: f
    for f in (norm_number, date_readings, money_figures, scanned_numbers, ocr_fold, compact_text, find_amounts, detect_currency, parse_date, iban_make, gstin_checksum, check_tax_id, vendor_first_match, duplicate_fuzzy, rate_limit, lockout, session_requests, rate_limit_stream, lockout_stream, session_stream)
    if f.__name__ not in SQL
}
ORACLE_SQL = {
    "check_tax_id": f"""WITH t AS (SELECT s_suppkey, {TAX_ID} AS tax_id FROM supplier), d AS (
        SELECT *, list_transform(range(1, 15), lambda i: (strpos('0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ', substr(tax_id, i, 1)) - 1) * (1 + (i - 1) % 2)) AS parts FROM t), k AS (
        SELECT *, (36 - list_sum(list_transform(parts, lambda p: p // 36 + p % 36)) % 36) % 36 AS place, CASE WHEN regexp_matches(tax_id, '^[0-9]{{2}}[A-Z]{{5}}[0-9]{{4}}D1Z.$') THEN 'GSTIN'
            WHEN regexp_matches(tax_id, '^[0-9]{{15}}$') THEN 'UAE_TRN' WHEN starts_with(tax_id, 'DE') THEN 'EU_VAT' WHEN tax_id IS NOT NULL THEN 'UNKNOWN' END AS kind FROM d)
        SELECT s_suppkey, tax_id, CASE WHEN kind IS NULL THEN 'skip' WHEN kind = 'GSTIN' THEN CASE WHEN substr('0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ', cast(place AS int) + 1, 1) = right(tax_id, 1) THEN 'pass' ELSE 'fail' END
            WHEN kind = 'UAE_TRN' AND starts_with(tax_id, '100') THEN 'pass' WHEN kind = 'EU_VAT' AND length(tax_id) = 11 THEN 'pass' ELSE 'warn' END AS status, kind FROM k""",
    "norm_number": """SELECT doc_id, CASE WHEN n = '' THEN '0' ELSE n END AS number FROM (SELECT doc_id,
        regexp_replace(regexp_replace(lower(text), '[^a-z0-9]', '', 'g'), '(^|[^0-9])0+([0-9])', '\\1\\2', 'g') AS n FROM documents)""",
    "date_readings": """SELECT o_orderkey, array_to_string(list_sort(list_distinct(list_filter([strftime(d, '%Y-%m-%d'), CASE WHEN day(d) <= 12 THEN strftime(make_date(year(d), day(d), month(d)), '%Y-%m-%d') END, strftime(d + INTERVAL 1 DAY, '%Y-%m-%d')], lambda x: x IS NOT NULL))), ',') AS readings
        FROM (SELECT o_orderkey, cast(o_orderdate AS date) AS d FROM orders) x""",
    "money_figures": """SELECT o_orderkey, concat(cast(cast(o_totalprice AS decimal(18,2)) AS varchar), '|', cast(cast(o_totalprice AS decimal(18,2)) AS varchar), '|', '40.50') AS figures FROM orders""",
    "scanned_numbers": """SELECT o_orderkey, concat(CASE WHEN o_orderkey >= 10 THEN cast(o_orderkey * 1000 + 501 AS varchar) ELSE concat(o_orderkey, 'SOl') END, ' SOIL') AS fixed FROM orders""",
    "ocr_fold": "SELECT doc_id, translate(regexp_replace(lower(text), '[^a-z0-9|]', '', 'g'), 'oil|sbz', '0111582') AS folded FROM documents",
    "compact_text": "SELECT doc_id, CASE WHEN length(text) > 8500 THEN left(text, 6000) || chr(10) || '...' || chr(10) || right(text, 2500) ELSE text END AS text FROM documents",
}

# one event after another
_EVENTS = "SELECT user_id, event_id, event_type, cast(floor(epoch(cast(ts AS timestamp))) AS bigint) AS s, event_type <> 'error' AS ok, row_number() OVER (PARTITION BY user_id ORDER BY floor(epoch(cast(ts AS timestamp))), event_id) AS n FROM events"
_RATE = f"""WITH RECURSIVE e AS ({_EVENTS}),
    f AS (SELECT user_id, event_id, n, [s] AS times, true AS accepted FROM e WHERE n = 1
          UNION ALL SELECT user_id, event_id, n, CASE WHEN len(kept) < 3 THEN list_append(kept, s) ELSE kept END, len(kept) < 3
          FROM (SELECT e.user_id, e.event_id, e.n, e.s, list_filter(f.times, lambda t: e.s - t <= 86400) AS kept FROM f JOIN e ON e.user_id = f.user_id AND e.n = f.n + 1) x)
    SELECT user_id, event_id, accepted FROM f"""
_LOCK = f"""WITH RECURSIVE e AS ({_EVENTS}),
    f AS (SELECT user_id, cast(0 AS bigint) AS event_id, cast(0 AS bigint) AS n, 0 AS failed, cast(0 AS bigint) AS until, '' AS outcome FROM (SELECT DISTINCT user_id FROM e) u
          UNION ALL SELECT user_id, event_id, n, CASE outcome WHEN 'ok' THEN 0 WHEN 'locked' THEN 0 WHEN 'failed' THEN failed + CASE WHEN user_id % 7 = 0 THEN 0 ELSE 1 END ELSE failed END,
                 CASE WHEN outcome = 'locked' THEN s + 86400 ELSE until END, outcome
          FROM (SELECT e.user_id, e.event_id, e.n, e.s, f.failed, f.until, CASE WHEN e.s < f.until THEN 'refused' WHEN e.ok THEN 'ok' WHEN e.user_id % 7 = 0 OR f.failed = 0 THEN 'failed' ELSE 'locked' END AS outcome
                FROM f JOIN e ON e.user_id = f.user_id AND e.n = f.n + 1) x)
    SELECT user_id, event_id, outcome FROM f WHERE n > 0"""
_SESSION = f"""WITH RECURSIVE e AS ({_EVENTS}),
    f AS (SELECT user_id, cast(0 AS bigint) AS event_id, cast(0 AS bigint) AS n, cast(NULL AS bigint) AS seen, '' AS session FROM (SELECT DISTINCT user_id FROM e) u
          UNION ALL SELECT user_id, event_id, n, CASE WHEN session IN ('opened', 'touched') THEN s WHEN session = 'valid' THEN seen END, session
          FROM (SELECT e.user_id, e.event_id, e.n, e.s, f.seen, CASE WHEN e.ok AND e.event_id % 5 = 0 THEN 'opened' WHEN f.seen IS NULL THEN 'none' WHEN f.seen + 86400 < e.s THEN 'expired' WHEN e.s - f.seen > 60 THEN 'touched' ELSE 'valid' END AS session
                FROM f JOIN e ON e.user_id = f.user_id AND e.n = f.n + 1) x)
    SELECT user_id, event_id, session FROM f WHERE n > 0"""
ORACLE_SQL |= {"rate_limit": _RATE, "rate_limit_stream": _RATE, "lockout": _LOCK, "lockout_stream": _LOCK, "session_requests": _SESSION, "session_stream": _SESSION}
