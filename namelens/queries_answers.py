"""Registered queries of the endpoints' answers, of recorded fetches, and of totals that had none."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from namelens.functions import domains
from namelens.operators import scoring
from namelens.plans import answers, jobs, views
from namelens.queries import _FEED, _PARKED, _PASSWORD, _latest, AS_OF, CANDIDATES, SCORED, at, candidates_of_orders, checked_lines, feed_tables, query, read
from namelens.queries_more import reports_of, supplier_leaf
from namelens.sources import certificates, fetches, seed

LIMIT, OFFSET = 120, 30
_LISTED = f"(SELECT c.id, first_seen_at FROM {CANDIDATES} c JOIN customer b ON c.brand = b.c_custkey WHERE publish_state = 'published' AND c_mktsegment = 'BUILDING')"


# --- endpoints


@query(f"""SELECT CAST(row_number() OVER (ORDER BY p.first_seen_at DESC, p.id) - 1 AS INTEGER) AS pos, p.id, coalesce(x.score, 0) AS score, coalesce(x.tier, 'medium') AS tier,
CASE coalesce(x.tier, 'medium') WHEN 'high' THEN '{answers.LABELS["high"]}' WHEN 'low' THEN '{answers.LABELS["low"]}' ELSE '{answers.LABELS["medium"]}' END AS label, (SELECT count(*) FROM {_LISTED}) AS total
FROM (SELECT * FROM {_LISTED} ORDER BY first_seen_at DESC, id LIMIT {LIMIT} OFFSET {OFFSET}) p JOIN {_FEED} x ON x.id = p.id""")
def feed_answer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page of the published entries of one category, its items as rows."""
    page = answers.feed_page(*feed_tables(spark, sf_dir), category="BUILDING", tier="high", limit=LIMIT, offset=OFFSET)
    items = page.select("total", F.posexplode("items").alias("pos", "i"))
    return items.select("pos", "i.id", "i.score", "i.tier", F.col("i.statusLabel").alias("label"), "total")


@query(f"""SELECT c.id, CASE WHEN x.id IS NULL THEN 'not_found' END AS error, x.tier, x.brand_name AS brand, CASE WHEN x.id IS NOT NULL THEN coalesce(h.n, 0) END AS checks, CASE WHEN x.id IS NOT NULL THEN v.l_linenumber END AS latest
FROM (SELECT o_orderkey AS id FROM orders UNION ALL SELECT -o_orderkey FROM orders) c LEFT JOIN (SELECT id, coalesce(tier, 'medium') AS tier, brand_name FROM {_FEED}) x ON x.id = c.id
LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem WHERE l_quantity < 30 GROUP BY 1) h ON h.l_orderkey = c.id LEFT JOIN {_latest('l_quantity < 30')} v ON v.l_orderkey = c.id""")
def candidate_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of all orders, and of as many ids that nobody knows."""
    tables = feed_tables(spark, sf_dir)
    ids = tables[0].select("id")
    found = answers.candidate_records(ids.unionByName(ids.select((-F.col("id")).alias("id"))), *tables)
    return found.select("id", "error", "item.tier", F.col("item.brand.name").alias("brand"), F.size("history").alias("checks"), F.get("history", F.lit(0))["domain_age_days"].alias("latest"))


@query(f"SELECT count(*) FILTER (WHERE publish_state = 'published') AS high, count(*) FILTER (WHERE publish_state = 'pending_review') AS review, count(*) FILTER (WHERE first_seen_at >= TIMESTAMP '{AS_OF}' - INTERVAL 24 HOUR) AS day, count(*) FILTER (WHERE first_seen_at >= TIMESTAMP '{AS_OF}' - INTERVAL 168 HOUR) AS week, (SELECT count(*) FROM customer WHERE c_acctbal > 0) AS brands FROM {CANDIDATES} JOIN customer ON brand = c_custkey WHERE publish_state <> 'hidden'")
def stats_answer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The public counts, read back from their JSON."""
    candidates = feed_tables(spark, sf_dir)[0]
    brands = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), (F.col("c_acctbal") > 0).alias("active"))
    row = jobs.as_json(answers.stats(candidates, brands, at(AS_OF)))
    names = {"highConfidence": "high", "underReview": "review", "seenLast24h": "day", "seenLast7d": "week", "brandsWatched": "brands"}
    return row.select(*[F.get_json_object("json", f"$.{key}").cast("long").alias(name) for key, name in names.items()])


@query(f"SELECT CAST(row_number() OVER (ORDER BY score DESC NULLS FIRST, id) - 1 AS INTEGER) AS pos, id, score, CAST(count(*) OVER () AS INTEGER) AS count FROM (SELECT id, score FROM {_FEED} WHERE publish_state = 'pending_review' ORDER BY score DESC NULLS FIRST, id LIMIT {answers.QUEUE})")
def review_answer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What waits for a person, its items as rows."""
    return answers.review_queue(*feed_tables(spark, sf_dir)).select("count", F.posexplode("items").alias("pos", "i")).select("pos", "i.id", "i.score", "count")


@query(f"SELECT CAST(row_number() OVER (ORDER BY made, id) - 1 AS INTEGER) AS pos, id, CAST(count(*) OVER () AS INTEGER) AS count FROM (SELECT (l_orderkey * 10 + l_linenumber) * 1000000 + l_partkey AS id, l_shipdate AS made FROM lineitem WHERE l_linestatus = 'O' ORDER BY 2, 1 LIMIT {answers.QUEUE})")
def report_answer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The open reports, their items as rows."""
    return answers.report_queue(reports_of(spark, sf_dir)).select("count", F.posexplode("items").alias("pos", "i")).select("pos", "i.id", "count")


_OPEN = "(SELECT l_orderkey, (l_orderkey * 10 + l_linenumber) * 1000000 + l_partkey AS report_id, l_returnflag = 'R' AS dispute FROM lineitem WHERE l_linestatus = 'O' AND l_partkey % 50 <> 0)"


@query(f"SELECT o_orderkey AS id, coalesce(bool_or(dispute) OVER (PARTITION BY o_orderkey), FALSE) AS disputed, report_id, CASE WHEN dispute THEN 'dispute' WHEN report_id IS NOT NULL THEN 'confirm' END AS kind FROM orders LEFT JOIN {_OPEN} ON l_orderkey = o_orderkey")
def report_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All orders with their open reports, a report a row."""
    candidates = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"))
    return views.report_rows(candidates, reports_of(spark, sf_dir)).select("id", "disputed", "report_id", "kind")


@query("""SELECT d.id, error IS NULL AS ok, error, CASE WHEN error IS NULL THEN 'd' || d.id END AS domain, CASE WHEN error IS NULL THEN CASE d.action WHEN 'publish' THEN 'published' WHEN 'hide' THEN 'hidden' ELSE 'cleared' END END AS publish_state,
CASE WHEN error IS NULL THEN d.action = 'clear' END AS allowlisted, CASE WHEN error IS NULL THEN CASE WHEN d.action = 'clear' THEN coalesce(n, 0) ELSE 0 END END AS resolved_reports FROM (SELECT *, CASE WHEN k = 5 THEN 'id and action are required' WHEN k = 4 THEN 'action must be one of: publish, clear, hide'
WHEN id < 0 THEN 'candidate not found' WHEN k = 2 THEN 'a reason is required to clear' END AS error FROM (SELECT CASE WHEN o_custkey % 10 = 0 THEN -o_orderkey ELSE o_orderkey END AS id, o_orderkey % 6 AS k, ['publish', 'clear', 'clear', 'hide', 'drop', NULL][1 + o_orderkey % 6] AS action FROM orders)) d
LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem WHERE l_linestatus = 'O' AND l_partkey % 50 <> 0 GROUP BY 1) ON l_orderkey = d.id""")
def decision_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A decision on every order; some name no candidate, give no reason, or aren't decisions."""
    orders = read(spark, sf_dir, "orders")
    candidates = orders.select(F.col("o_orderkey").alias("id"), F.concat(F.lit("d"), F.col("o_orderkey").cast("string")).alias("domain"))
    k = F.col("o_orderkey") % 6
    action = F.get(F.array(*[F.lit(a) for a in ("publish", "clear", "clear", "hide", "drop", None)]), k.cast("int"))
    decisions = orders.select(F.when(F.col("o_custkey") % 10 == 0, -F.col("o_orderkey")).otherwise(F.col("o_orderkey")).alias("id"), action.alias("action"), F.when(k == 1, "the owner's own").otherwise(" ").alias("note"))
    return answers.decision_outcomes(candidates, reports_of(spark, sf_dir), decisions)


@query("SELECT count(*) > 0 AS ok, 0 AS missing, TRUE AS reachable, count(*) AS brands FROM customer")
def health_answer(spark: SparkSession, sf_dir: str) -> DataFrame:
    row = answers.health(spark, {"state": True, "secret": True}, lambda: read(spark, sf_dir, "customer"), at(AS_OF))
    return row.select("ok", F.size("missing").alias("missing"), "database.reachable", F.col("database.brandsSeeded").alias("brands"))


# --- recorded fetches


_ERROR = f"CASE WHEN page_id % 13 = 0 THEN '{fetches.NOT_RESOLVED}' WHEN page_id % 17 = 0 THEN '{fetches.PRIVATE}' WHEN page_id % 11 = 0 THEN '{fetches.OVER_BUDGET}' WHEN page_id % 8 = 0 THEN 'refused' END"


@query(f"""SELECT page_id, page_id % 13 <> 0 AND page_id % 17 <> 0 AS attempted, error, CASE WHEN error IS NULL THEN CASE WHEN page_id % 4 = 0 THEN 404 ELSE 200 END END AS http_status, CASE WHEN error IS NULL THEN CASE WHEN page_id % 4 = 0 THEN 'http' ELSE 'https' END || '://d' || page_id || '.com/' END AS final_url,
error IS NULL AND (page_id % 7 = 0 OR ({_PARKED}) OR (length(html) < 1500 AND NOT {_PASSWORD} AND NOT contains(lower(html), '<form'))) AS parked, error IS NULL AND page_id % 7 <> 0 AND {_PASSWORD} AS password FROM (SELECT page_id, coalesce(html, '') AS html, {_ERROR} AS error FROM pages)""")
def fetch_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as the answer of a server over both schemes, some of them failing, late, of another type, or not to be asked."""
    pages, k = read(spark, sf_dir, "pages"), F.col("page_id")
    id_ = k.cast("string").alias("id")
    addresses = F.when(k % 13 == 0, F.array().cast("array<string>")).when(k % 17 == 0, domains.lits(["1.2.3.4", "10.0.0.1"])).otherwise(domains.lits(["1.2.3.4"]))
    targets = pages.select(id_, "page_id", F.concat(F.lit("d"), k.cast("string"), F.lit(".com")).alias("domain"), addresses.alias("a_records"), F.array().cast("array<string>").alias("terms"), F.when(k % 11 == 0, F.lit(0)).cast("long").alias("deadline_ms"))
    tries = F.array(
        F.struct(F.lit("https").alias("scheme"), F.lit(0).cast("long").alias("at_ms"), F.when(k % 4 != 0, 200).alias("status"), F.when(k % 4 == 0, "no certificate").alias("error")),
        F.struct(F.lit("http").alias("scheme"), F.lit(1000).cast("long").alias("at_ms"), F.when(k % 8 != 0, 404).alias("status"), F.when(k % 8 == 0, "refused").alias("error")),
    )
    rows = pages.select(id_, F.when(k % 7 == 0, "application/pdf").otherwise("text/html; charset=utf-8").alias("content_type"), F.encode("html", "UTF-8").alias("body"), F.explode(tries).alias("t"))
    rows = rows.select("id", "t.*", "content_type", "body", F.lit(10).cast("long").alias("took_ms"), F.lit(None).cast("string").alias("final_url"))
    return fetches.checks(targets, rows).select("page_id", "content.attempted", "content.error", "content.http_status", "content.final_url", F.col("content.looks_parked").alias("parked"), F.col("content.has_password_field").alias("password"))


# --- totals


@query("SELECT 'log' || s_suppkey % 3 AS log_url, count(*) AS entries, CAST(2 * count(*) FILTER (WHERE s_suppkey % 5 <> 0) AS BIGINT) AS names, count(*) FILTER (WHERE s_suppkey % 5 = 0) AS unparsed FROM supplier GROUP BY 1")
def scan_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as entries of three logs, every fifth a leaf that can't be read."""
    k = F.col("s_suppkey")
    entries = read(spark, sf_dir, "supplier").select(F.concat(F.lit("log"), (k % 3).cast("string")).alias("log_url"), k.alias("idx"), F.when(k % 5 == 0, "AAAA").otherwise(supplier_leaf()).alias("leaf_input"))
    return certificates.scan_totals(entries)


_CEILINGS = jobs.category_ceilings()


@query(" UNION ALL ".join(f"SELECT '{c}' AS category, {n} AS ceiling, CAST(coalesce(max(greatest(0, {f'p_{c}' if n else 0})), 0) AS INTEGER) AS most, count(*) FILTER (WHERE {f'p_{c} >= {n}' if n else 'FALSE'}) AS reached FROM {SCORED}" for c, n in _CEILINGS.items()))
def category_use(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.category_totals(checked_lines(spark, sf_dir).select(*[points.alias(c) for c, points in scoring.category_points().items()]))


_SEEDED = "(VALUES " + ", ".join(f"('{d}', '{why}', {i})" for i, (d, _slug, why) in enumerate(seed.cells(seed.ALLOWED))) + ")"


@query(f"SELECT domain, reason, count(*) AS candidates FROM orders JOIN {_SEEDED} t(domain, reason, i) ON o_orderkey % 40 = i GROUP BY 1, 2")
def seeded_allowlist(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as candidates, some with a name of the first allowlist: how many it holds back, by name."""
    names = [d for d, *_ in seed.cells(seed.ALLOWED)]
    domain = F.coalesce(F.get(domains.lits(names), (F.col("id") % 40).cast("int")), F.concat(F.lit("d"), F.col("id").cast("string"), F.lit(".com")))
    rows = candidates_of_orders(spark, sf_dir).withColumn("domain", domain)
    return rows.join(F.broadcast(seed.allowlist(spark)), "domain").groupBy("domain", "reason").agg(F.count("*").alias("candidates"))
