"""Registered queries: the operators on the driver's tables, and the same in DuckDB SQL.

The driver's tables hold no certificate data, so each query maps the table of the
right shape to an operator's input: hosts of pages to names, orders to candidates,
line items to verifications, events to histories.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from namelens import constants as C
from namelens.functions import content, domains, edit, folding
from namelens.operators import matching, prefilter, ranking, scoring, state
from namelens.plans import jobs, screening, views
from namelens.sources import lookups, watchlist

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

#: A small watchlist: slug, official domains, terms.
WATCHLIST = [
    ("alpha", ["ththre.com"], ["ththtion", "thering", "theres"]),
    ("beta", [], ["therha", "cheappills", "pills", "tionsh"]),
    ("gamma", ["ththth.net", "m.ththth.net"], ["ththers", "ththan", "therea", "ing", "tiontion"]),
]
ALLOWED = ["tionsh.net", "therin.net"]
PART_WORDS = ["ring", "bolt", "widget", "gizmo"]
AS_OF = "2000-01-01 00:00:00"
EVENTS_AS_OF = "2024-01-30 00:00:00"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def at(text: str) -> Column:
    return F.to_timestamp(F.lit(text))


def names_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names with one label of the host before a suffix of every kind."""
    host = domains.host_of(F.col("url"))
    return read(spark, sf_dir, "pages").select("page_id", F.regexp_replace(F.regexp_replace(host, r"\.example\.org$", ".co.in"), r"\.example\.(com|net)$", r".$1").alias("name"))


def in_list(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


def sql_list(values) -> str:
    return f"[{in_list(values)}]"


HOST = r"lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1))"
NAMES = rf"(SELECT page_id, regexp_replace(regexp_replace({HOST}, '\.example\.org$', '.co.in'), '\.example\.(com|net)$', '.\1') AS name FROM pages)"
LABELS = "list_filter(string_split(name, '.'), lambda x: x <> '')"
_TAIL = "array_to_string(({l})[greatest(1, len({l}) - {n} + 1):], '.')"
TAIL = lambda n, l=LABELS: _TAIL.format(l=l, n=n)  # noqa: E731, E741
SUFFIXES = in_list(C.MULTI_LABEL_SUFFIXES)
DOMAIN = f"CASE WHEN name = '' OR len({LABELS}) < 2 THEN NULL WHEN len({LABELS}) >= 4 AND {TAIL(3)} IN ({SUFFIXES}) THEN {TAIL(4)} WHEN len({LABELS}) >= 3 AND {TAIL(2)} IN ({SUFFIXES}) THEN {TAIL(3)} ELSE {TAIL(2)} END"
PARTS = "string_split(domain, '.')"
SUFFIX = f"CASE WHEN len({PARTS}) >= 3 AND {TAIL(3, PARTS)} IN ({SUFFIXES}) THEN {TAIL(3, PARTS)} WHEN len({PARTS}) >= 2 AND {TAIL(2, PARTS)} IN ({SUFFIXES}) THEN {TAIL(2, PARTS)} ELSE {TAIL(1, PARTS)} END"
LABEL = f"left(domain, length(domain) - length({SUFFIX}) - 1)"
FOLDED = "translate(lower(label), '013547', 'olesat')"
TOKENS = "list_filter(regexp_split_to_array(folded, '[^a-z0-9]+'), lambda x: x <> '')"
FLAT = "regexp_replace(folded, '[^a-z0-9]', '', 'g')"
IGNORED = " OR ".join(f"domain = '{s}' OR ends_with(domain, '.{s}')" for s in C.IGNORED_SUFFIXES)
SCREENED = f"""
d AS (SELECT DISTINCT {DOMAIN} AS domain FROM {NAMES}),
l AS (SELECT domain, {LABEL} AS label FROM d WHERE domain IS NOT NULL AND NOT ({IGNORED})),
f AS (SELECT domain, label, {FOLDED} AS folded FROM l WHERE label <> ''),
labels AS (SELECT domain, folded, {TOKENS} AS tokens, {FLAT} AS flat FROM f)"""
TERMS = "terms(slug, own, brand_ord, term, term_ord) AS (VALUES " + ", ".join(f"('{s}', {sql_list(own) if own else '[]::VARCHAR[]'}, {b}, '{t}', {i})" for b, (s, own, terms) in enumerate(WATCHLIST) for i, t in enumerate(terms)) + ")"
DISTANCES = "list_filter(list_transform(list_filter(list_concat([flat], tokens), lambda p: abs(length(p) - length(term)) <= 2 AND NOT list_contains(" + sql_list(C.STOP_PROBES) + ", p)), lambda p: damerau_levenshtein(p, term)), lambda v: v BETWEEN 1 AND 2)"
PAIRS = f"""
pairs AS (
  SELECT *, CASE WHEN list_contains(tokens, term) OR flat = term THEN 'exact_token'
                 WHEN length(term) >= 5 AND term NOT IN ({in_list(C.TOKEN_ONLY_TERMS)}) AND contains(flat, term) THEN 'substring'
                 WHEN length(term) >= 6 AND len({DISTANCES}) > 0 THEN 'edit_distance' END AS kind,
         CAST(CASE WHEN list_contains(tokens, term) OR flat = term OR (length(term) >= 5 AND contains(flat, term)) THEN 0 ELSE list_min({DISTANCES}) END AS INTEGER) AS distance
  FROM labels, terms
)"""


@query(f"SELECT page_id, name, domain, {SUFFIX} AS suffix FROM (SELECT page_id, name, {DOMAIN} AS domain FROM {NAMES})")
def registrable_domain(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = names_of(spark, sf_dir).withColumn("domain", domains.registrable_domain(F.col("name")))
    return rows.withColumn("suffix", domains.public_suffix(F.col("domain")))


@query(f"SELECT domain, count(*) AS pages FROM (SELECT {DOMAIN} AS domain FROM {NAMES}) GROUP BY domain")
def pages_by_domain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return names_of(spark, sf_dir).groupBy(domains.registrable_domain(F.col("name")).alias("domain")).agg(F.count("*").alias("pages"))


@query(f"SELECT page_id, label, array_to_string(list_filter(regexp_split_to_array(lower(label), '[^a-z0-9]+'), lambda x: x <> ''), ' ') AS tokens, regexp_replace(lower(label), '[^a-z0-9]', '', 'g') AS flat FROM (SELECT page_id, {LABEL} AS label FROM (SELECT page_id, {DOMAIN} AS domain FROM {NAMES}))")
def label_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = domains.registrable_label(F.col("name"))
    return names_of(spark, sf_dir).select("page_id", label.alias("label"), F.array_join(domains.tokenize(label), " ").alias("tokens"), domains.flatten(label).alias("flat"))


@query(f"SELECT page_id, domain, ({IGNORED}) AS ignorable FROM (SELECT page_id, CASE WHEN page_id % 3 = 0 THEN name || '.pages.dev' ELSE name END AS domain FROM {NAMES})")
def structural_ignore(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.when(F.col("page_id") % 3 == 0, F.concat("name", F.lit(".pages.dev"))).otherwise(F.col("name"))
    return names_of(spark, sf_dir).select("page_id", name.alias("domain"), domains.is_ignorable(name).alias("ignorable"))


_WORDS = sql_list(PART_WORDS)
_STEM = f"CASE WHEN list_contains({_WORDS}, t) THEN t WHEN ends_with(t, 's') AND list_contains({_WORDS}, t[:-2]) THEN t[:-2] WHEN ends_with(t, 'es') AND list_contains({_WORDS}, t[:-3]) THEN t[:-3] END"


@query(f"SELECT p_partkey, array_to_string(list_sort(list_distinct(list_filter(list_transform(list_filter(regexp_split_to_array(lower(p_name || 's'), '[^a-z0-9]+'), lambda x: x <> ''), lambda t: {_STEM}), lambda k: k IS NOT NULL))), ',') AS hits FROM part")
def keyword_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = domains.keyword_hits(domains.tokenize(F.concat("p_name", F.lit("s"))), PART_WORDS)
    return read(spark, sf_dir, "part").select("p_partkey", F.array_join(F.array_sort(found), ",").alias("hits"))


@query(f"SELECT p_partkey, term FROM (SELECT DISTINCT p_partkey, unnest(string_split(p_name, ' ')) AS term FROM part) WHERE term IN ({in_list(PART_WORDS)})")
def exact_token_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("domain"), domains.tokenize(F.col("p_name")).alias("tokens"), domains.flatten(F.col("p_name")).alias("flat"))
    terms = spark.createDataFrame([(w,) for w in PART_WORDS], "term string")
    return matching.exact_pairs(parts, terms).select(F.col("domain").alias("p_partkey"), "term")


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.screened(names_of(spark, sf_dir))


def _terms(spark: SparkSession) -> DataFrame:
    return matching.explode_terms(watchlist.brands_of(spark, WATCHLIST))


@query(f"WITH {SCREENED}, {TERMS} SELECT domain, term FROM labels, terms WHERE length(term) >= 5 AND contains(flat, term)")
def substring_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.substring_pairs(_labels(spark, sf_dir), _terms(spark))


@query(f"WITH {SCREENED}, {TERMS} SELECT domain, term, CAST(list_min({DISTANCES}) AS INTEGER) AS distance FROM labels, terms WHERE length(term) >= 6 AND len({DISTANCES}) > 0")
def fuzzy_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.fuzzy_pairs(_labels(spark, sf_dir), _terms(spark))


@query(f"""WITH {SCREENED}, {TERMS}, {PAIRS}
SELECT domain, slug AS brand_slug, term AS matched_term, kind AS match_kind, distance AS edit_distance FROM (
  SELECT *, row_number() OVER (PARTITION BY domain ORDER BY CASE kind WHEN 'exact_token' THEN 5 WHEN 'edit_distance' THEN 3 ELSE 1 END DESC, distance, length(term) DESC, brand_ord, term_ord) AS n
  FROM pairs WHERE kind IS NOT NULL AND NOT list_contains(own, domain) AND domain NOT IN ({in_list(ALLOWED)})) WHERE n = 1""")
def best_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    allowed = spark.createDataFrame([(d,) for d in ALLOWED], "domain string")
    found = matching.best_matches(names_of(spark, sf_dir), watchlist.brands_of(spark, WATCHLIST), allowed)
    return found.select("domain", "brand_slug", "matched_term", "match_kind", "edit_distance")


@query("SELECT a.n_nationkey AS a, b.n_nationkey AS b, CAST(levenshtein(a.n_name, b.n_name) AS INTEGER) AS distance FROM nation a JOIN nation b ON a.n_nationkey < b.n_nationkey AND levenshtein(a.n_name, b.n_name) <= 2")
def levenshtein_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = read(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    return edit.close_pairs(n, n, "n_name").where("n_nationkey_a < n_nationkey_b").select(F.col("n_nationkey_a").alias("a"), F.col("n_nationkey_b").alias("b"), "distance")


@query("SELECT p_partkey, 1.0::DOUBLE - damerau_levenshtein(p_name, 'red widget') / greatest(length(p_name), 10)::DOUBLE AS similarity FROM part")
def name_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "part").select("p_partkey", edit.similarity(F.col("p_name"), F.lit("red widget")).alias("similarity"))


_LIST = lambda terms: sql_list(terms) if terms else "[]::VARCHAR[]"
_USABLE = sorted({t for _, _, every in WATCHLIST for t in every if len(t) >= C.TERM_LENGTH})
_LONG, _SHORT, _FUZZY = ([t for t in _USABLE if len(t) >= C.SUBSTRING_LENGTH], [t for t in _USABLE if len(t) < C.SUBSTRING_LENGTH], [t for t in _USABLE if len(t) >= C.FUZZY_LENGTH])
_DELETED = lambda x: f"list_transform(range(1, length({x}) + 1), lambda i: {x}[:i - 1] || {x}[i + 1:])"
_AROUND = {1: lambda x: f"list_append({_DELETED(x)}, {x})", 2: lambda x: f"list_concat(list_append({_DELETED(x)}, {x}), flatten(list_transform({_DELETED(x)}, lambda d: list_transform(range(1, length(d) + 1), lambda j: d[:j - 1] || d[j + 1:]))))"}


def _passes(mode: str, form: str, most: int) -> str:
    low, high = min(map(len, _FUZZY)) - most, max(map(len, _FUZZY)) + most
    flat, parts = f"regexp_replace({form}, '[^a-z0-9]', '', 'g')", f"regexp_split_to_array({form}, '[^a-z0-9]+')"
    return f"""SELECT DISTINCT name, '{mode}' AS mode FROM (SELECT name, {flat} AS flat, list_append({parts}, {flat}) AS parts FROM names)
    WHERE len(list_filter({_LIST(_LONG)}, lambda t: contains(flat, t))) > 0 OR len(list_intersect(parts, {_LIST(_SHORT)})) > 0
    UNION SELECT DISTINCT name, '{mode}' FROM (SELECT name, unnest(list_append({parts}, {flat})) AS p FROM names), (SELECT unnest({_LIST(_FUZZY)}) AS t)
    WHERE length(p) BETWEEN {low} AND {high} AND len(list_intersect({_AROUND[most]('p')}, {_AROUND[most]('t')})) > 0"""


@query(f"""WITH names AS (SELECT DISTINCT lower(name) AS name, translate(lower(name), '013547', 'olesat') AS folded FROM {NAMES}), hits AS ({_passes('compat', 'name', 1)} UNION {_passes('sound', 'name', 2)} UNION {_passes('sound', 'folded', 2)})
SELECT page_id, n.name, mode FROM {NAMES} n JOIN hits h ON h.name = lower(n.name)""")
def prefilter_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    terms = [t for _, _, every in WATCHLIST for t in every]
    names = names_of(spark, sf_dir)
    return prefilter.interesting(names, terms, "compat").withColumn("mode", F.lit("compat")).unionByName(prefilter.interesting(names, terms, "sound").withColumn("mode", F.lit("sound")))


@query(f"SELECT page_id, domain FROM (SELECT page_id, {DOMAIN} AS domain FROM {NAMES}) WHERE domain NOT IN ({in_list(ALLOWED)})")
def allowlist_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = names_of(spark, sf_dir).select("page_id", domains.registrable_domain(F.col("name")).alias("domain"))
    return rows.join(spark.createDataFrame([(d,) for d in ALLOWED], "domain string"), "domain", "left_anti")


@query(r"SELECT lang, count(*) AS docs, CAST(sum(CASE WHEN regexp_matches(text, '[^\x00-\x7F]') THEN 1 ELSE 0 END) AS BIGINT) AS non_ascii FROM documents GROUP BY lang")
def non_ascii_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").groupBy("lang").agg(F.count("*").alias("docs"), F.count_if(domains.has_non_ascii(F.col("text"))).alias("non_ascii"))


_ODD = "CASE WHEN p_partkey % 3 = 0 THEN replace(p_name, 'e', 'е') WHEN p_partkey % 3 = 1 THEN replace(p_name, 'o', 'ο') ELSE p_name END"
_ALPHABETS = {"Cyrillic": "[Ѐ-ӿ]", "Greek": "[Ͱ-Ͽ]", "Latin": "[A-Za-z]"}
_SCRIPTS = "list_filter([" + ", ".join(f"CASE WHEN regexp_matches(label, '{pattern}') THEN '{name}' END" for name, pattern in _ALPHABETS.items()) + "], lambda x: x IS NOT NULL)"


@query(f"SELECT p_partkey, array_to_string({_SCRIPTS}, ' ') AS scripts, len({_SCRIPTS}) > 1 AS mixed_script, regexp_matches(label, '[еο]') AS suspicious, len(regexp_extract_all(label, '[еο]')) AS changes FROM (SELECT p_partkey, {_ODD} AS label FROM part)")
def script_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts with one letter written in another alphabet: their scripts, whether these are mixed, and how many letters were folded."""
    p, name = F.col("p_partkey") % 3, F.col("p_name")
    label = F.when(p == 0, F.translate(name, "e", "е")).when(p == 1, F.translate(name, "o", "ο")).otherwise(name)
    rows = read(spark, sf_dir, "part").select("p_partkey", folding.fold(label).alias("f"))
    return rows.select("p_partkey", F.array_join(F.array_sort("f.scripts"), " ").alias("scripts"), "f.mixed_script", "f.suspicious", F.size(F.filter("f.substitutions", lambda s: domains.has_non_ascii(s["from"]))).cast("long").alias("changes"))


@query("SELECT doc_id, translate(lower(strip_accents(text)), '013547', 'olesat') AS folded FROM documents")
def fold_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", folding.folded(F.col("text")).alias("folded"))


@query("SELECT event_id, user_id, event_type, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def latest_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.latest_per_key(read(spark, sf_dir, "events"), "user_id", "ts", "event_id").select("event_id", "user_id", "event_type", "value")


@query("SELECT event_id, user_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 20")
def history_top20(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.history(read(spark, sf_dir, "events"), "user_id", "ts", "event_id").select("event_id", "user_id")


_LOGGED = "CASE WHEN event_id % 5 = 0 THEN NULL ELSE ts END"


@query(f"""WITH e AS (SELECT user_id, event_type, event_id, {_LOGGED} AS logged FROM events)
SELECT user_id, event_type, CASE WHEN arg_min(CASE WHEN logged IS NULL THEN 1 ELSE 0 END, event_id) = 1 THEN min(event_id) ELSE arg_min(event_id, row(logged, event_id)) FILTER (WHERE logged IS NOT NULL) END AS event_id FROM e GROUP BY user_id, event_type""")
def earliest_in_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "events").select("user_id", "event_type", "event_id", F.when(F.col("event_id") % 5 != 0, F.col("ts")).alias("at"))
    return ranking.earliest_in_batch(rows, ["user_id", "event_type"], "at", "event_id").select("user_id", "event_type", "event_id")


def candidates_of_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as candidates: status as state, date as the time first seen."""
    shown = F.when(F.col("o_orderstatus") == "F", "published").when(F.col("o_orderstatus") == "P", "pending_review").otherwise("hidden")
    return read(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("brand"), shown.alias("publish_state"), F.col("o_orderdate").cast("timestamp").alias("first_seen_at"),
        F.when(F.col("o_orderpriority") == "1-URGENT", "new").when(F.col("o_orderpriority") == "5-LOW", "retired").otherwise("verified").alias("status"), "o_totalprice",
    )


STATE = "CASE o_orderstatus WHEN 'F' THEN 'published' WHEN 'P' THEN 'pending_review' ELSE 'hidden' END"
STATUS = "CASE o_orderpriority WHEN '1-URGENT' THEN 'new' WHEN '5-LOW' THEN 'retired' ELSE 'verified' END"
CANDIDATES = f"(SELECT o_orderkey AS id, o_custkey AS brand, {STATE} AS publish_state, o_orderdate AS first_seen_at, {STATUS} AS status, o_totalprice FROM orders)"


@query(f"""SELECT count(*) FILTER (WHERE publish_state = 'published') AS published, count(*) FILTER (WHERE publish_state = 'pending_review') AS pending,
count(*) FILTER (WHERE publish_state <> 'hidden' AND first_seen_at >= TIMESTAMP '{AS_OF}' - INTERVAL 24 HOUR) AS last_24h, count(*) FILTER (WHERE publish_state <> 'hidden' AND first_seen_at >= TIMESTAMP '{AS_OF}' - INTERVAL 168 HOUR) AS last_7d,
(SELECT count(*) FILTER (WHERE c_acctbal > 0) FROM customer) AS brands FROM {CANDIDATES}""")
def stats_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    brands = read(spark, sf_dir, "customer").select((F.col("c_acctbal") > 0).alias("active"))
    return views.stats(candidates_of_orders(spark, sf_dir), brands, at(AS_OF))


def feed_tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Orders as candidates, customers as brands; line items of larger quantities as scores and of smaller ones as verifications, so that left joins miss some."""
    none = F.lit(None).cast("string")
    candidates = candidates_of_orders(spark, sf_dir).withColumns({
        "domain": F.concat(F.lit("d"), F.col("id").cast("string"), F.lit(".com")), "unicode_domain": none, "matched_brand_id": F.col("brand"), "matched_term": none, "match_kind": none,
        "homoglyph_flag": F.lit(False), "cert_issuer": none, "cert_issued_at": F.col("first_seen_at"), "last_seen_at": F.col("first_seen_at"),
    })
    brands = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.lower("c_name").alias("slug"), F.col("c_mktsegment").alias("category"), F.array(F.concat("c_name", F.lit(".com"))).alias("official_domains"))
    lines = read(spark, sf_dir, "lineitem").withColumns({"id": F.col("l_linenumber") * 1_000_000 + F.col("l_partkey"), "candidate_id": F.col("l_orderkey"), "at": F.col("l_shipdate")})
    points = F.array(F.struct(F.lit("k").alias("key"), F.col("l_linenumber").alias("points")))
    scores = lines.where("l_quantity > 10").select("id", "candidate_id", F.col("at").alias("computed_at"), F.col("l_quantity").cast("int").alias("score"), F.when(F.col("l_quantity") > 40, "high").when(F.col("l_quantity") > 20, "medium").otherwise("low").alias("tier"), points.alias("contributing_signals"))
    checks = lines.where("l_quantity < 30").select("id", "candidate_id", F.col("at").alias("checked_at"), (F.col("l_linestatus") == "O").alias("resolves"), F.col("l_linenumber").alias("domain_age_days"), F.col("l_returnflag").alias("registrar"), none.alias("page_title"), (F.col("l_returnflag") == "R").alias("has_password_field"), F.lit(False).alias("looks_parked"))
    return candidates, brands, scores, checks


def _latest(where: str) -> str:
    return f"(SELECT * FROM lineitem WHERE {where} QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate DESC, l_linenumber * 1000000 + l_partkey DESC) = 1)"


_FEED = f"""(SELECT c.id, b.c_name AS brand_name, c.publish_state, CAST(s.l_quantity AS INTEGER) AS score, CASE WHEN s.l_quantity > 40 THEN 'high' WHEN s.l_quantity > 20 THEN 'medium' WHEN s.l_quantity IS NOT NULL THEN 'low' END AS tier,
s.l_linenumber AS points, v.l_linestatus = 'O' AS resolves, v.l_linenumber AS age, v.l_returnflag AS registrar FROM {CANDIDATES} c JOIN customer b ON c.brand = b.c_custkey
LEFT JOIN {_latest('l_quantity > 10')} s ON s.l_orderkey = c.id LEFT JOIN {_latest('l_quantity < 30')} v ON v.l_orderkey = c.id WHERE publish_state IN ('published', 'pending_review'))"""


@query(f"SELECT id, brand_name, publish_state, score, tier, resolves, age, registrar FROM {_FEED}")
def feed_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    feed = views.public_feed(*feed_tables(spark, sf_dir))
    return feed.select("id", "brand_name", "publish_state", "score", "tier", "resolves", F.col("domain_age_days").alias("age"), "registrar")


@query(f"""SELECT id, brand_name AS brand, brand_name || '.com' AS official_domain, coalesce(tier, 'medium') AS tier, coalesce(score, 0) AS score, CAST(points IS NOT NULL AS INTEGER) AS signals, publish_state = 'published' AND coalesce(tier, 'medium') = 'high' AS confirmed,
CASE WHEN publish_state = 'pending_review' THEN 'unconfirmed' ELSE coalesce(tier, 'medium') END AS status FROM {_FEED}""")
def feed_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = views.feed_items(views.public_feed(*feed_tables(spark, sf_dir)))
    return items.select("id", F.col("brand.name").alias("brand"), "brand.official_domain", "tier", "score", F.size("signals").alias("signals"), "confirmed", "status")


@query(f"SELECT l_orderkey AS candidate_id, l_linenumber AS line, l_linestatus = 'O' AS resolves FROM {_latest('l_quantity < 30')}")
def current_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    checks = views.current_verifications(feed_tables(spark, sf_dir)[3])
    return checks.select("candidate_id", F.col("domain_age_days").alias("line"), "resolves")


@query("SELECT o_orderkey, (SELECT count(*) FROM orders) AS total FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 50 OFFSET 100")
def feed_page_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.page_with_total(read(spark, sf_dir, "orders"), [F.desc("o_orderdate"), F.asc("o_orderkey")], 100, 50).select("o_orderkey", "total")


@query("SELECT c_custkey, c_mktsegment FROM customer WHERE c_acctbal > 0 ORDER BY c_mktsegment, c_name")
def brand_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    brands = read(spark, sf_dir, "customer").select("c_custkey", F.col("c_mktsegment").alias("category"), F.col("c_name").alias("name"), (F.col("c_acctbal") > 0).alias("active"))
    return ranking.brand_listing(brands).select("c_custkey", F.col("category").alias("c_mktsegment"))


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 50 OFFSET 100")
def feed_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.page(read(spark, sf_dir, "orders"), [F.desc("o_orderdate"), F.asc("o_orderkey")], 100, 50).select("o_orderkey", "o_totalprice")


@query(f"SELECT id, status FROM {CANDIDATES} WHERE first_seen_at <= TIMESTAMP '{AS_OF}' AND status <> 'retired' ORDER BY status, first_seen_at, id LIMIT 25")
def due_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = candidates_of_orders(spark, sf_dir).withColumnRenamed("first_seen_at", "next_recheck_at")
    return ranking.due(rows, at(AS_OF)).select("id", "status")


@query(f"""SELECT c.id, s.score FROM {CANDIDATES} c LEFT JOIN (SELECT l_orderkey, CAST(count(*) AS BIGINT) AS score FROM lineitem WHERE l_returnflag = 'R' GROUP BY l_orderkey) s ON s.l_orderkey = c.id
WHERE publish_state = 'pending_review' ORDER BY score DESC NULLS FIRST, id LIMIT 100""")
def review_queue_nulls_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = read(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").groupBy(F.col("l_orderkey").alias("id")).agg(F.count("*").alias("score"))
    return ranking.review_queue(candidates_of_orders(spark, sf_dir).join(scores, "id", "left")).select("id", "score")


@query(f"SELECT l_orderkey AS candidate_id, l_linenumber AS line FROM lineitem SEMI JOIN (SELECT id FROM {CANDIDATES} WHERE publish_state <> 'hidden') c ON c.id = l_orderkey")
def visibility_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("candidate_id"), F.col("l_linenumber").alias("line"))
    tables = {"candidates": candidates_of_orders(spark, sf_dir), "brands": read(spark, sf_dir, "customer"), "verifications": lines}
    return views.visible_to("anon", tables)["verifications"]


@query(f"""SELECT c.id, coalesce(r.n, 0) AS reports, coalesce(r.disputed, false) AS disputed FROM {CANDIDATES} c LEFT JOIN (
SELECT l_orderkey, CAST(count(*) AS INTEGER) AS n, bool_or(l_returnflag = 'R') AS disputed FROM lineitem WHERE l_linestatus = 'O' GROUP BY l_orderkey) r ON r.l_orderkey = c.id""")
def report_attach(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("l_returnflag") == "R", "dispute").otherwise("confirm")
    reports = read(spark, sf_dir, "lineitem").select(F.col("l_linenumber").alias("id"), F.col("l_orderkey").alias("candidate_id"), kind.alias("kind"), F.lit("").alias("note"), F.when(F.col("l_linestatus") == "O", "open").otherwise("resolved").alias("status"), F.col("l_shipdate").alias("created_at"))
    return views.with_reports(candidates_of_orders(spark, sf_dir), reports).select("id", F.coalesce(F.size("reports"), F.lit(0)).alias("reports"), "disputed")


@query(f"WITH {SCREENED}, {TERMS}, {PAIRS} SELECT domain, domain NOT IN (SELECT domain FROM pairs WHERE kind IS NOT NULL AND NOT list_contains(own, domain)) AS stale FROM labels")
def prune_stale(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = names_of(spark, sf_dir)
    brands = watchlist.brands_of(spark, WATCHLIST)
    live = matching.screened(names).select("domain", F.lit("published").alias("publish_state"), F.lit(None).cast("timestamp").alias("reviewed_at"), F.lit(None).cast("string").alias("reviewed_note"))
    after = state.prune(live, matching.all_matches(names, brands), at(AS_OF))
    return after.select("domain", (F.col("publish_state") == "hidden").alias("stale"))


@query("SELECT user_id, last_at FROM (SELECT user_id, CASE WHEN user_id % 10 = 3 THEN NULL ELSE max(ts) END AS last_at FROM events GROUP BY user_id) ORDER BY last_at ASC NULLS FIRST, user_id LIMIT 20")
def rotation_lru(spark: SparkSession, sf_dir: str) -> DataFrame:
    last = read(spark, sf_dir, "events").groupBy("user_id").agg(F.max("ts").alias("last_at")).withColumn("last_at", F.when(F.col("user_id") % 10 != 3, F.col("last_at")))
    return ranking.least_recent(last, "last_at", "user_id", 20)


@query("SELECT doc_id, source, depth FROM (SELECT doc_id, source, CAST(row_number() OVER (PARTITION BY source ORDER BY doc_id) AS INTEGER) AS depth, min(doc_id) OVER (PARTITION BY source) AS g FROM documents) ORDER BY depth, g LIMIT 50")
def spread_round_robin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.round_robin(read(spark, sf_dir, "documents").select("doc_id", "source"), "source", "doc_id", 50).select("doc_id", "source", "depth")


GAP = "CAST(floor((epoch_ms(l_shipdate) - epoch_ms(o_orderdate)) / 86400000.0) AS BIGINT)"


@query(f"SELECT l_orderkey, l_linenumber, {GAP} AS gap, CASE WHEN {GAP} <= 0 THEN 'same day' WHEN {GAP} <= 3 THEN 'three days' ELSE 'later' END AS bucket FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
def cert_gap_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "lineitem").join(read(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    gap = scoring.days_between(F.col("l_shipdate").cast("timestamp"), F.col("o_orderdate").cast("timestamp"))
    return rows.select("l_orderkey", "l_linenumber", gap.alias("gap"), F.when(gap <= 0, "same day").when(gap <= 3, "three days").otherwise("later").alias("bucket"))


def checked_lines(spark: SparkSession, sf_dir: str, told: bool = False) -> DataFrame:
    """Line items as verified candidates, with every signal on some of them; told: with what labels and details speak of."""
    more = [
        F.col("l_partkey").cast("string").alias("matched_term"), F.concat(F.lit("Brand "), F.col("l_suppkey").cast("string")).alias("brand_name"),
        F.array(F.concat(F.lit("10.0.0."), F.col("l_linenumber").cast("string")), *[F.lit(f"10.{i}.0.1") for i in (1, 2, 3)]).alias("a_records"),
        F.struct(F.array(*[F.struct(F.lit(c).alias("from"), F.lit(to).alias("to"), F.lit(f"U+{ord(c):04X}").alias("codepoint")) for c, to in (("0", "o"), ("\u0435", "e"))]).alias("substitutions"), domains.lits(["Latin", "Cyrillic"]).alias("scripts")).alias("homoglyph_detail"),
    ] if told else []
    rows = read(spark, sf_dir, "lineitem").join(read(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    kinds = list(C.KIND_RANK)
    return rows.select(
        F.col("l_orderkey"), F.col("l_linenumber"), F.when(F.col("l_partkey") % 3 == 0, "my-login.com").otherwise("my-shop.com").alias("domain"),
        F.get(domains.lits(kinds), (F.col("l_partkey") % 5).cast("int")).alias("match_kind"), (F.col("l_suppkey") % 2 + 1).cast("int").alias("edit_distance"),
        (F.col("l_suppkey") % 7 == 0).alias("mixed_script"), (F.col("l_linestatus") == "O").alias("resolves"), (F.col("l_returnflag") == "R").alias("has_mx"),
        F.when(F.col("l_partkey") % 11 != 0, (F.col("l_orderkey") % 400).cast("int")).alias("domain_age_days"), F.col("o_orderdate").cast("timestamp").alias("domain_created_at"),
        F.col("l_shipdate").cast("timestamp").alias("cert_issued_at"), F.when(F.col("l_suppkey") % 4 == 0, "C=US, O=Let's Encrypt").alias("cert_issuer"),
        (F.col("l_quantity") > 25).alias("has_password_field"), F.when(F.col("l_discount") > 0.05, domains.lits(["brand"])).alias("brand_terms_on_page"),
        (F.col("l_tax") > 0.06).alias("form_posts_offsite"), (F.col("l_quantity") < 5).alias("looks_parked"), F.lit(None).cast("int").alias("asn_reputation_score"), *more,
    )


def scored_lines(spark: SparkSession, sf_dir: str, notes: bool = False, told: bool = False) -> DataFrame:
    return scoring.scored(checked_lines(spark, sf_dir, told), notes)


_W = C.WEIGHTS
_KIND = "['substring', 'keyword_combo', 'edit_distance', 'homoglyph', 'exact_token'][1 + l_partkey % 5]"
_AGE = "CASE WHEN l_partkey % 11 <> 0 THEN l_orderkey % 400 END"
_POINTS = {
    "name": [f"CASE {_KIND} WHEN 'homoglyph' THEN 28 WHEN 'exact_token' THEN 18 WHEN 'keyword_combo' THEN 18 WHEN 'substring' THEN 8 ELSE CASE WHEN l_suppkey % 2 = 0 THEN 12 ELSE 8 END END", "CASE WHEN l_partkey % 3 = 0 THEN 10 ELSE 0 END", f"CASE WHEN l_suppkey % 7 = 0 AND {_KIND} <> 'homoglyph' THEN 6 ELSE 0 END"],
    "infrastructure": ["CASE WHEN l_linestatus = 'O' THEN 20 ELSE 0 END", "CASE WHEN l_returnflag = 'R' THEN 6 ELSE 0 END"],
    "registration": [f"CASE WHEN {_AGE} < 3 THEN 14 WHEN {_AGE} < 7 THEN 12 WHEN {_AGE} < 30 THEN 8 WHEN {_AGE} < 90 THEN 4 ELSE 0 END"],
    "content": ["CASE WHEN l_quantity > 25 THEN 22 ELSE 0 END", "CASE WHEN l_discount > 0.05 THEN 12 ELSE 0 END", "CASE WHEN l_quantity > 25 AND l_discount > 0.05 THEN 12 ELSE 0 END", "CASE WHEN l_tax > 0.06 THEN 6 ELSE 0 END"],
    "certificate": [f"CASE WHEN {GAP} <= 0 THEN 8 WHEN {GAP} <= 3 THEN 4 ELSE 0 END", "CASE WHEN l_suppkey % 4 = 0 THEN 4 ELSE 0 END"],
    "mitigating": [f"CASE WHEN {_AGE} > 365 THEN -18 ELSE 0 END", "CASE WHEN l_quantity < 5 THEN -15 ELSE 0 END"],
}
_SUMS = ", ".join(f"{' + '.join(v)} AS p_{k}" for k, v in _POINTS.items())
_SCORE = f"greatest(0, least(100, {' + '.join(f'p_{k}' for k in _POINTS)}))"
_CATEGORIES = " + ".join(f"(p_{k} > 0)::INT" for k in _POINTS if k != "mitigating")
SCORED = f"(SELECT *, {_SCORE} AS score, {_CATEGORIES} AS n_categories FROM (SELECT l_orderkey, l_linenumber, l_quantity, l_linestatus, {_KIND} AS kind, {_SUMS} FROM lineitem JOIN orders ON l_orderkey = o_orderkey))"


@query(f"SELECT l_orderkey, l_linenumber, CAST(score AS INTEGER) AS score, CAST(n_categories AS INTEGER) AS n_categories FROM {SCORED}")
def signal_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored_lines(spark, sf_dir).select("l_orderkey", "l_linenumber", "score", F.size("categories").alias("n_categories"))


TIER = "CASE WHEN score >= 70 AND (l_linestatus <> 'O' OR n_categories < 2 OR NOT (l_quantity > 25 OR kind = 'homoglyph')) THEN 'medium' WHEN score >= 70 THEN 'high' WHEN score >= 45 THEN 'medium' ELSE 'low' END"


@query(f"SELECT l_orderkey, l_linenumber, tier, CASE tier WHEN 'high' THEN 'published' WHEN 'medium' THEN 'pending_review' ELSE 'hidden' END AS publish_state FROM (SELECT *, {TIER} AS tier FROM {SCORED})")
def gates_and_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored_lines(spark, sf_dir).select("l_orderkey", "l_linenumber", "tier", scoring.publish_state(F.col("tier"), F.lit("hidden")).alias("publish_state"))


@query(f"""SELECT l_orderkey, l_linenumber, CASE WHEN l_linestatus = 'O' THEN 0 ELSE l_orderkey % 20 + 1 END AS recheck_count,
CASE WHEN l_linestatus <> 'O' AND l_orderkey % 20 + 1 >= 14 AND tier = 'low' THEN 'retired' ELSE 'verified' END AS status,
CAST(CASE WHEN l_linestatus <> 'O' THEN 24 WHEN tier = 'low' THEN 48 ELSE 6 END AS BIGINT) AS hours FROM (SELECT *, {TIER} AS tier FROM {SCORED})""")
def recheck_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scored_lines(spark, sf_dir).withColumns({"recheck_count": F.col("l_orderkey") % 20, "publish_state": F.lit("hidden")})
    after = state.after_recheck(rows, at(AS_OF))
    return after.select("l_orderkey", "l_linenumber", "recheck_count", "status", ((F.unix_timestamp("next_recheck_at") - F.unix_timestamp(at(AS_OF))) / 3600).cast("long").alias("hours"))


@query("SELECT o_orderkey AS k, o_orderstatus AS v FROM orders WHERE o_orderkey NOT IN (SELECT c_custkey FROM customer)")
def insert_if_absent(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"))
    delta = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("v"))
    return state.insert_if_absent(held, delta, "k")


@query("SELECT coalesce(c_custkey, o_orderkey) AS k, coalesce(o_orderstatus, c_mktsegment) AS v, c_acctbal AS w FROM customer FULL JOIN orders ON c_custkey = o_orderkey")
def upsert_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.col("c_mktsegment").alias("v"), F.col("c_acctbal").alias("w"))
    delta = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("v"))
    return state.upsert(held, delta, "k")


@query("SELECT coalesce(c_custkey, k) AS k, c_name AS name, CAST(coalesce(c_nationkey, 0) + coalesce(n, 0) AS BIGINT) AS seen FROM customer FULL JOIN (SELECT o_orderkey // 3 AS k, count(*) AS n FROM orders GROUP BY 1) ON k = c_custkey")
def counter_accumulate(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("name"), F.col("c_nationkey").cast("long").alias("seen"))
    delta = read(spark, sf_dir, "orders").select(F.floor(F.col("o_orderkey") / 3).alias("k"), F.lit(1).cast("long").alias("seen"))
    return state.accumulate(held, delta, "k", ["seen"])


_ACTION = "['publish', 'clear', 'hide', NULL][1 + id % 4]"


@query(f"""SELECT id, CASE {_ACTION} WHEN 'publish' THEN 'published' WHEN 'clear' THEN 'cleared' WHEN 'hide' THEN 'hidden' ELSE publish_state END AS publish_state,
CASE WHEN {_ACTION} = 'clear' THEN 'retired' ELSE status END AS status, coalesce({_ACTION} = 'clear', false) AS allowed FROM {CANDIDATES}""")
def review_transition(spark: SparkSession, sf_dir: str) -> DataFrame:
    none = F.lit(None).cast("string")
    rows = candidates_of_orders(spark, sf_dir).withColumns({"domain": F.col("id").cast("string"), "matched_brand_id": F.col("brand").cast("string"), "reviewed_at": F.lit(None).cast("timestamp"), "reviewed_note": none})
    decisions = rows.where("id % 4 <> 3").select("id", F.get(domains.lits(["publish", "clear", "hide"]), (F.col("id") % 4).cast("int")).alias("action"), F.lit("seen").alias("note"), F.lit("me").alias("reviewer"))
    after, allowed = state.review(rows, decisions, at(AS_OF))
    return after.join(allowed.select("domain", F.lit(True).alias("allowed")), "domain", "left").select("id", "publish_state", "status", F.coalesce("allowed", F.lit(False)).alias("allowed"))


@query("""SELECT count(*) AS seen, count(*) FILTER (WHERE event_type = 'click') AS skipped_allowlisted, (SELECT count(DISTINCT user_id) FROM events) AS matched,
(SELECT count(DISTINCT user_id) FROM events WHERE user_id NOT IN (SELECT n_nationkey FROM nation)) AS inserted, (SELECT count(DISTINCT user_id) FROM events WHERE user_id IN (SELECT n_nationkey FROM nation)) AS updated FROM events""")
def ingest_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = read(spark, sf_dir, "events").select(F.col("event_type").alias("name"), F.col("user_id").alias("domain"))
    known = read(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("domain"))
    return screening.counters(events.select("name"), events.select("domain").distinct(), known, spark.createDataFrame([("click",)], "domain string"))


@query("""SELECT user_id, count(*) AS queried, count(*) FILTER (WHERE value > 400) AS with_rows, count(*) FILTER (WHERE value > 400) = 0 AS degraded, round(CAST(count(*) FILTER (WHERE value > 400) AS DOUBLE) / count(*) * 100, 4) AS hit_rate,
array_to_string(list_sort(list(DISTINCT event_type) FILTER (WHERE NOT coalesce(value > 400, false))), ',') AS empty_terms FROM events GROUP BY user_id""")
def degraded_detector(spark: SparkSession, sf_dir: str) -> DataFrame:
    answers = read(spark, sf_dir, "events").withColumn("n_rows", (F.col("value") > 400).cast("int"))
    return jobs.source_health(answers, "user_id", "event_type", "n_rows").withColumn("empty_terms", F.array_join("empty_terms", ","))


@query(r"""SELECT page_id, left(trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_extract(html, '(?is)<title[^>]*>(.{0,300}?)</title>', 1), '&amp;', '&'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&nbsp;', ' '), '\s+', ' ', 'g')), 200) AS page_title FROM pages""")
def html_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "pages").select("page_id", content.title(F.col("html")).alias("page_title"))


_PARKED = " OR ".join(f"contains(lower(html), '{m}')" for m in C.PARKING_MARKERS)
_PASSWORD = r"""regexp_matches(html, '(?i)<input[^>]+type\s*=\s*["'']?password["'']?')"""


@query(f"SELECT page_id, ({_PARKED}) OR (length(html) < 1500 AND NOT {_PASSWORD} AND NOT contains(lower(html), '<form')) AS parked, {_PASSWORD} AS password FROM pages")
def html_parked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "pages").select("page_id", content.looks_parked(F.col("html")).alias("parked"), content.has_password_field(F.col("html")).alias("password"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events")
def jsonb_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").select("event_id", F.try_variant_get(F.parse_json("props"), "$.k", "int").alias("k"))


@query(f"SELECT min(event_id) AS event_id, 'user' || user_id || '.com' AS name FROM events WHERE ts >= TIMESTAMP '{EVENTS_AS_OF}' - INTERVAL 6 HOUR GROUP BY user_id")
def lookback_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    none = F.lit(None).cast("string")
    rows = read(spark, sf_dir, "events").select(F.col("event_id").alias("ord"), none.alias("issuer_name"), F.concat(F.lit("user"), F.col("user_id").cast("string"), F.lit(".com")).alias("common_name"), none.alias("name_value"), F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX").alias("entry_timestamp"), none.alias("not_before"))
    return lookups.search_sightings(rows, at(EVENTS_AS_OF), 6).select(F.col("ord").alias("event_id"), "name")


_SECONDS = f"greatest(0, epoch(TIMESTAMP '{EVENTS_AS_OF}') - floor(epoch(ts)))"
_UNIT = lambda size, unit: f"CAST(floor(s / {size}) AS BIGINT) || ' {unit}' || CASE WHEN floor(s / {size}) = 1 THEN '' ELSE 's' END || ' ago'"


@query(f"SELECT event_id, CASE WHEN s < 60 THEN 'just now' WHEN s < 3600 THEN {_UNIT(60, 'minute')} WHEN s < 86400 THEN {_UNIT(3600, 'hour')} WHEN s < 2592000 THEN {_UNIT(86400, 'day')} ELSE {_UNIT(2592000, 'month')} END AS ago FROM (SELECT event_id, {_SECONDS} AS s FROM events)")
def relative_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").select("event_id", views.relative_time(F.col("ts").cast("timestamp"), at(EVENTS_AS_OF)).alias("ago"))


@query(f"SELECT id, CASE WHEN publish_state = 'pending_review' THEN 'unconfirmed' WHEN o_totalprice > 300000 THEN 'high' WHEN o_totalprice > 150000 THEN 'medium' ELSE 'low' END AS status, publish_state = 'published' AND o_totalprice > 300000 AS confirmed FROM {CANDIDATES}")
def status_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    tier = F.when(F.col("o_totalprice") > 300_000, "high").when(F.col("o_totalprice") > 150_000, "medium").otherwise("low")
    return candidates_of_orders(spark, sf_dir).select("id", views.status_label(F.col("publish_state"), tier).alias("status"), ((F.col("publish_state") == "published") & (tier == "high")).alias("confirmed"))


@query("SELECT conv_id, turn, role IN ('user', 'assistant') AND length(trim(text)) BETWEEN 10 AND 4000 AS accepted FROM conversations")
def report_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", F.when(F.col("role").isin("user", "assistant"), "confirm").otherwise(F.col("role")).alias("kind"), F.col("text").alias("note"), F.lit(None).cast("string").alias("contact"))
    return state.checked_reports(rows).select("conv_id", "turn", "accepted")


@query("SELECT s_suppkey, trim(regexp_extract('C=US, O=' || s_name || ', CN=R3', 'O\\s*=\\s*\"?([^\",/]+)\"?', 1)) AS issuer FROM supplier".replace("\\\\", "\\"))
def issuer_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "supplier").select("s_suppkey", lookups.issuer_name(F.concat(F.lit("C=US, O="), "s_name", F.lit(", CN=R3"))).alias("issuer"))


@query("SELECT event_id, a[1] = 10 OR a[1] = 127 OR a[1] = 0 OR (a[1] = 172 AND a[2] BETWEEN 16 AND 31) OR (a[1] = 192 AND a[2] = 168) OR (a[1] = 100 AND a[2] BETWEEN 64 AND 127) OR (a[1] = 169 AND a[2] = 254) OR a[1] >= 224 AS private FROM (SELECT event_id, [event_id % 256, (event_id // 7) % 256] AS a FROM events)")
def private_address(spark: SparkSession, sf_dir: str) -> DataFrame:
    ip = F.concat((F.col("event_id") % 256).cast("string"), F.lit("."), (F.floor(F.col("event_id") / 7) % 256).cast("string"), F.lit(".1.1"))
    return read(spark, sf_dir, "events").select("event_id", domains.is_private_address(ip).alias("private"))


@query("SELECT publish_state, count(*) AS n FROM (SELECT *, CASE tier WHEN 'high' THEN 'published' WHEN 'medium' THEN 'pending_review' ELSE 'hidden' END AS publish_state FROM (SELECT *, " + TIER + " AS tier FROM " + SCORED + ")) GROUP BY publish_state")
def state_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored_lines(spark, sf_dir).groupBy(scoring.publish_state(F.col("tier"), F.lit("hidden")).alias("publish_state")).agg(F.count("*").alias("n"))
