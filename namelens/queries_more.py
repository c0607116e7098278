"""Further registered queries: sources, verification, content, state and jobs, each by a call of its operator."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from namelens import constants as C
from namelens.functions import content, domains, folding
from namelens.operators import matching, ranking, state
from namelens.plans import jobs, screening, sinks, views
from namelens.queries import _AGE, _KIND, _POINTS, AS_OF, CANDIDATES, GAP, NAMES, SCORED, at, candidates_of_orders, names_of, query, read, scored_lines, sql_list
from namelens.sources import certificates, logs, lookups, watchlist
from namelens.streaming.snapshots import shared_folder

# --- sources


def supplier_leaf() -> Column:
    """A supplier as a log leaf: its number is the time and stands in two names."""
    size = lambda x, width=2: F.lpad(F.hex(F.octet_length(F.unhex(x))), width, "0")
    item = lambda letter: F.hex(F.concat(F.lit(letter), F.col("s_suppkey").cast("string"), F.lit(".example.com")))
    names = F.concat(*[x for n in "hm" for x in (F.lit("82"), size(item(n)), item(n))])
    inner = F.concat(F.lit("30"), size(names), names)
    body = F.concat(F.lit("30820000551D1104"), size(inner), inner)
    leaf = F.concat(F.lit("0000"), F.lpad(F.hex(F.col("s_suppkey") + 1_700_000_000_000), 16, "0"), F.lit("0000"), size(body, 6), body)
    return F.base64(F.unhex(leaf))


@query("SELECT s_suppkey AS ord, 'h' || s_suppkey || '.example.com' AS name, CAST(1700000000000 + s_suppkey AS BIGINT) AS ms FROM supplier UNION ALL SELECT s_suppkey, 'm' || s_suppkey || '.example.com', 1700000000000 + s_suppkey FROM supplier")
def leaf_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every supplier is a log leaf whose certificate has two names."""
    entries = read(spark, sf_dir, "supplier").select(F.lit("log/").alias("log_url"), F.col("s_suppkey").alias("idx"), supplier_leaf().alias("leaf_input"))
    found = certificates.sightings(entries, lambda name: F.endswith(name, F.lit(".example.com")))
    return found.select("ord", "name", F.unix_millis("logged_at").alias("ms"))


@query("SELECT 'log' || s_suppkey % 3 AS log, s_suppkey // 3 AS idx, 'h' || s_suppkey || '.example.com' AS name FROM supplier WHERE s_suppkey % 3 <> 1 AND s_suppkey // 3 >= 5")
def recorded_log_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as the entries of three recorded logs; logs, indexes and names are chosen within the source."""
    top = shared_folder(spark, "logs")
    entries = read(spark, sf_dir, "supplier").select(F.concat(F.lit("log"), (F.col("s_suppkey") % 3).cast("string")).alias("log_url"), F.floor(F.col("s_suppkey") / 3).alias("idx"), supplier_leaf().alias("leaf_input"))
    logs.record(entries, top, 1000).write.format("noop").mode("overwrite").save()
    names = logs.recorded(spark, top).where("log_url IN ('log0', 'log2') AND idx >= 5 AND name LIKE 'h%' AND name LIKE '%.example.com'")
    return names.select(F.col("log_url").alias("log"), "idx", "name")


_AT = "CASE WHEN p_partkey > 0 AND p_partkey <= p_size * 100 THEN p_partkey ELSE greatest(0, p_size * 100 - 2000) END"


@query(f"SELECT p_partkey, CASE WHEN head - a > 300 THEN greatest(0, head - 300) ELSE a END AS first, CASE WHEN head - a > 300 THEN greatest(0, head - 300) - a ELSE 0 END AS skipped FROM (SELECT p_partkey, {_AT} AS a, p_size * 100 AS head FROM part)")
def log_start(spark: SparkSession, sf_dir: str) -> DataFrame:
    first, skipped = certificates.start_index(F.col("p_partkey"), F.col("p_size") * 100, 300)
    return read(spark, sf_dir, "part").select("p_partkey", first.alias("first"), skipped.alias("skipped"))


@query("SELECT 'https://' || lower(replace(n_name, ' ', '-')) || '/' AS url, n_name AS description, 'op' || n_regionkey AS operator FROM nation WHERE n_nationkey % 3 <> 0")
def log_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions are operators and nations their logs; every third log is retired, and some lack the final slash."""
    url = F.concat(F.lit("https://"), F.lower(F.replace("n_name", F.lit(" "), F.lit("-"))), F.when(F.col("n_nationkey") % 2 == 0, "/").otherwise(""))
    log = F.struct(url.alias("url"), F.col("n_name").alias("description"), F.create_map(F.when(F.col("n_nationkey") % 3 == 0, "retired").otherwise("usable"), F.lit("x")).alias("state"))
    operators = read(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.collect_list(log).alias("logs")).select(F.struct(F.concat(F.lit("op"), F.col("n_regionkey").cast("string")).alias("name"), "logs").alias("o"))
    body = operators.agg(F.to_json(F.struct(F.collect_list("o").alias("operators"))).alias("json"))
    return certificates.usable_logs(body).select("url", "description", "operator")


@query(f"SELECT min(page_id) AS ord, d AS name, arg_min(CASE WHEN page_id % 2 = 0 THEN 'Org ' || page_id ELSE 'Cn ' || page_id END, page_id) AS issuer FROM (SELECT page_id, unnest([name, 'www.' || name]) AS d FROM {NAMES} WHERE page_id % 9 <> 0) GROUP BY d")
def search_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page is a row of a certificate search; every ninth is too old."""
    org = F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("C=US, O=Org "), F.col("page_id").cast("string"), F.lit(", CN=x"))).otherwise(F.concat(F.lit("CN=Cn "), F.col("page_id").cast("string")))
    rows = names_of(spark, sf_dir).select(
        F.col("page_id").alias("ord"), org.alias("issuer_name"), F.upper("name").alias("common_name"), F.concat(F.lit("*."), "name", F.lit("\n www."), "name", F.lit(".")).alias("name_value"),
        F.when(F.col("page_id") % 9 == 0, "1999-12-01T00:00:00").otherwise("1999-12-31T23:30:00").alias("entry_timestamp"), F.lit(None).cast("string").alias("not_before"),
    )
    return lookups.search_sightings(rows, at(AS_OF), 24).select("ord", "name", "issuer")


@query(f"SELECT o_orderkey, CASE WHEN o_orderkey % 5 <> 0 THEN CAST(greatest(0, floor((epoch_ms(TIMESTAMP '{AS_OF}') - epoch_ms(CAST(o_orderdate AS TIMESTAMP))) / 86400000.0)) AS INTEGER) END AS age_days, CASE WHEN o_orderkey % 2 = 0 THEN 'Reg ' || o_custkey ELSE 'IANA registrar ' || o_custkey END AS registrar FROM orders")
def registrations(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = lambda x: F.col(x).cast("string")
    named = F.concat(F.lit('{"roles":["registrar"],"vcardArray":["vcard",[["version",{},"text","4.0"],["fn",{},"text","Reg '), text("o_custkey"), F.lit('"]]]}'))
    numbered = F.concat(F.lit('{"roles":["abuse"],"entities":[{"roles":["registrar"],"publicIds":[{"type":"IANA Registrar ID","identifier":"'), text("o_custkey"), F.lit('"}]}]}'))
    event = F.concat(F.lit('[{"eventAction":"expiration","eventDate":"2030-01-01T00:00:00Z"},{"eventAction":"'), F.when(F.col("o_orderkey") % 5 == 0, "transfer").otherwise("registration"), F.lit('","eventDate":"'), F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit('T00:00:00Z"}]'))
    body = F.concat(F.lit('{"events":'), event, F.lit(',"status":["active"],"entities":['), F.when(F.col("o_orderkey") % 2 == 0, named).otherwise(numbered), F.lit("]}"))
    found = lookups.registration(body, at(AS_OF))
    return read(spark, sf_dir, "orders").select("o_orderkey", found.alias("r")).select("o_orderkey", "r.age_days", "r.registrar")


@query(f"SELECT page_id, CASE WHEN ends_with(name, '.co.in') THEN 'https://co/' WHEN ends_with(name, '.com') THEN 'https://b/' END AS url FROM {NAMES}")
def service_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    boot = '{"services":[[["com"],["http://a/","https://b/"]],[["in"],["http://in/"]],[["co.in"],["https://co/"]]]}'
    services = lookups.service_urls(spark.createDataFrame([(boot,)], "json string"))
    names = names_of(spark, sf_dir).select("page_id", domains.registrable_domain(F.col("name")).alias("domain"))
    return lookups.with_service(names, services).select("page_id", F.col("service_url").alias("url"))


@query("""SELECT l_orderkey, l_linenumber, l_linestatus = 'O' AS resolves, l_returnflag = 'R' AS has_mx, CASE WHEN l_linestatus = 'O' OR l_quantity > 40 OR l_quantity < 20 THEN NULL ELSE 'ETIMEOUT' END AS error,
CASE WHEN l_linestatus = 'O' THEN CASE WHEN l_partkey % 2 = 0 THEN '10.0.0.1' ELSE '8.8.8.8' END END AS ip_address, l_linestatus = 'O' AND l_partkey % 2 <> 0 AS may_fetch FROM lineitem""")
def name_servers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as answers: an address if the line is open, mail servers if it was returned, name servers if it is small; large ones don't exist."""
    one = lambda cond, value: F.when(cond, F.array(value))
    up, gone = F.col("l_linestatus") == "O", F.when(F.col("l_quantity") > 40, "ENOTFOUND").otherwise("ETIMEOUT")
    dns = lookups.name_servers(one(up, F.when(F.col("l_partkey") % 2 == 0, "10.0.0.1").otherwise("8.8.8.8")), one(up, F.lit("2001:db8::1")), one(F.col("l_returnflag") == "R", F.lit("mx")), one(F.col("l_quantity") < 20, F.lit("ns")), gone, gone)
    empty = F.lit(None)
    rdap = F.struct(empty.cast("string").alias("registrar"), empty.cast("timestamp").alias("created_at"), empty.cast("int").alias("age_days"), empty.cast("array<string>").alias("statuses"), empty.cast("string").alias("error"))
    page = content.analyse(F.lit(""), F.lit("x.com"), domains.lits(["x"]))
    bundles = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.concat_ws("-", "l_orderkey", "l_linenumber").alias("candidate_id"), at(AS_OF).alias("checked_at"), dns.alias("dns"), rdap.alias("rdap"), page.alias("content"))
    rows = lookups.verification_rows(bundles)
    key = F.split("candidate_id", "-")
    # two addresses are public; the documentation range of IPv6 isn't private
    return rows.select(key[0].cast("long").alias("l_orderkey"), key[1].cast("int").alias("l_linenumber"), "resolves", "has_mx", "error", "ip_address", lookups.may_fetch(F.col("a_records")).alias("may_fetch"))


# --- names and terms


@query("SELECT s_suppkey, array_to_string(list_filter(['supplier' || lpad(CAST(s_suppkey AS VARCHAR), 9, '0'), 'shop' || s_suppkey, 's' || s_suppkey], lambda x: length(x) >= 3), ',') AS terms, array_to_string(['supplier' || lpad(CAST(s_suppkey AS VARCHAR), 9, '0'), 'extra' || s_suppkey], ',') AS polled FROM supplier")
def brand_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("s_suppkey").cast("string")
    name = F.concat(F.lit("Supplier #"), F.lpad(key, 9, "0"))
    derived = domains.match_terms(name, F.array(F.concat(F.lit("s"), key, F.lit(".co.in")), F.concat(F.lit("www.shop"), key, F.lit(".com."))), F.array(F.lit("x")))
    final = domains.final_terms(derived, F.array(F.concat(F.lit("EXTRA"), key)), F.array(F.concat(F.lit("shop"), key)))
    return read(spark, sf_dir, "supplier").select("s_suppkey", F.array_join(derived, ",").alias("terms"), F.array_join(domains.poll_terms(final), ",").alias("polled"))


@query("SELECT DISTINCT unnest(string_split(p_name, ' ')) AS term FROM part")
def scanner_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return watchlist.scanner_terms(read(spark, sf_dir, "part").select(domains.tokenize(F.col("p_name")).alias("match_terms")))


_KINDS = list(C.KIND_RANK)


@query(f"SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'homoglyph' WHEN p_partkey % 2 = 0 AND k = 'substring' THEN 'keyword_combo' ELSE k END AS kind, CASE WHEN p_partkey % 3 = 0 THEN 'а (U+0430) posing as \"a\"' ELSE '' END AS described FROM (SELECT p_partkey, ({sql_list(_KINDS)})[1 + p_partkey % 5] AS k FROM part)")
def match_upgrade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as matches: every third has a Cyrillic letter, every second a keyword."""
    label = F.when(F.col("p_partkey") % 3 == 0, F.lit("pаy1")).otherwise("pay1")
    words = F.when(F.col("p_partkey") % 2 == 0, domains.lits(["login"])).otherwise(F.array().cast("array<string>"))
    rows = read(spark, sf_dir, "part").select("p_partkey", F.get(domains.lits(_KINDS), (F.col("p_partkey") % 5).cast("int")).alias("k"), folding.fold(label).alias("fold"), words.alias("words"))
    return rows.select("p_partkey", matching.upgraded(F.col("k"), F.col("fold"), F.col("words")).alias("kind"), folding.described(F.col("fold")["substitutions"]).alias("described"))


@query("SELECT c_custkey, 'pay' || c_custkey || '.com' AS normal, c_custkey % 2 = 0 AS encoded, CASE WHEN c_custkey % 2 = 0 THEN 'päytm.com' END AS decoded FROM customer")
def name_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.concat(F.lit(" *.PAY"), F.col("c_custkey").cast("string"), F.lit(".Com. "))
    name = F.when(F.col("c_custkey") % 2 == 0, F.lit("xn--pytm-loa.com")).otherwise("paytm.com")
    return read(spark, sf_dir, "customer").select("c_custkey", domains.normalize(raw).alias("normal"), domains.is_punycode(name).alias("encoded"), folding.to_unicode(name).alias("decoded"))


# --- pages


_WORDS3 = "(c_custkey % 5 = 0)::INT"
_PASS, _BRAND, _OFF, _PARK = "(c_custkey % 3 = 0 OR c_custkey % 7 = 0)", "(c_custkey % 2 = 0)", "(c_custkey % 4 = 1)", "(c_custkey % 11 = 0)"


@query(f"""SELECT c_custkey, c_name || ' & co' AS page_title, {_PASS} AS has_password_field, CASE WHEN {_BRAND} THEN 'Acme' ELSE '' END AS brands, {_OFF} AS form_posts_offsite, {_PARK} AS looks_parked,
CAST(least(100, CASE WHEN {_PARK} THEN least(10, p) ELSE p END) AS INTEGER) AS content_risk_score FROM (SELECT *, CASE WHEN {_PASS} THEN 40 ELSE 0 END + CASE WHEN {_BRAND} THEN 25 ELSE 0 END + CASE WHEN {_PASS} AND {_BRAND} THEN 20 ELSE 0 END + CASE WHEN {_OFF} THEN 10 ELSE 0 END + 5 * {_WORDS3} AS p FROM customer)""")
def page_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as pages with a title, and by their number a password field, a brand, an offsite form, credential words or a parking mark."""
    when = lambda cond, text: F.when(cond, F.lit(text)).otherwise("")
    k = F.col("c_custkey")
    html = F.concat(
        F.lit("<html><TITLE class=a>\n "), "c_name", F.lit(" &amp;  co </title><form action='"), F.when(k % 4 == 1, "https://evil.example/x").when(k % 4 == 2, "https://www.shop.com/x").otherwise("/local"), F.lit("'>"),
        when(k % 3 == 0, '<input class=a type = "password">'), when(k % 7 == 0, "<input name='x-pwd'>"), F.lit("</form>"), when(k % 2 == 0, "<b>ACME</b>"), when(k % 5 == 0, "netbanking cvv mpin"), when(k % 11 == 0, "Coming Soon"), F.lit("y" * 2000),
    )
    found = content.analyse(html, F.lit("shop.com"), domains.lits(["Acme", "zz"]))
    # a small file would be one task, but each of its rows is a page of work
    customers = read(spark, sf_dir, "customer").select("c_custkey", "c_name").repartition(2 * spark.sparkContext.defaultParallelism, "c_custkey")
    return customers.select("c_custkey", found.alias("c")).select("c_custkey", "c.page_title", "c.has_password_field", F.array_join("c.brand_terms_on_page", ",").alias("brands"), "c.form_posts_offsite", "c.looks_parked", "c.content_risk_score")


@query("SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'IANA registrar ' || o_orderkey WHEN 1 THEN 'Late ' || o_orderkey ELSE 'Deep ' || o_orderkey END AS registrar FROM orders WHERE o_orderkey % 9 <> 8")
def registrar_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as registration answers whose registrar lies up to six levels deep, before another one at the top; every ninth can't be read."""
    k, depth = F.col("o_orderkey").cast("string"), (F.col("o_orderkey") % 7).cast("int")
    card = lambda word: F.concat(F.lit('"vcardArray":["vcard",[["version",{},"text","4.0"],["fn",{},"text","' + word + ' '), k, F.lit('"]]]'))
    deep = F.when(F.col("o_orderkey") % 4 == 0, F.concat(F.lit('"publicIds":[{"type":"IANA Registrar ID","identifier":"'), k, F.lit('"}]'))).when(F.col("o_orderkey") % 4 == 1, F.lit('"vcardArray":["vcard",[["fn",{},"text",7]]]')).otherwise(card("Deep"))
    inner = F.concat(F.repeat(F.lit('{"roles":["abuse"],"entities":[{"roles":["technical"]},'), depth), F.lit('{"roles":["registrar"],'), deep, F.lit("}"), F.repeat(F.lit("]}"), depth))
    body = F.concat(F.lit('{"entities":['), inner, F.lit(',{"roles":["registrar"],'), card("Late"), F.lit("}]}"))
    answers = read(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 9 == 8, F.left(body, F.length(body) - 1)).otherwise(body).alias("json"))
    return lookups.registrars(answers, "o_orderkey")


#: What a term's first, second and third attempt give, by its number: rows, empty, busy (may pass), gone (may not), page (no JSON), down (no answer).
_ATTEMPTS = [("rows",), ("empty", "rows"), ("empty", "empty", "rows"), ("busy", "rows"), ("busy", "busy", "busy"), ("gone", "rows"), ("page", "empty"), ("empty", "down", "busy"), ("down",)]
_OUTCOMES = {0: (1, 1, None), 1: (2, 2, None), 2: (2, 2, None), 3: (2, 2, None), 4: (3, None, "HTTP 503"), 5: (1, None, "HTTP 404"), 6: (2, 2, None), 7: (3, None, "HTTP 503"), 8: (1, None, "reset")}


@query(f"""SELECT c_name AS term, o.attempts, o.attempt, CASE WHEN o.attempt IS NULL OR c_custkey % 9 IN (2, 6) THEN 0 ELSE 2 END AS rows, 'search for "' || c_name || '" failed after ' || o.attempts || ' attempt(s): ' || o.error AS error,
CASE WHEN o.attempt IS NULL OR c_custkey % 9 IN (2, 6) THEN 0 WHEN c_custkey % 2 = 0 THEN 1 ELSE 2 END AS live FROM customer
JOIN (VALUES {', '.join(f"({k}, {n}, {a or 'CAST(NULL AS INTEGER)'}, {'NULL' if e is None else repr(e)})" for k, (n, a, e) in _OUTCOMES.items())}) AS o(k, attempts, attempt, error) ON o.k = c_custkey % 9""")
def search_attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as terms of a search with recorded attempts; of two certificates one has expired, for every second."""
    k = F.col("c_custkey")
    old = F.when(k % 2 == 0, "1999-01-01T00:00:00").otherwise("2030-01-01T00:00:00")
    body = {"rows": F.concat(F.lit('[{"id":1,"common_name":"a.com","not_after":"'), old, F.lit('"},{"id":2,"common_name":"b.com"}]')), "empty": F.lit("[]"), "page": F.lit("<html>  sorry")}
    status, error = {"rows": 200, "empty": 200, "page": 200, "busy": 503, "gone": 404}, {"down": "reset"}
    every = F.get(F.array(*[F.array(*[F.struct(F.lit(i).alias("attempt"), F.lit(status.get(a)).cast("int").alias("status"), (body.get(a) if a in body else F.lit(None).cast("string")).alias("body"), F.lit(error.get(a)).cast("string").alias("error")) for i, a in enumerate(of, 1)]) for of in _ATTEMPTS]), (k % 9).cast("int"))
    answers = read(spark, sf_dir, "customer").select(F.col("c_name").alias("term"), F.explode(every).alias("a")).select("term", "a.*")
    live = lookups.answered_rows(answers, at(AS_OF)).groupBy("term").agg(F.count("*").alias("live"))
    return lookups.search_outcomes(answers).join(live, "term", "left").select("term", "attempts", "attempt", "rows", "error", F.coalesce("live", F.lit(0)).alias("live"))


# --- scores, state and jobs

_SIGNALS = [e for v in _POINTS.values() for e in v]
_EVIDENCE = "array_to_string(list_filter([" + ", ".join(f"CASE WHEN p_{k} > 0 THEN '{k}' END" for k in _POINTS if k != "mitigating") + "], lambda x: x IS NOT NULL), ', ')"
_FEW = " || ".join(x for piece, value in zip(C.GATE_NOTES["few"].split("{}"), ("n_categories", "CASE WHEN n_categories = 1 THEN '' ELSE 's' END", _EVIDENCE, str(C.MIN_CATEGORIES), ""), strict=True) for x in (f"'{piece}'", value) if x)
_NOTE = f"CASE WHEN score >= 70 AND l_linestatus <> 'O' THEN '{C.GATE_NOTES['dead']}' WHEN score >= 70 AND n_categories < 2 THEN {_FEW} WHEN score >= 70 AND NOT (l_quantity > 25 OR kind = 'homoglyph') THEN '{C.GATE_NOTES['weak']}' END"


@query(f"SELECT l_orderkey, l_linenumber, CAST({' + '.join(f'(({e}) > 0)::INT' for e in _SIGNALS)} AS INTEGER) AS positive, CAST({' + '.join(f'(({e}) < 0)::INT' for e in _SIGNALS)} AS INTEGER) AS mitigating FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
def signal_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored_lines(spark, sf_dir).select("l_orderkey", "l_linenumber", views.split_signals(F.col("signals")).alias("s")).select("l_orderkey", "l_linenumber", F.size("s.positive").alias("positive"), F.size("s.mitigating").alias("mitigating"))


@query(f"SELECT l_orderkey, l_linenumber, {_NOTE} AS note, {_NOTE} AS label, CAST({_NOTE} IS NOT NULL AS INTEGER) AS notes FROM {SCORED}")
def gate_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The note of a gate, and the label of the signal that carries it."""
    rows = scored_lines(spark, sf_dir, notes=True).withColumn("said", F.filter("signals", lambda s: s["key"] == "gate.note"))
    return rows.select("l_orderkey", "l_linenumber", F.col("gate_note").alias("note"), F.get("said", F.lit(0))["label"].alias("label"), F.size("said").alias("notes"))


_DAYS = lambda n: f"{n} || ' day' || CASE WHEN {n} = 1 THEN '' ELSE 's' END"
_TEXTS = {
    "name": f"""CASE {_KIND} WHEN 'homoglyph' THEN 'Uses look-alike characters from another alphabet|e (U+0435) looks like "e"' WHEN 'exact_token' THEN 'Contains the exact brand name "' || l_partkey || '"|'
WHEN 'keyword_combo' THEN 'Contains the brand name "' || l_partkey || '"|' WHEN 'substring' THEN 'Contains "' || l_partkey || '" inside a longer word|'
ELSE CASE WHEN l_suppkey % 2 = 0 THEN '1 character change' ELSE '2 character changes' END || ' away from "' || l_partkey || '"|' END""".replace("e (U+0435)", "\u0435 (U+0435)"),
    "words": "CASE WHEN l_partkey % 3 = 0 THEN 'Combined with words used in credential-theft pages|login' END",
    "scripts": f"CASE WHEN l_suppkey % 7 = 0 AND {_KIND} <> 'homoglyph' THEN 'Mixes characters from more than one alphabet|Latin + Cyrillic' END",
    "live": "CASE WHEN l_linestatus = 'O' THEN 'The domain is live and resolves to a server|10.0.0.' || l_linenumber || ', 10.1.0.1, 10.2.0.1' END", "mail": "CASE WHEN l_returnflag = 'R' THEN 'Configured to send and receive email|' END",
    "age": f"CASE WHEN {_AGE} < 90 THEN 'Registered ' || {_DAYS(f'({_AGE})')} || ' ago|' WHEN {_AGE} > 365 THEN 'Registered over 1 year ago, which is unusual for phishing infrastructure|' END",
    "password": "CASE WHEN l_quantity > 25 THEN 'The page asks visitors for a password or PIN|' END", "brand": "CASE WHEN l_discount > 0.05 THEN 'The page uses the brand''s name (Brand ' || l_suppkey || ')|brand' END",
    "both": "CASE WHEN l_quantity > 25 AND l_discount > 0.05 THEN 'It both impersonates the brand and asks for credentials|' END", "offsite": "CASE WHEN l_tax > 0.06 THEN 'A form on the page sends what you type to a different website|' END",
    "parked": "CASE WHEN l_quantity < 5 THEN 'The page is parked or for sale rather than a working site|' END",
    "certificate": f"CASE WHEN {GAP} <= 0 THEN 'A TLS certificate was issued the same day the domain was registered|' WHEN {GAP} <= 3 THEN 'A TLS certificate was issued ' || {_DAYS(GAP)} || ' after registration|' END",
    "issuer": "CASE WHEN l_suppkey % 4 = 0 THEN 'The certificate came from a free, fully automated issuer|C=US, O=Let''s Encrypt' END",
}


@query(f"SELECT l_orderkey, l_linenumber, array_to_string(list_filter([{', '.join(_TEXTS.values())}], lambda x: x IS NOT NULL), chr(10)) AS told FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
def signal_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Label and detail of every signal, as lines."""
    rows = scored_lines(spark, sf_dir, told=True)
    return rows.select("l_orderkey", "l_linenumber", F.array_join(F.transform("signals", lambda s: F.concat(s["label"], F.lit("|"), F.coalesce(s["detail"], F.lit("")))), "\n").alias("told"))


@query("SELECT c_custkey AS id, coalesce(n, 0) + 1 AS times_seen, o IS NOT NULL AS seen, CASE WHEN o IS NOT NULL THEN CASE WHEN o % 2 = 0 THEN 'issuer' || o END ELSE 'old' END AS issuer FROM customer LEFT JOIN (SELECT o_custkey, min(o_orderkey) AS o, 1 AS n FROM orders GROUP BY 1) ON o_custkey = c_custkey")
def refresh_known(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as known candidates, the first order of each as a new sighting."""
    name = lambda c: F.concat(F.lit("d"), F.col(c).cast("string"))
    known = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), name("c_custkey").alias("domain"), at("1990-01-01 00:00:00").alias("last_seen_at"), F.lit(1).cast("long").alias("times_seen"), F.lit("old").alias("cert_issuer"), at("1990-01-01 00:00:00").alias("cert_issued_at"))
    first = read(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.min("o_orderkey").alias("o"))
    seen = first.select(name("o_custkey").alias("domain"), F.when(F.col("o") % 2 == 0, F.concat(F.lit("issuer"), F.col("o").cast("string"))).alias("issuer"), at(AS_OF).alias("logged_at"))
    return state.refresh_seen(known, seen, at(AS_OF)).select("id", "times_seen", (F.col("last_seen_at") == at(AS_OF)).alias("seen"), F.col("cert_issuer").alias("issuer"))


@query("SELECT c_custkey AS domain, 360 AS wait, 'hidden' AS publish_state, 1 AS times_seen FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)")
def first_look(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as matched domains, those with an order seen: new candidates, to be looked at in six minutes."""
    none = F.lit(None).cast("string")
    matches = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("domain"), none.alias("unicode_domain"), none.alias("brand_id"), none.alias("matched_term"), none.alias("match_kind"), F.lit(0).alias("edit_distance"), F.lit(False).alias("homoglyph_flag"), none.alias("homoglyph_detail"))
    seen = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("domain"), none.alias("issuer"), at(AS_OF).alias("logged_at")).distinct()
    new = state.new_candidates(matches.withColumn("domain", F.col("domain").cast("string")), seen.withColumn("domain", F.col("domain").cast("string")), at(AS_OF))
    return new.select(F.col("domain").cast("long").alias("domain"), (F.unix_timestamp("next_recheck_at") - F.unix_timestamp("created_at")).cast("int").alias("wait"), "publish_state", "times_seen")


def reports_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as reports on their order; those of small parts name no candidate."""
    kind = F.when(F.col("l_returnflag") == "R", "dispute").otherwise("confirm")
    return read(spark, sf_dir, "lineitem").select(
        ((F.col("l_orderkey") * 10 + F.col("l_linenumber")) * 1_000_000 + F.col("l_partkey")).alias("id"), F.when(F.col("l_partkey") % 50 != 0, F.col("l_orderkey")).alias("candidate_id"), kind.alias("kind"), F.lit("").alias("note"),
        F.when(F.col("l_linestatus") == "O", "open").otherwise("dismissed").alias("status"), F.col("l_shipdate").alias("created_at"), F.lit(None).cast("timestamp").alias("resolved_at"), F.lit(None).cast("string").alias("resolution"),
    )


@query("SELECT (l_orderkey * 10 + l_linenumber) * 1000000 + l_partkey AS id FROM lineitem WHERE l_linestatus = 'O' ORDER BY l_shipdate, id LIMIT 50")
def open_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.open_reports(reports_of(spark, sf_dir)).select("id")


@query("SELECT (l_orderkey * 10 + l_linenumber) * 1000000 + l_partkey AS id FROM lineitem WHERE l_linestatus = 'O' AND l_partkey % 50 = 0")
def orphan_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.orphan_reports(reports_of(spark, sf_dir)).select("id")


@query("SELECT (l_orderkey * 10 + l_linenumber) * 1000000 + l_partkey AS id, CASE WHEN l_linestatus = 'O' AND l_partkey % 50 <> 0 AND o_orderstatus = 'P' THEN 'resolved' WHEN l_linestatus = 'O' THEN 'open' ELSE 'dismissed' END AS status FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
def resolve_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleared = read(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("id"))
    return state.resolve_reports(reports_of(spark, sf_dir), cleared, at(AS_OF)).select("id", "status")


@query("SELECT count(*) AS resolved FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_linestatus = 'O' AND l_partkey % 50 <> 0 AND o_orderstatus = 'P'")
def resolved_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleared, before = read(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("id")), reports_of(spark, sf_dir)
    return state.resolved_count(before, state.resolve_reports(before, cleared, at(AS_OF)))


@query("SELECT n_name AS url, CAST(coalesce(s, 0) AS BIGINT) AS last_index FROM nation LEFT JOIN (SELECT s_nationkey, max(s_suppkey) AS s FROM supplier GROUP BY 1) ON s_nationkey = n_nationkey")
def log_cursors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as logs, their suppliers as cursors."""
    logs = read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("ord"), F.col("n_name").alias("url"), "n_nationkey")
    last = read(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.max("s_suppkey").cast("long").alias("last_index"), F.max("s_acctbal").alias("last_scanned_at"))
    cursors = logs.join(last, "n_nationkey").select("url", "last_index", "last_scanned_at")
    return jobs.with_cursors(logs.drop("n_nationkey"), cursors).select("url", "last_index")


@query("SELECT count(*) AS logs, count(*) FILTER (WHERE event_type = 'error') AS failures, CAST(sum(user_id) AS BIGINT) AS entries, CAST(sum(event_id % 7) AS BIGINT) AS names, round(CAST(sum(event_id % 7) AS DOUBLE) / sum(user_id) * 100, 4) AS hit_rate, count(*) FILTER (WHERE event_type = 'error') < count(*) AS ok FROM events")
def scan_outcome(spark: SparkSession, sf_dir: str) -> DataFrame:
    results = read(spark, sf_dir, "events").select(F.col("event_id").alias("log_url"), F.col("user_id").alias("entries"), (F.col("event_id") % 7).alias("names"), F.lit(0).alias("skipped"), F.when(F.col("event_type") == "error", "down").alias("error"))
    return jobs.scan_outcome(results).select("logs", "failures", F.col("entries").cast("long").alias("entries"), F.col("names").cast("long").alias("names"), "hit_rate", "ok")


@query(f"SELECT status, count(*) AS candidates, count(*) FILTER (WHERE first_seen_at <= TIMESTAMP '{AS_OF}') AS due FROM {CANDIDATES} GROUP BY status")
def due_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.due_share(candidates_of_orders(spark, sf_dir).withColumnRenamed("first_seen_at", "next_recheck_at"), at(AS_OF))


@query(f"SELECT count(*) AS due, count(*) FILTER (WHERE brand % 5 <> 0) AS checked, count(*) FILTER (WHERE brand % 5 <> 0 AND publish_state = 'published') AS published, count(*) FILTER (WHERE brand % 5 <> 0 AND publish_state = 'pending_review') AS queued, count(*) FILTER (WHERE brand % 5 = 0) AS errors FROM {CANDIDATES}")
def recheck_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as due candidates; the brand of every fifth customer is gone."""
    due = candidates_of_orders(spark, sf_dir).withColumns({"matched_brand_id": F.col("brand"), "domain": F.col("id").cast("string")})
    brands = read(spark, sf_dir, "orders").where("o_custkey % 5 <> 0").select(F.col("o_custkey").alias("id")).distinct()
    known, lost = screening.with_brands(due, brands)
    return screening.recheck_counters(due, known, lost)


@query("SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'publish' WHEN 1 THEN 'clear' WHEN 2 THEN 'hide' ELSE 'drop' END AS action, c_custkey % 4 IN (0, 2) OR (c_custkey % 4 = 1 AND length(trim(substr('  abcd', 1, 1 + c_custkey % 6))) >= 3) AS accepted FROM customer")
def checked_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    action = F.get(domains.lits(["publish", "clear", "hide", "drop"]), (F.col("c_custkey") % 4).cast("int"))
    note = F.substring(F.lit("  abcd"), F.lit(1), (F.col("c_custkey") % 6 + 1).cast("int"))
    return state.checked_decisions(read(spark, sf_dir, "customer").select("c_custkey", action.alias("action"), note.alias("note"))).select("c_custkey", "action", "accepted")


@query("SELECT p_partkey, p_name LIKE 'red%' AS held FROM part")
def prefix_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts by whether a deletion by prefix would take them."""
    parts = read(spark, sf_dir, "part").select("p_partkey", "p_name")
    return state.with_prefix(parts, "p_name", "red").select("p_partkey", F.lit(True).alias("held")).unionByName(state.without_prefix(parts, "p_name", "red").select("p_partkey", F.lit(False).alias("held")))


@query("SELECT strftime(time_bucket(INTERVAL 1 HOUR, ts), '%Y-%m-%d %H') AS hour, count(*) AS n FROM events GROUP BY 1")
def hourly_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from namelens.streaming import ingest

    rows = read(spark, sf_dir, "events").select(F.col("ts").cast("timestamp").alias("first_seen_at"))
    return ingest.counts_by_window(rows).select(F.date_format("window.start", "yyyy-MM-dd HH").alias("hour"), F.col("count").alias("n"))


@query("SELECT 'run' || o_orderkey % 3 AS run, count(*) AS n, CAST(sum(o_orderkey) AS BIGINT) AS keys FROM orders GROUP BY 1")
def rerun_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders appended by three runs, of which one has to be repeated after half of its rows."""
    folder, orders = shared_folder(spark, "sink"), read(spark, sf_dir, "orders").select("o_orderkey")
    for run, keep in ((0, 1), (1, 2), (2, 1), (1, 1)):
        sinks.append(orders.where((F.col("o_orderkey") % 3 == run) & (F.col("o_orderkey") % keep == 0)), folder, f"run{run}")
    return sinks.table(spark, folder, "o_orderkey long").groupBy("run").agg(F.count("*").alias("n"), F.sum("o_orderkey").alias("keys"))


@query("SELECT o_custkey % 7 AS job_number, count(*) AS n, count(*) FILTER (WHERE o_orderstatus = 'P') AS unfinished, count(*) FILTER (WHERE o_orderstatus = 'F') AS failed FROM orders GROUP BY 1")
def job_run_ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as runs: those with status P have a start row only."""
    start = F.col("o_orderdate").cast("timestamp")
    event = lambda kind, at_, ok: F.struct(F.lit(kind).alias("event"), at_.alias("at"), ok.alias("ok"))
    ends = F.when(F.col("o_orderstatus") != "P", event("end", start + F.make_dt_interval(hours=F.lit(1)), F.col("o_orderstatus") == "O"))
    events = read(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("run_id"), (F.col("o_custkey") % 7).cast("string").alias("job"), F.explode(F.array_compact(F.array(event("start", start, F.lit(None).cast("boolean")), ends))).alias("e"))
    runs = jobs.runs_of(events.select("run_id", "job", "e.*", F.lit(None).cast("string").alias("stats"), F.lit(None).cast("string").alias("error")))
    return runs.groupBy(F.col("job").cast("long").alias("job_number")).agg(F.count("*").alias("n"), F.count_if(F.col("finished_at").isNull()).alias("unfinished"), F.count_if(~F.col("ok")).alias("failed"))
