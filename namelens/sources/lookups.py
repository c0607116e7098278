"""Answers of lookup services as tables: certificate search rows, registrations, name servers.

Nothing here calls a network; the answers come in as JSON or rows, and are shaped
by built-in functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from namelens.functions import domains
from namelens.operators.ranking import free

SEARCH_ROW = "ord bigint, issuer_ca_id bigint, issuer_name string, common_name string, name_value string, id bigint, entry_timestamp string, not_before string, not_after string"
_ENTITY = "roles:array<string>,vcardArray:string,publicIds:array<struct<type:string,identifier:string>>"
#: Entities are read two levels deep; see ``registrars`` for any depth.
REGISTRATION = f"struct<events:array<struct<eventAction:string,eventDate:string>>,status:array<string>,entities:array<struct<{_ENTITY},entities:array<struct<{_ENTITY}>>>>>"
BOOTSTRAP = "struct<services:array<array<array<string>>>>"
#: Suffixes up to which the table of services is broadcast (about 100 bytes each).
BROADCAST_SERVICES = 100_000
#: Attempts and waits of a search client, milliseconds.
RETRIES, BACKOFF_MS = 3, 2000


def utc(value: Column) -> Column:
    """A timestamp; one without a zone is in UTC; null if it can't be read."""
    zoned = value.rlike(r"[zZ]|[+-][0-9]{2}:?[0-9]{2}$")
    return F.try_to_timestamp(F.when(zoned, value).otherwise(F.concat(value, F.lit("Z"))))


def issuer_name(issuer: Column) -> Column:
    """The organisation of a distinguished name, else its common name, else its first 200 characters."""
    part = lambda key: F.nullif(F.trim(F.regexp_extract(issuer, key + r'\s*=\s*"?([^",/]+)"?', 1)), F.lit(""))
    return F.when(F.length(issuer) > 0, F.coalesce(part("O"), part("CN"), F.substring(issuer, 1, 200)))


def search_sightings(rows: DataFrame, as_of: Column, lookback_hours: int) -> DataFrame:
    """Sightings of certificate search rows (SEARCH_ROW) that are not older than the lookback.

    A row without any time is kept.  Each name counts once, in order of rows, then of
    names: the common name first, then the alternative ones.
    """
    rows = rows.withColumns({"logged": utc(F.col("entry_timestamp")), "before": utc(F.col("not_before"))}).withColumn("at", F.coalesce("logged", "before"))
    rows = rows.where(F.col("at").isNull() | (F.col("at") >= as_of - F.make_dt_interval(hours=F.lit(lookback_hours))))
    names = F.array_compact(F.concat(F.array("common_name"), F.coalesce(F.split("name_value", r"\s*\n\s*"), F.array().cast("array<string>"))))
    every = rows.select("ord", "issuer_name", "before", "at", F.posexplode(names).alias("i", "raw")).withColumn("name", domains.normalize(F.col("raw"))).where("name <> ''")
    first = every.groupBy("name").agg(F.min(F.struct("ord", "i", "issuer_name", "before", "at")).alias("f"))
    return first.select("f.ord", "name", issuer_name(F.col("f.issuer_name")).alias("issuer"), F.col("f.before").alias("not_before"), F.col("f.at").alias("logged_at"), F.lit("search").alias("source"))


#: What is recorded of a search: its attempts in order from 1, with a status (null: no answer came), a body or an error.
ANSWER = "term string, attempt int, status int, body string, error string"
#: Bytes of an answer at most; attempts after an empty one; statuses that are worth another attempt.
MOST_BYTES, EMPTY_ATTEMPTS, RETRYABLE = 12_000_000, 2, (408, 425, 429, 500, 502, 503, 504)


def read_answers(spark: SparkSession, path: str) -> DataFrame:
    """Recorded answers, a JSON object a line."""
    return spark.read.schema(ANSWER).json(path)


def search_outcomes(answers: DataFrame) -> DataFrame:
    """A row a term: attempts made, the attempt whose answer counts (null: none), rows in it, and the error.

    An answer with rows counts at once.  An empty one is asked for again, up to EMPTY_ATTEMPTS attempts
    in all, then it counts.  An error is tried again up to RETRIES attempts if it may pass (no answer, a status of
    RETRYABLE, a body that isn't JSON); one of an answer over MOST_BYTES never does.  Bodies stay where they are: only what
    is known of them is grouped.
    """
    size, status = F.octet_length("body"), F.col("status")
    parsed = F.try_parse_json("body")
    rows = F.coalesce(F.when(F.schema_of_variant(parsed).startswith("ARRAY"), F.size(F.try_variant_get(parsed, "$", "array<variant>"))), F.lit(0))
    shown = F.regexp_replace(F.left("body", F.lit(40)), r"\s+", " ")
    error = (
        F.when(F.col("error").isNotNull(), F.col("error")).when(status.isNull() | (status < 200) | (status > 299), F.concat(F.lit("HTTP "), F.coalesce(status.cast("string"), F.lit("none"))))
        .when(size > MOST_BYTES, F.concat(F.lit("answer of "), F.round(size / 1e6).cast("long").cast("string"), F.lit(f" MB, over the {MOST_BYTES // 1_000_000} MB cap")))
        .when(parsed.isNull(), F.concat(F.lit("not JSON: "), F.coalesce(shown, F.lit(""))))
    )
    may_pass = F.col("error").isNotNull() | status.isNull() | status.isin(*RETRYABLE) | (status.between(200, 299) & (size <= MOST_BYTES))
    known = answers.where(F.col("attempt").between(1, RETRIES)).select("term", F.struct(F.col("attempt"), error.alias("error"), (error.isNotNull() & F.coalesce(may_pass, F.lit(True))).alias("may_pass"), F.when(error.isNull(), rows).alias("rows")).alias("a"))
    start = F.struct(F.lit(False).alias("over"), F.lit(0).alias("attempts"), F.lit(None).cast("int").alias("attempt"), F.lit(0).alias("rows"), F.lit(None).cast("string").alias("error"))

    def step(s, a):
        good = a["error"].isNull()
        counts = good & ((a["rows"] > 0) | (a["attempt"] >= EMPTY_ATTEMPTS))
        over = counts | (~good & (~a["may_pass"] | (a["attempt"] >= RETRIES)))
        after = F.struct(over.alias("over"), a["attempt"].alias("attempts"), F.when(counts, a["attempt"]).alias("attempt"), F.when(counts, a["rows"]).otherwise(0).alias("rows"), F.when(~counts, F.when(good, s["error"]).otherwise(a["error"])).alias("error"))
        return F.when(s["over"], s).otherwise(after)

    found = known.groupBy("term").agg(F.aggregate(F.array_sort(F.collect_list("a")), start, step).alias("s"))
    return found.select("term", "s.attempts", "s.attempt", "s.rows", F.when(F.col("s.error").isNotNull(), F.concat(F.lit('search for "'), "term", F.lit('" failed after '), F.col("s.attempts").cast("string"), F.lit(" attempt(s): "), "s.error")).alias("error"))


def answered_rows(answers: DataFrame, as_of: Column) -> DataFrame:
    """term and SEARCH_ROW of the answers that count, without certificates that have expired; an unknown end is none."""
    chosen = search_outcomes(answers).where("attempt IS NOT NULL AND rows > 0").select("term", "attempt")
    names = [c.split()[0] for c in SEARCH_ROW.split(", ") if not c.startswith("ord ")]
    body = F.from_json("body", f"array<struct<{', '.join(c.replace(' ', ':', 1) for c in SEARCH_ROW.split(', ') if not c.startswith('ord '))}>>")
    rows = answers.join(chosen, ["term", "attempt"]).select("term", F.posexplode(body).alias("i", "r")).select("term", F.col("i").cast("long").alias("ord"), *[F.col(f"r.{c}").alias(c) for c in names])
    return rows.where(F.coalesce(utc(F.col("not_after")) >= as_of, F.lit(True)))


def read_search_rows(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SEARCH_ROW).json(path)


def registration(json: Column, as_of: Column) -> Column:
    """Struct of created_at, age_days, statuses and registrar of a registration answer."""
    body = F.from_json(json, REGISTRATION)
    event = F.get(F.filter(body["events"], lambda e: e["eventAction"].isin("registration", "created")), F.lit(0))
    created = utc(event["eventDate"])
    age = F.greatest(F.lit(0), F.floor((F.unix_millis(as_of) - F.unix_millis(created)) / F.lit(86_400_000))).cast("int")

    def named(e: Column) -> Column:
        fields = F.from_json(F.get_json_object(e["vcardArray"], "$[1]"), "array<array<string>>")
        name = F.get(F.transform(F.filter(fields, lambda f: F.get(f, F.lit(0)) == "fn"), lambda f: F.get(f, F.lit(3))), F.lit(0))
        iana = F.get(F.filter(e["publicIds"], lambda p: F.contains(p["type"], F.lit("IANA"))), F.lit(0))["identifier"]
        return F.when(F.array_contains(e["roles"], "registrar"), F.coalesce(name, F.concat(F.lit("IANA registrar "), iana)))

    def first_of(entities: Column, deeper: bool) -> Column:
        found = F.transform(entities, lambda e: F.coalesce(named(e), first_of(e["entities"], False)) if deeper else named(e))
        return F.get(F.filter(found, lambda x: x.isNotNull()), F.lit(0))

    return F.struct(created.alias("created_at"), F.when(created.isNotNull(), age).alias("age_days"), F.coalesce(body["status"], F.array().cast("array<string>")).alias("statuses"), first_of(body["entities"], True).alias("registrar"))


def registrars(answers: DataFrame, key: str, json: str = "json") -> DataFrame:
    """key, registrar of registration answers, the entities walked to any depth.

    Each round goes one level down, for the answers that are that deep; an entity comes before those
    inside it, and these before the next one.  The registrar is the first with a name or an IANA number;
    answers without one, or that can't be read, give no row.  Keys are expected once each.
    """
    level = answers.select(F.col(key), F.try_parse_json(json).alias("v"), F.array().cast("array<int>").alias("path"))
    found, rounds = None, []
    while True:
        level = level.select(key, "path", F.posexplode(F.try_variant_get("v", "$.entities", "array<variant>")).alias("i", "e")).select(key, F.array_append("path", F.col("i")).alias("path"), F.col("e").alias("v")).persist()
        rounds.append(level)
        if level.isEmpty():
            break
        field = lambda f, i, kind: F.try_variant_get(f, f"$[{i}]", kind)
        names = F.filter(F.try_variant_get("v", "$.vcardArray[1]", "array<variant>"), lambda f: (field(f, 0, "string") == "fn") & (F.schema_of_variant(field(f, 3, "variant")) == "STRING"))  # noqa: B023
        numbers = F.filter(F.try_variant_get("v", "$.publicIds", "array<variant>"), lambda p: F.contains(F.try_variant_get(p, "$.type", "string"), F.lit("IANA")))
        name = F.coalesce(F.nullif(field(F.get(names, F.lit(0)), 3, "string"), F.lit("")), F.concat(F.lit("IANA registrar "), F.try_variant_get(F.get(numbers, F.lit(0)), "$.identifier", "string")))
        here = level.where(F.array_contains(F.try_variant_get("v", "$.roles", "array<string>"), "registrar")).select(key, "path", name.alias("registrar")).where("registrar IS NOT NULL")
        found = here if found is None else found.unionByName(here)
        level = level.select(key, "v", "path")
    if found is None:
        found = answers.select(key, F.array().cast("array<int>").alias("path"), F.lit("").alias("registrar")).limit(0)
    return found.groupBy(key).agg(F.min_by("registrar", "path").alias("registrar"))


def service_urls(bootstrap: DataFrame, column: str = "json") -> DataFrame:
    """tld, url of a bootstrap file: the first https address of a service, else its first; later services win."""
    rows = bootstrap.select(F.from_json(column, BOOTSTRAP).alias("b")).select(F.posexplode("b.services").alias("i", "s"))
    urls = F.get("s", F.lit(1))
    url = F.coalesce(F.get(F.filter(urls, lambda u: F.startswith(u, F.lit("https://"))), F.lit(0)), F.get(urls, F.lit(0)))
    rows = rows.select("i", url.alias("url"), F.explode(F.get("s", F.lit(0))).alias("tld")).where("url IS NOT NULL")
    return rows.groupBy(F.lower("tld").alias("tld")).agg(F.max_by("url", "i").alias("url"))


def with_service(names: DataFrame, services: DataFrame) -> DataFrame:
    """names (domain) with service_url: that of the full suffix, else of the last label."""
    suffix, tld, full_url, last_url = (free(names, c) for c in ("suffix", "tld", "full_url", "last_url"))
    rows = names.withColumn(suffix, domains.public_suffix(F.col("domain"))).withColumn(tld, F.substring_index(suffix, ".", -1))
    full = services.select(F.col("tld").alias(suffix), F.col("url").alias(full_url))
    last = services.select(F.col("tld").alias(tld), F.col("url").alias(last_url))
    small = F.broadcast if services.count() <= BROADCAST_SERVICES else lambda table: table
    return rows.join(small(full), suffix, "left").join(small(last), tld, "left").select(*[F.col(f"`{c}`") for c in names.columns], F.coalesce(full_url, last_url).alias("service_url"))


def name_servers(a: Column, aaaa: Column, mx: Column, ns: Column, a_code: Column, ns_code: Column) -> Column:
    """Struct of resolves, a_records, has_mx, ns_records and error of four lookups (null: no answer)."""
    none = F.array().cast("array<string>")
    addresses = F.concat(F.coalesce(a, none), F.coalesce(aaaa, none))
    servers = F.coalesce(ns, none)
    gone = F.coalesce((a_code == "ENOTFOUND") & (ns_code == "ENOTFOUND"), F.lit(False))
    unknown = ~gone & (F.size(addresses) == 0) & (F.size(servers) == 0)
    return F.struct((F.size(addresses) > 0).alias("resolves"), addresses.alias("a_records"), (F.size(F.coalesce(mx, none)) > 0).alias("has_mx"), servers.alias("ns_records"), F.when(unknown, F.coalesce(a_code, F.lit("lookup failed"))).alias("error"))


def may_fetch(a_records: Column) -> Column:
    """Whether a page may be fetched: there is an address, and none is private."""
    return (F.size(a_records) > 0) & ~F.exists(a_records, domains.is_private_address)


def verification_rows(bundles: DataFrame) -> DataFrame:
    """Flat verification rows of nested bundles (candidate_id, checked_at, dns, rdap, content)."""
    return bundles.select(
        F.sha2(F.concat_ws("|", "candidate_id", F.col("checked_at").cast("string")), 256).alias("id"), "candidate_id", "checked_at", "dns.resolves", "dns.a_records", "dns.has_mx", "dns.ns_records",
        "rdap.registrar", F.col("rdap.created_at").alias("domain_created_at"), F.col("rdap.age_days").alias("domain_age_days"), F.col("rdap.statuses").alias("rdap_status"),
        "content.page_title", "content.has_password_field", "content.brand_terms_on_page", "content.form_posts_offsite", "content.looks_parked", "content.content_risk_score",
        domains.first_address(F.col("dns.a_records")).alias("ip_address"), F.lit(None).cast("int").alias("asn_reputation_score"), F.coalesce("dns.error", "rdap.error").alias("error"),
    )
