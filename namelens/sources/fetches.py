"""Recorded answers of web servers as what a check of a page would have found, with its guards, order of attempts and limits.

A target has at most one recorded attempt a scheme.  https is asked first; if that fails, http once.  No request is made to a
name that doesn't resolve or that resolves to a private address.  An attempt may take TIMEOUT_MS, less when the job's
deadline comes first; without time left none is made.  Only HTML is read, MOST_BYTES of it.

Defined results: a null or empty list of addresses doesn't resolve; no content type counts as HTML; bytes that aren't UTF-8
become replacement characters; an attempt that isn't recorded, or has neither a status nor an error, failed; of several records
of a target and scheme the earliest counts, then that with the smallest status; a null deadline is none; targets given twice give two rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from namelens.functions import content
from namelens.operators.ranking import free
from namelens.sources.lookups import may_fetch

FETCH = "id string, scheme string, at_ms bigint, took_ms bigint, status int, content_type string, final_url string, body binary, error string"
#: Milliseconds of an attempt, and bytes of a page that are read.
TIMEOUT_MS, MOST_BYTES = 6_000, 512 * 1024
NOT_RESOLVED, PRIVATE, OVER_BUDGET = "domain does not resolve; no request made", "resolves to a private address; refused", "skipped: job budget exhausted"
NO_ANSWER, TOO_SLOW = "no response over https or http", "timed out"


def readable(content_type: Column, body: Column, most: int = MOST_BYTES) -> Column:
    """The text of a body that is analysed: its first bytes if it is HTML, else an empty one."""
    html = content_type.isNull() | (content_type == "") | F.contains(content_type, F.lit("html"))
    return F.when(html, F.coalesce(F.make_valid_utf8(F.substring(body, 1, most).cast("string")), F.lit(""))).otherwise("")


def _attempts(fetches: DataFrame, most: int) -> DataFrame:
    """A row a target with its attempts over https and http; bodies are cut before they are shuffled."""
    rows = fetches.where(F.col("scheme").isin("https", "http")).select("id", "scheme", F.struct(
        "at_ms", "status", "took_ms", F.when(F.col("error").isNull() & F.col("status").isNull(), NO_ANSWER).otherwise(F.col("error")).alias("error"), "final_url",
        F.when(F.col("error").isNull(), readable(F.col("content_type"), F.col("body"), most)).alias("html"),
    ).alias("a"))
    order = F.struct(F.col("a.at_ms").isNull(), F.col("a.at_ms"), F.col("a.status"), F.col("a.error"), F.xxhash64("a.html"))
    of = lambda scheme: F.min_by("a", F.when(F.col("scheme") == scheme, order)).alias(scheme)
    return rows.groupBy("id").agg(of("https"), of("http"))


def checks(targets: DataFrame, fetches: DataFrame, most: int = MOST_BYTES) -> DataFrame:
    """Targets (id, domain, a_records, terms, deadline_ms) with ``content``: attempted, http_status, final_url, what the page shows, error.

    fetches: FETCH.  What was refused, skipped or got no answer shows nothing (and isn't parked); an answer that isn't HTML
    is an empty page.
    """
    held = free(targets, "held")
    tried = _attempts(fetches, most).select(F.col("id"), F.struct("https", "http").alias(held))
    rows = targets.join(tried, "id", "left")
    deadline = F.col("deadline_ms")

    def left(at: Column) -> Column:
        return F.when(deadline.isNull(), F.lit(TIMEOUT_MS)).otherwise(F.least(F.lit(TIMEOUT_MS), deadline - at))

    def seen(a: Column) -> Column:
        """skipped, or failed with an error, or neither: an answer."""
        room = F.coalesce(left(a["at_ms"]), F.lit(TIMEOUT_MS))
        slow = F.when(a["took_ms"] > room, TOO_SLOW)
        return F.struct((a.isNotNull() & (room <= 0)).alias("skipped"), F.when(a.isNull(), NO_ANSWER).otherwise(F.coalesce(slow, a["error"])).alias("error"))

    https, http = F.col(held)["https"], F.col(held)["http"]
    first, second = seen(https), seen(http)
    resolves = F.size(F.coalesce("a_records", F.array().cast("array<string>"))) > 0
    allowed = resolves & may_fetch(F.col("a_records"))
    by_https = allowed & ~first["skipped"] & first["error"].isNull()
    by_http = allowed & ~by_https & ~first["skipped"] & ~second["skipped"] & second["error"].isNull()
    error = F.when(~resolves, NOT_RESOLVED).when(~allowed, PRIVATE).when(by_https | by_http, F.lit(None)).when(first["skipped"] | second["skipped"], OVER_BUDGET).otherwise(second["error"])
    answer = F.when(by_https, https).when(by_http, http)
    url = lambda scheme: F.concat(F.lit(f"{scheme}://"), "domain", F.lit("/"))
    final = F.when(by_https, F.coalesce(F.nullif(https["final_url"], F.lit("")), url("https"))).when(by_http, F.coalesce(F.nullif(http["final_url"], F.lit("")), url("http")))

    found, page = free(targets, "found"), free(targets, "page")
    rows = rows.withColumn(found, F.struct(allowed.alias("attempted"), answer["status"].alias("http_status"), final.alias("final_url"), error.alias("error"), answer["html"].alias("html")))
    shown = content.analyse(F.col(found)["html"], F.col("domain"), F.coalesce("terms", F.array().cast("array<string>")))
    rows = rows.withColumn(page, shown)
    there = F.col(found)["http_status"].isNotNull()
    of = lambda name, default: F.when(there, F.col(page)[name]).otherwise(default).alias(name)
    return rows.select(*[F.col(f"`{c}`") for c in targets.columns if c != "content"], F.struct(
        *[F.col(found)[c].alias(c) for c in ("attempted", "http_status", "final_url")], of("page_title", F.lit(None)), of("has_password_field", F.lit(False)), of("brand_terms_on_page", F.array().cast("array<string>")),
        of("form_posts_offsite", F.lit(False)), of("looks_parked", F.lit(False)), of("content_risk_score", F.lit(0)), F.col(found)["error"].alias("error"),
    ).alias("content"))
