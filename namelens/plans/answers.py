"""Answers of the endpoints as rows in their JSON's shape: a page of the feed, records of candidates, counts, the watchlist,
queues for review, outcomes of decisions, and whether a deployment is configured.  ``jobs.as_json`` writes them as text.

Defined results: a page past the end has no items but the total; an id that isn't public, isn't known or is null gives a row
with the error ``not_found`` and nothing else; ids asked for twice give two rows; empty tables give empty lists and zeros.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from namelens import constants as C
from namelens.operators import ranking, state
from namelens.plans import views

#: Rows of a candidate's history, and of a queue for review.
HISTORY, QUEUE = 20, 200
HISTORY_COLUMNS = {"checked_at": "timestamp", "resolves": "boolean", "http_status": "int", "has_password_field": "boolean", "looks_parked": "boolean", "domain_age_days": "int", "content_risk_score": "int"}
# --- fixed values: labels that clients of the feed know
LABELS = {"unconfirmed": "Unconfirmed - under review", "high": "High confidence", "medium": "Unconfirmed - under review", "low": "Low confidence"}
# ---
FEED_NOTICE = "Unconfirmed entries were found by an automatic scan and nobody has looked at them yet; a similar name proves nothing. Owners can dispute an entry."
RECORD_NOTICE = "What an automatic scan saw of this name, as evidence and not as a verdict. Owners can dispute it."


def camel(kind: T.DataType) -> T.DataType:
    """The type with the names of its fields in camelCase, at any depth."""
    if isinstance(kind, T.ArrayType):
        return T.ArrayType(camel(kind.elementType), kind.containsNull)
    if isinstance(kind, T.StructType):
        name = lambda text: text.split("_")[0] + "".join(part.title() for part in text.split("_")[1:])
        return T.StructType([T.StructField(name(f.name), camel(f.dataType), f.nullable) for f in kind.fields])
    return kind


def feed_item(feed: DataFrame) -> DataFrame:
    """id and item of rows of ``views.public_feed``, with defaults for what a candidate hasn't got yet."""
    tier = F.coalesce("tier", F.lit("medium"))
    label = views.status_label(F.col("publish_state"), tier)
    shown = F.coalesce(*[F.when(label == key, text) for key, text in LABELS.items()])
    distance = F.col("edit_distance") if "edit_distance" in feed.columns else F.lit(None).cast("int")
    rows = feed.select("id", F.struct(
        "id", "domain", "unicode_domain", F.struct(F.col("brand_name").alias("name"), F.col("brand_slug").alias("slug"), F.col("brand_category").alias("category"), "official_domain").alias("brand"),
        tier.alias("tier"), F.coalesce("score", F.lit(0)).alias("score"), ((F.col("publish_state") == "published") & (tier == "high")).alias("confirmed"), shown.alias("status_label"), "first_seen_at",
        F.col("checked_at").alias("last_checked_at"), "cert_issuer", "cert_issued_at", "resolves", "has_password_field", "domain_age_days", "registrar", "homoglyph_flag", distance.alias("edit_distance"),
        F.coalesce("contributing_signals", F.array().cast(feed.schema["contributing_signals"].dataType)).alias("signals"),
    ).alias("item"))
    return rows.withColumn("item", F.col("item").cast(camel(rows.schema["item"].dataType)))


def listed(candidates: DataFrame, brands: DataFrame, brand: str | None = None, category: str | None = None, tier: str | None = None) -> DataFrame:
    """The candidates of the feed, by a brand's slug, a category, or a tier (high: published, medium: pending); another tier is no condition."""
    wanted = brands
    for column, value in (("slug", brand), ("category", category)):
        wanted = wanted.where(F.col(column) == value) if value else wanted
    state_ = {"high": "published", "medium": "pending_review"}.get(tier or "")
    rows = candidates.where(F.col("publish_state").isin(*([state_] if state_ else views.VISIBLE)))
    return rows.join(wanted.select(F.col("id").alias("matched_brand_id")), "matched_brand_id", "left_semi")


def _ordered(rows: DataFrame, value: str, *order: Column) -> Column:
    """Aggregate: a column's values as a list in the order of ``order``."""
    keys = [c.alias(f"k{i}") for i, c in enumerate(order)]
    return F.transform(F.array_sort(F.collect_list(F.struct(*keys, F.col("id").alias("id"), F.col(value).alias("value")))), lambda x: x["value"]).alias("items")


def feed_page(candidates: DataFrame, brands: DataFrame, scores: DataFrame, verifications: DataFrame, brand: str | None = None, category: str | None = None, tier: str | None = None, limit: float = C.PAGE_SIZE, offset: float = 0) -> DataFrame:
    """One row: items (newest first, then by id), total, limit, offset, disclaimer.

    The page is a top-k of the candidates alone.  Its ids, MAX_PAGE_SIZE at most, are broadcast to scores and
    verifications, so that only rows of the page are ranked; the total needs neither table.
    """
    limit, offset = ranking.clamp(limit, 1, C.MAX_PAGE_SIZE), ranking.clamp(offset, 0, C.MAX_OFFSET)
    shown = listed(candidates, brands, brand, category, tier)
    page = ranking.page(shown, [F.desc_nulls_first("first_seen_at"), F.asc("id")], offset, limit)
    of_page = F.broadcast(page.select(F.col("id").alias("candidate_id")))
    feed = views.public_feed(page, brands, scores.join(of_page, "candidate_id", "left_semi"), verifications.join(of_page, "candidate_id", "left_semi"))
    items = feed_item(feed).select("id", "item", F.col("item.firstSeenAt").alias("seen"))
    found = items.agg(_ordered(items, "item", F.col("seen").isNotNull(), -F.unix_micros("seen")))
    total = shown.agg(F.count("*")).scalar()
    return found.select("items", total.alias("total"), F.lit(limit).alias("limit"), F.lit(offset).alias("offset"), F.lit(FEED_NOTICE).alias("disclaimer"))


def candidate_records(ids: DataFrame, candidates: DataFrame, brands: DataFrame, scores: DataFrame, verifications: DataFrame) -> DataFrame:
    """A row for each of ``ids`` (id): id, error, item, history (the latest checks, HISTORY at most, newest first), disclaimer.

    Only asked for and public candidates are ranked.  Lists hold HISTORY rows at most, kept before the shuffle.
    """
    asked = ids.select("id").distinct()
    feed = views.public_feed(candidates.join(asked, "id", "left_semi"), brands, scores.join(asked.withColumnRenamed("id", "candidate_id"), "candidate_id", "left_semi"), verifications.join(asked.withColumnRenamed("id", "candidate_id"), "candidate_id", "left_semi"))
    checks = verifications.join(asked.withColumnRenamed("id", "candidate_id"), "candidate_id", "left_semi")
    latest = ranking.history(checks, "candidate_id", "checked_at", "id", HISTORY)
    row = F.struct(*[(F.col(c) if c in checks.columns else F.lit(None).cast(kind)).alias(c) for c, kind in HISTORY_COLUMNS.items()])
    newest = F.sort_array(F.collect_list(F.struct("checked_at", "id", row.alias("row"))), asc=False)
    history = latest.groupBy("candidate_id").agg(F.transform(newest, lambda x: x["row"]).alias("history"))
    found = feed_item(feed).join(history.withColumnRenamed("candidate_id", "id"), "id", "left")
    rows = ids.select("id").join(found, "id", "left")
    known = F.col("item").isNotNull()
    none = F.array().cast(history.schema["history"].dataType)
    return rows.select("id", F.when(~known, "not_found").alias("error"), "item", F.when(known, F.coalesce("history", none)).alias("history"), F.when(known, RECORD_NOTICE).alias("disclaimer"))


def stats(candidates: DataFrame, brands: DataFrame, as_of: Column) -> DataFrame:
    """One row of the public counts; only candidates of the feed are counted."""
    names = {"published": "highConfidence", "pending": "underReview", "last_24h": "seenLast24h", "last_7d": "seenLast7d", "brands": "brandsWatched"}
    return views.stats(listed(candidates, brands), brands, as_of).select(*[F.col(c).alias(name) for c, name in names.items()])


def watchlist(brands: DataFrame) -> DataFrame:
    """The active brands as published, by category and name."""
    return ranking.brand_listing(brands).select("name", "slug", "category", "official_domains", "aliases", "active")


def review_queue(candidates: DataFrame, brands: DataFrame, scores: DataFrame, verifications: DataFrame, n: int = QUEUE) -> DataFrame:
    """One row: queue, count, items of what waits for a person, by falling score, those without one first."""
    feed = views.public_feed(candidates.where("publish_state = 'pending_review'"), brands, scores, verifications)
    waiting = ranking.review_queue(feed, n)
    items = waiting.select("id", "score", F.struct(*[F.col(c) for c in waiting.columns]).alias("item"))
    return items.agg(_ordered(items, "item", F.col("score").isNotNull(), -F.col("score"))).select(F.lit("candidates").alias("queue"), F.size("items").alias("count"), "items")


def report_queue(reports: DataFrame, n: int = QUEUE) -> DataFrame:
    """One row: queue, count, items of the open reports, oldest first."""
    waiting = ranking.open_reports(reports, n)
    names = [c for c in ("id", "candidate_id", "domain", "kind", "note", "contact", "created_at") if c in waiting.columns]
    items = waiting.select("id", "created_at", F.struct(*names).alias("item"))
    return items.agg(_ordered(items, "item", F.col("created_at").isNotNull(), F.col("created_at"))).select(F.lit("reports").alias("queue"), F.size("items").alias("count"), "items")


def decision_outcomes(candidates: DataFrame, reports: DataFrame, decisions: DataFrame) -> DataFrame:
    """What each decision (id, action, note, ...; see ``state.review``) comes to: id, ok, error, domain, publish_state, allowlisted, resolved_reports.

    An error leaves the other columns null.  Open reports are counted before they are joined.
    """
    to = {"publish": "published", "clear": "cleared", "hide": "hidden"}
    place = F.lit(True).alias("known")
    rows = state.checked_decisions(decisions).join(candidates.select("id", "domain", place), "id", "left")
    cleared = rows.where("accepted AND known AND action = 'clear'").select(F.col("id").alias("candidate_id")).distinct()
    n = reports.where("status = 'open'").join(cleared, "candidate_id", "left_semi").groupBy(F.col("candidate_id").alias("id")).agg(F.count("*").alias("n"))
    error = (
        F.when(F.col("id").isNull() | F.col("action").isNull() | (F.col("action") == ""), "id and action are required").when(~F.col("action").isin(*to), f"action must be one of: {', '.join(to)}")
        .when(F.col("known").isNull(), "candidate not found").when(~F.col("accepted"), "a reason is required to clear")
    )
    good, clear = error.isNull(), F.col("action") == "clear"
    return rows.join(n, "id", "left").select(
        "id", good.alias("ok"), error.alias("error"), F.when(good, F.col("domain")).alias("domain"), F.when(good, F.coalesce(*[F.when(F.col("action") == a, s) for a, s in to.items()])).alias("publish_state"),
        F.when(good, clear).alias("allowlisted"), F.when(good, F.when(clear, F.coalesce("n", F.lit(0))).otherwise(0)).alias("resolved_reports"),
    )


def health(spark: SparkSession, settings: dict[str, bool], brands: Callable[[], DataFrame], as_of: Column) -> DataFrame:
    """One row: ok, missing, database, hint, checkedAt.  settings: which ones are set; brands: reads the watchlist, which is counted here.

    Without all settings the watchlist isn't read.  No value of a setting is told, only whether there is one.
    """
    missing, reachable, n, error = [name for name, there in settings.items() if not there], None, None, None
    if not missing:
        try:
            n, reachable = brands().count(), True
        except Exception as e:  # noqa: BLE001  what can't be read is the answer
            reachable, error = False, type(e).__name__
    if missing:
        hint = f"Not configured; not set: {', '.join(missing)}."
    elif not reachable:
        hint = "Configured, but the watchlist can't be read."
    else:
        hint = "Configured, and the watchlist can be read." if n else "Configured, but the watchlist is empty."
    row = spark.createDataFrame([(not missing and bool(reachable), missing, (not missing, reachable, n, error), hint)], "ok boolean, missing array<string>, database struct<checked:boolean,reachable:boolean,brandsSeeded:bigint,error:string>, hint string")
    return row.withColumn("checkedAt", as_of)
