"""What is served: the feed, its items, statistics, reports by candidate, and what each role may see.

Defined results: candidates without a score or a verification stay in the feed, with nulls or the defaults of
``feed_items``; one without a brand isn't in it; of equal times the largest id is the latest; empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from namelens.operators import ranking

VISIBLE = ("published", "pending_review")


def current_scores(scores: DataFrame) -> DataFrame:
    return ranking.latest_per_key(scores, "candidate_id", "computed_at", "id")


def current_verifications(verifications: DataFrame) -> DataFrame:
    return ranking.latest_per_key(verifications, "candidate_id", "checked_at", "id")


def public_feed(candidates: DataFrame, brands: DataFrame, scores: DataFrame, verifications: DataFrame) -> DataFrame:
    """Visible candidates with their brand, latest score and latest verification."""
    c = candidates.where(F.col("publish_state").isin(*VISIBLE)).select(
        F.col("id"), "domain", "unicode_domain", "matched_brand_id", "matched_term", "match_kind", "homoglyph_flag", "cert_issuer", "cert_issued_at", "first_seen_at",
        "last_seen_at", "publish_state", *[c for c in ("edit_distance",) if c in candidates.columns],
    )
    b = brands.select(F.col("id").alias("matched_brand_id"), F.col("name").alias("brand_name"), F.col("slug").alias("brand_slug"), F.col("category").alias("brand_category"), F.try_element_at("official_domains", F.lit(1)).alias("official_domain"))
    s = current_scores(scores).select(F.col("candidate_id").alias("id"), "score", "tier", "contributing_signals", "computed_at")
    v = current_verifications(verifications).select(F.col("candidate_id").alias("id"), "resolves", "domain_age_days", "registrar", "page_title", "has_password_field", "looks_parked", "checked_at")
    return c.join(b, "matched_brand_id").join(s, "id", "left").join(v, "id", "left")


def status_label(publish_state: Column, tier: Column) -> Column:
    return F.when(publish_state == "pending_review", "unconfirmed").when(tier == "high", "high").when(tier == "medium", "medium").otherwise("low")


def feed_items(feed: DataFrame) -> DataFrame:
    """The feed with a nested brand, defaults for what is missing, and whether it is confirmed."""
    tier = F.coalesce("tier", F.lit("medium"))
    return feed.select(
        "id", "domain", "unicode_domain", F.struct(F.col("brand_name").alias("name"), F.col("brand_slug").alias("slug"), F.col("brand_category").alias("category"), F.col("official_domain").alias("official_domain")).alias("brand"),
        "match_kind", tier.alias("tier"), F.coalesce("score", F.lit(0)).alias("score"), F.coalesce("contributing_signals", F.array().cast(feed.schema["contributing_signals"].dataType)).alias("signals"),
        ((F.col("publish_state") == "published") & (tier == "high")).alias("confirmed"), status_label(F.col("publish_state"), tier).alias("status"), "resolves", "has_password_field", "first_seen_at",
    )


def split_signals(signals: Column) -> Column:
    """Signals that add points, that take some away, and how many count."""
    return F.struct(F.filter(signals, lambda s: s["points"] > 0).alias("positive"), F.filter(signals, lambda s: s["points"] < 0).alias("mitigating"), F.size(F.filter(signals, lambda s: s["points"] != 0)).alias("counted"))


def relative_time(at: Column, as_of: Column) -> Column:
    """How long ago a time was, in the largest whole unit; a time to come is 'just now', none is 'unknown'."""
    seconds = F.greatest(F.lit(0), F.unix_timestamp(as_of) - F.unix_timestamp(at))
    out = F.when(at.isNull(), "unknown").when(seconds < 60, "just now")
    for size, limit, unit in ((60, 3600, "minute"), (3600, 86_400, "hour"), (86_400, 30 * 86_400, "day"), (30 * 86_400, 365 * 86_400, "month")):
        n = F.floor(seconds / size)
        out = out.when(seconds < limit, F.concat(n, F.lit(f" {unit}"), F.when(n == 1, "").otherwise("s"), F.lit(" ago")))
    n = F.floor(seconds / (365 * 86_400))
    return out.otherwise(F.concat(n, F.lit(" year"), F.when(n == 1, "").otherwise("s"), F.lit(" ago")))


def stats(candidates: DataFrame, brands: DataFrame, as_of: Column) -> DataFrame:
    """One row of counts, from one pass over each table."""
    visible = F.col("publish_state").isin(*VISIBLE)
    since = lambda hours: visible & (F.col("first_seen_at") >= as_of - F.make_dt_interval(hours=F.lit(hours)))
    counts = candidates.agg(
        F.count_if(F.col("publish_state") == "published").alias("published"), F.count_if(F.col("publish_state") == "pending_review").alias("pending"),
        F.count_if(since(24)).alias("last_24h"), F.count_if(since(168)).alias("last_7d"),
    )
    return counts.join(brands.agg(F.count_if("active").alias("brands")), how="inner")


def with_reports(candidates: DataFrame, reports: DataFrame) -> DataFrame:
    """Candidates with their open reports, oldest first; disputed candidates come first."""
    open_ = reports.where("status = 'open' AND candidate_id IS NOT NULL")
    grouped = open_.groupBy(F.col("candidate_id").alias("id")).agg(F.array_sort(F.collect_list(F.struct("created_at", F.col("id").alias("report_id"), "kind", "note"))).alias("reports"))
    rows = candidates.join(grouped, "id", "left").withColumn("disputed", F.coalesce(F.exists("reports", lambda r: r["kind"] == "dispute"), F.lit(False)))
    return rows.orderBy(F.desc("disputed"), "id")


def report_rows(candidates: DataFrame, reports: DataFrame) -> DataFrame:
    """Candidates (id, ...) with disputed and one open report a row (report_id, created_at, kind, note), disputed candidates first, reports oldest first.

    The flat form of ``with_reports``: a candidate's reports are never gathered in one row, however many
    there are.  One without open reports has one row with nulls.
    """
    open_ = reports.where("status = 'open' AND candidate_id IS NOT NULL")
    flags = open_.groupBy(F.col("candidate_id").alias("id")).agg(F.max(F.coalesce(F.col("kind") == "dispute", F.lit(False))).alias("disputed"))
    told = open_.select(F.col("candidate_id").alias("id"), F.col("id").alias("report_id"), "created_at", "kind", "note")
    rows = candidates.join(flags, "id", "left").withColumn("disputed", F.coalesce("disputed", F.lit(False))).join(told, "id", "left")
    return rows.orderBy(F.desc("disputed"), "id", "created_at", "report_id")


def orphan_reports(reports: DataFrame) -> DataFrame:
    """Open reports that name no candidate, oldest first."""
    return reports.where("status = 'open' AND candidate_id IS NULL").orderBy("created_at", "id")


def visible_to(role: str, tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The tables as a role sees them: the service role all, anyone else visible candidates and what belongs to them."""
    if role == "service":
        return dict(tables)
    out = {name: df.where(F.lit(False)) for name, df in tables.items()}
    shown = tables["candidates"].where(F.col("publish_state").isin(*VISIBLE))
    out |= {"candidates": shown, "brands": tables["brands"]}
    for name in ("verifications", "risk_scores"):
        if name in tables:
            out[name] = tables[name].join(shown.select(F.col("id").alias("candidate_id")), "candidate_id", "left_semi")
    return out
