"""From sightings to candidates, and from verifications to states: the two batch plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from namelens import constants as C
from namelens.functions import domains
from namelens.operators import matching, ranking, scoring, state


def earliest_sightings(sightings: DataFrame) -> DataFrame:
    """One sighting of each registrable domain: domain, ord, name, issuer, logged_at, source."""
    rows = sightings.withColumn("domain", domains.registrable_domain(F.col("name"))).where("domain IS NOT NULL")
    return ranking.earliest_in_batch(rows, ["domain"], "logged_at", "ord")


def allowlist_of(brands: DataFrame, allowlist: DataFrame) -> DataFrame:
    """Official domains and allowlisted ones, trimmed and in lower case."""
    own = brands.select(F.explode("official_domains").alias("domain"))
    return own.unionByName(allowlist.select("domain")).select(F.trim(F.lower("domain")).alias("domain")).distinct()


def matched_domains(first: DataFrame, brands: DataFrame, allowlist: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(the first sightings of matched domains, their best matches).

    Matching depends on the domain alone, so each distinct domain is matched once.
    """
    matches = matching.best_matches(first.select(F.col("domain").alias("name")), brands, allowlist_of(brands, allowlist))
    return first.join(matches.select("domain"), "domain", "left_semi"), matches


def matched(sightings: DataFrame, brands: DataFrame, allowlist: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(first sightings of matched domains, their best matches) of a batch."""
    return matched_domains(earliest_sightings(sightings), brands, allowlist)


def merged(seen: DataFrame, matches: DataFrame, candidates: DataFrame, as_of: Column) -> tuple[DataFrame, DataFrame]:
    """(known candidates refreshed, new hidden candidates) after the sightings of ``matched``."""
    fresh = state.insert_if_absent(candidates, matches, "domain")
    return state.refresh_seen(candidates, seen, as_of), state.new_candidates(fresh, seen, as_of)


def ingest(sightings: DataFrame, brands: DataFrame, allowlist: DataFrame, candidates: DataFrame, as_of: Column) -> tuple[DataFrame, DataFrame]:
    """(known candidates refreshed, new hidden candidates) after a batch of sightings.

    Replaying a batch inserts nothing.
    """
    return merged(*matched(sightings, brands, allowlist), candidates, as_of)


def counters(sightings: DataFrame, matches: DataFrame, candidates: DataFrame, allowlist: DataFrame) -> DataFrame:
    """One row: names seen, allowlisted (by the name as it came), domains matched, inserted and updated."""
    seen = sightings.agg(F.count("*").alias("seen"))
    skipped = sightings.join(allowlist.select(F.col("domain").alias("name")), "name", "left_semi").agg(F.count("*").alias("skipped_allowlisted"))
    known = matches.join(candidates.select("domain", F.lit(True).alias("known")), "domain", "left")
    found = known.agg(F.count("*").alias("matched"), F.count_if(F.col("known").isNull()).alias("inserted"), F.count_if("known").alias("updated"))
    return seen.join(skipped, how="inner").join(found, how="inner")


def with_brands(due: DataFrame, brands: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(candidates whose brand is known, an error row (id, domain, error) for each other one)."""
    known = brands.select(F.col("id").alias("matched_brand_id"))
    lost = due.join(known, "matched_brand_id", "left_anti").select("id", "domain", F.lit("brand not found").alias("error"))
    return due.join(known, "matched_brand_id", "left_semi").select(*due.columns), lost


def recheck(due: DataFrame, verifications: DataFrame, as_of: Column, brands: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(candidates after the check, rows for risk_scores).

    verifications: a row a candidate of this run.  brands: their names stand in the labels of signals.
    """
    checked = verifications.select(F.col("candidate_id").alias("id"), *([F.col("id").alias("verification_id")] if "id" in verifications.columns else [F.lit(None).cast("string").alias("verification_id")]), *[c for c in verifications.columns if c in scoring.INPUT or c in scoring.TOLD])
    rows = due.withColumn("mixed_script", F.col("homoglyph_detail.mixed_script")).join(checked, "id")
    if brands is not None:
        rows = rows.join(brands.select(F.col("id").alias("matched_brand_id"), F.col("name").alias("brand_name")), "matched_brand_id", "left")
    rows = scoring.scored(rows, notes=True)
    scores = rows.select(
        F.sha2(F.concat_ws("|", "id", as_of.cast("string")), 256).alias("id"), F.col("id").alias("candidate_id"), "verification_id", "score", "tier", F.col("signals").alias("contributing_signals"),
        F.lit(C.WEIGHTS_VERSION).alias("weights_version"), as_of.alias("computed_at"),
    )
    return state.after_recheck(rows, as_of).select(*due.columns), scores


def recheck_counters(before: DataFrame, after: DataFrame, errors: DataFrame | None = None) -> DataFrame:
    """One row: due, checked, published, queued for review, errors."""
    done = after.agg(F.count("*").alias("checked"), F.count_if(F.col("publish_state") == "published").alias("published"), F.count_if(F.col("publish_state") == "pending_review").alias("queued"))
    lost = errors.agg(F.count("*")).scalar() if errors is not None else F.lit(0).cast("long")
    return done.select(before.agg(F.count("*")).scalar().alias("due"), "*", lost.alias("errors"))
