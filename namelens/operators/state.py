"""Changes of state as new snapshots: insert, refresh, upsert, counters, schedule, review, prune.

Every function takes the old snapshot and a delta and returns rows; nothing is
written in place.  Times come in as ``as_of``.

Defined results: a null key is no key (it is inserted, and never met by another); keys of a
delta are expected once each where it says so; empty tables leave the other side as it is.
Columns of the input keep their values, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from namelens import constants as C
from namelens.operators import scoring
from namelens.operators.ranking import free


def insert_if_absent(state: DataFrame, delta: DataFrame, key: str) -> DataFrame:
    """Rows of delta whose key the state lacks; they are what is inserted."""
    return delta.join(state.select(key), key, "left_anti")


def upsert(state: DataFrame, delta: DataFrame, key: str) -> DataFrame:
    """The state after delta (a row a key at most): its rows replace or join the old ones; rows of it without a key join them too."""
    new_row = free(delta, "new_row")
    old, new = state.alias("o"), delta.withColumn(new_row, F.lit(True)).alias("n")
    has_new = F.col(f"n.{new_row}").isNotNull()
    columns = [F.when(has_new, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c) if c in delta.columns else F.col(f"o.{c}") for c in state.columns]
    return old.join(new, F.col(f"o.{key}") == F.col(f"n.{key}"), "full").select(*columns)


def accumulate(state: DataFrame, delta: DataFrame, key: str, counters: list[str]) -> DataFrame:
    """The state with the counters of delta added; its other columns stay, and are null for keys that only delta has."""
    names = {c: free(state, f"{c}_added") for c in counters}
    rows = state.join(delta.groupBy(key).agg(*[F.sum(c).alias(n) for c, n in names.items()]), key, "full")
    return rows.select(*[(F.coalesce(c, F.lit(0)) + F.coalesce(names[c], F.lit(0))).alias(c) if c in names else F.col(c) for c in state.columns])


def refresh_seen(candidates: DataFrame, sightings: DataFrame, as_of: Column, keep_known_issuer: bool = False, mark: str | None = None) -> DataFrame:
    """Candidates with the certificate of a new sighting (domain, issuer, logged_at; a row a domain at most).

    The issuer is overwritten even by null, unless ``keep_known_issuer`` is set.  mark: a column that says which were seen.
    """
    new = free(candidates, "seen_now")
    seen = sightings.select("domain", F.struct("issuer", "logged_at").alias(new))
    issuer = F.coalesce(F.col(new)["issuer"], "cert_issuer") if keep_known_issuer else F.col(new)["issuer"]
    now = lambda c, value: F.when(F.col(new).isNotNull(), value).otherwise(F.col(c))
    return candidates.join(seen, "domain", "left").withColumns({
        "last_seen_at": now("last_seen_at", as_of), "times_seen": now("times_seen", F.col("times_seen") + 1),
        "cert_issuer": now("cert_issuer", issuer), "cert_issued_at": now("cert_issued_at", F.col(new)["logged_at"]),
    }).select(*candidates.columns, *([F.col(new).isNotNull().alias(mark)] if mark else []))


def new_candidates(matches: DataFrame, sightings: DataFrame, as_of: Column) -> DataFrame:
    """Hidden candidates for matched domains, to be looked at in six minutes."""
    rows = matches.join(sightings.select("domain", F.col("issuer").alias("cert_issuer"), F.col("logged_at").alias("cert_issued_at")), "domain")
    return rows.select(
        F.sha2("domain", 256).alias("id"), "domain", "unicode_domain", F.col("brand_id").alias("matched_brand_id"), "matched_term", "match_kind", "edit_distance",
        "homoglyph_flag", "homoglyph_detail", "cert_issuer", "cert_issued_at", as_of.alias("first_seen_at"), as_of.alias("last_seen_at"), F.lit(1).alias("times_seen"),
        F.lit("new").alias("status"), F.lit("hidden").alias("publish_state"), F.lit(None).cast("timestamp").alias("reviewed_at"), F.lit(None).cast("string").alias("reviewed_note"),
        (as_of + F.make_dt_interval(mins=F.lit(C.RECHECK_HOURS["new"] * 6))).alias("next_recheck_at"), F.lit(0).alias("recheck_count"), as_of.alias("created_at"),
    )


def after_recheck(rows: DataFrame, as_of: Column, sticky_review: bool = False) -> DataFrame:
    """Scored candidates (tier, resolves, recheck_count, publish_state) with their next state and time.

    With ``sticky_review`` a reviewer's published or hidden state stays as well.
    """
    dead = F.when(F.coalesce("resolves", F.lit(False)), 0).otherwise(F.col("recheck_count") + 1)
    retired = (dead >= C.RETIRE_AFTER) & (F.col("tier") == "low")
    state = scoring.publish_state(F.col("tier"), F.col("publish_state"))
    if sticky_review:
        state = F.when(F.col("reviewed_at").isNotNull() & F.col("publish_state").isin("published", "hidden"), F.col("publish_state")).otherwise(state)
    hours = F.when(retired | ~F.coalesce("resolves", F.lit(False)), C.RECHECK_HOURS["dormant"]).when(F.col("tier") == "low", C.RECHECK_HOURS["quiet"]).otherwise(C.RECHECK_HOURS["active"])
    return rows.withColumns({
        "recheck_count": dead, "status": F.when(retired, "retired").otherwise("verified"), "publish_state": state,
        "next_recheck_at": as_of + F.make_dt_interval(hours=hours),
    })


def checked_decisions(decisions: DataFrame) -> DataFrame:
    """Decisions with ``accepted``: a known action, and to clear a candidate a reason of three characters or more."""
    good = F.col("action").isin("publish", "hide") | ((F.col("action") == "clear") & (F.length(F.trim("note")) >= C.REASON_LENGTH))
    return decisions.withColumn("accepted", F.coalesce(good, F.lit(False)))


def review(candidates: DataFrame, decisions: DataFrame, as_of: Column) -> tuple[DataFrame, DataFrame]:
    """(candidates after the decisions, allowlist rows of those that were cleared).

    decisions: id, action (publish, clear or hide), note, reviewer; a row an id at most.
    Those that ``checked_decisions`` refuses change nothing.
    """
    made = free(candidates, "decision")
    rows = candidates.join(checked_decisions(decisions).where("accepted").select("id", F.struct("action", "note", "reviewer").alias(made)), "id", "left")
    action, note = F.col(made)["action"], F.col(made)["note"]
    to = F.when(action == "publish", "published").when(action == "clear", "cleared").when(action == "hide", "hidden")
    after = rows.withColumns({
        "publish_state": F.coalesce(to, "publish_state"), "status": F.when(to == "cleared", "retired").otherwise(F.col("status")),
        "reviewed_at": F.when(to.isNotNull(), as_of).otherwise(F.col("reviewed_at")), "reviewed_note": F.when(to.isNotNull(), note).otherwise(F.col("reviewed_note")),
    })
    allowed = after.where(action == "clear").select("domain", F.col("matched_brand_id").alias("brand_id"), note.alias("reason"), F.col(made)["reviewer"].alias("added_by"), as_of.alias("added_at"))
    return after.select(*candidates.columns), allowed


def resolve_reports(reports: DataFrame, cleared: DataFrame, as_of: Column, resolution: str = "cleared") -> DataFrame:
    """Reports with the open ones of cleared candidates (id) resolved."""
    done = free(reports, "done")
    rows = reports.join(cleared.select(F.col("id").alias("candidate_id"), F.lit(True).alias(done)).distinct(), "candidate_id", "left")
    now = F.col(done) & (F.col("status") == "open")
    return rows.withColumns({
        "status": F.when(now, "resolved").otherwise(F.col("status")), "resolved_at": F.when(now, as_of).otherwise(F.col("resolved_at")),
        "resolution": F.when(now, F.lit(resolution)).otherwise(F.col("resolution")),
    }).select(*reports.columns)


def resolved_count(before: DataFrame, after: DataFrame) -> DataFrame:
    """One row: how many open reports of ``before`` ``after`` has resolved (both by id)."""
    was, now = before.where("status = 'open'").select("id"), after.where("status = 'resolved'").select("id")
    return was.join(now, "id", "left_semi").agg(F.count("*").alias("resolved"))


def prune(candidates: DataFrame, matches: DataFrame, as_of: Column, note: str = "no longer matches the watchlist") -> DataFrame:
    """Candidates with those hidden that are shown or pending and that no term matches any more."""
    match = free(candidates, "match")
    rows = candidates.join(matches.select("domain", F.lit(True).alias(match)).distinct(), "domain", "left")
    stale = F.col("publish_state").isin("published", "pending_review") & F.col(match).isNull()
    return rows.withColumns({
        "publish_state": F.when(stale, "hidden").otherwise(F.col("publish_state")), "reviewed_at": F.when(stale, as_of).otherwise(F.col("reviewed_at")),
        "reviewed_note": F.when(stale, F.lit(note)).otherwise(F.col("reviewed_note")),
    }).select(*candidates.columns)


def with_prefix(rows: DataFrame, column: str, prefix: str) -> DataFrame:
    """The rows whose column starts with the prefix, to the letter."""
    return rows.where(F.startswith(column, F.lit(prefix)))


def without_prefix(rows: DataFrame, column: str, prefix: str) -> DataFrame:
    """The rows that stay when those that start with the prefix are deleted; nulls stay."""
    return rows.where(~F.coalesce(F.startswith(column, F.lit(prefix)), F.lit(False)))


def checked_reports(reports: DataFrame) -> DataFrame:
    """Reports (kind, note, contact) with ``accepted``: a known kind, 10 to 4000 characters of note, 200 of contact at most."""
    note, contact = F.length(F.trim("note")), F.length(F.trim("contact"))
    good = F.col("kind").isin("dispute", "confirm", "other") & note.between(10, 4000) & (F.col("contact").isNull() | (contact <= 200))
    return reports.withColumn("accepted", F.coalesce(good, F.lit(False)))
