"""Continuous screening: each micro-batch of sightings is merged into the candidates.

The state is an incremental snapshot (``snapshots``) by domain: a batch reads and writes only
the buckets of the domains that it matches.  A batch that runs again after a failure
starts from the state before its own number and writes the same one, so replays change nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from namelens.plans import screening
from namelens.streaming.snapshots import BUCKETS, Snapshots

#: The setting with which Spark merges sessions before it shuffles them.
MERGE_LOCALLY = "spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition"

CANDIDATE = (
    "id string, domain string, unicode_domain string, matched_brand_id string, matched_term string, match_kind string, edit_distance int, homoglyph_flag boolean, "
    "homoglyph_detail struct<substitutions:array<struct<from:string,to:string,codepoint:string>>,mixed_script:boolean,scripts:array<string>>, cert_issuer string, "
    "cert_issued_at timestamp, first_seen_at timestamp, last_seen_at timestamp, times_seen int, status string, publish_state string, reviewed_at timestamp, "
    "reviewed_note string, next_recheck_at timestamp, recheck_count int, created_at timestamp"
)


def candidates_in(spark: SparkSession, folder: str, buckets: int = BUCKETS) -> Snapshots:
    """The snapshots of candidates in a folder."""
    return Snapshots(spark, folder, CANDIDATE, "domain", buckets)


def merge_batch(state: Snapshots, number: int, batch: DataFrame, brands: DataFrame, allowlist: DataFrame, now) -> set[int]:
    """Merge a batch of sightings as batch ``number`` of the state; the buckets that it wrote.

    The matches of the batch are held while it runs, since they say which buckets to read.
    """
    seen, matches = (df.persist() for df in screening.matched(batch, brands, allowlist))

    def merge(old: DataFrame) -> DataFrame:
        known, new = screening.merged(seen, matches, old, now)
        return known.unionByName(new)

    try:
        return state.apply(number, matches.select("domain"), merge)
    finally:
        matches.unpersist()
        seen.unpersist()


def start(sightings: DataFrame, brands: DataFrame, allowlist: DataFrame, folder: str, checkpoint: str, as_of: str | None = None, available_now: bool = True, buckets: int = BUCKETS) -> StreamingQuery:
    """Start a query that merges a stream of sightings (ord, name, issuer, not_before, logged_at, source).

    as_of: a fixed time, for tests; else each batch has the time at which it runs.
    """

    def merge(batch: DataFrame, number: int) -> None:
        now = F.to_timestamp(F.lit(as_of)) if as_of else F.current_timestamp()
        merge_batch(candidates_in(batch.sparkSession, folder, buckets), number, batch, brands, allowlist, now)

    writer = sightings.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def distinct_names(sightings: DataFrame, delay: str = "6 hours") -> DataFrame:
    """A stream of sightings without names that were seen within the delay, by their time in the log."""
    return sightings.withWatermark("logged_at", delay).dropDuplicatesWithinWatermark(["name"])


def _timed(rows: DataFrame, at: str, delay: str) -> DataFrame:
    """A stream waits for rows so long, and leaves out those that come later; a batch takes all."""
    return rows.withWatermark(at, delay) if rows.isStreaming else rows


def counts_by_window(candidates: DataFrame, width: str = "1 hour", delay: str = "6 hours", slide: str | None = None) -> DataFrame:
    """New candidates by window of their first sighting, for a batch or a stream; with ``slide`` windows overlap."""
    return _timed(candidates, "first_seen_at", delay).groupBy(F.window("first_seen_at", width, slide)).count()


def sessions(rows: DataFrame, key: str, at: str, gap: str = "30 minutes", delay: str = "6 hours") -> DataFrame:
    """key, started, last_at, n of each session: rows of a key that are less than a gap apart, for a batch or a stream.

    Rows without a time are left out; a null key is a key.  Spark merges the sessions of a task before the
    shuffle (MERGE_LOCALLY), so a hot key sends its sessions there and not its rows.
    """
    found = _timed(rows, at, delay).where(F.col(at).isNotNull()).groupBy(key, F.session_window(at, gap).alias("session")).agg(F.max(at).alias("last_at"), F.count("*").alias("n"))
    return found.select(key, F.col("session.start").alias("started"), "last_at", "n")
