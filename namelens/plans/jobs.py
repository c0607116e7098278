"""Runs of jobs: a row when one starts and one when it ends, counters without another pass, and what a run over several logs amounts to."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from namelens import constants as C
from namelens.operators import state
from namelens.operators.ranking import free
from namelens.plans import screening

JOB_EVENT = "run_id string, job string, event string, at timestamp, ok boolean, stats string, error string"


class Runs:
    """A table of the starts and ends of runs; nothing in it is changed later.

    Each has a folder of its own, so that runs can be written at the same time.
    """

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path

    def _add(self, run_id: str, job: str, event: str, *row: object) -> None:
        rows = self.spark.createDataFrame([(run_id, job, event, *row)], JOB_EVENT).drop("run_id", "event")
        rows.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/run_id={run_id}/event={event}")

    def started(self, job: str, run_id: str | None = None) -> str:
        run_id = run_id or uuid.uuid4().hex
        self._add(run_id, job, "start", datetime.now(timezone.utc), None, None, None)
        return run_id

    def ended(self, job: str, run_id: str, stats: dict | None, error: str | None) -> None:
        self._add(run_id, job, "end", datetime.now(timezone.utc), error is None, None if stats is None else json.dumps(stats, default=str), error)

    def table(self) -> DataFrame:
        """run_id, job, started_at, finished_at, ok, stats, error: a row a run; one that was killed has no end."""
        return runs_of(self.spark.read.schema(JOB_EVENT).parquet(self.path))


def runs_of(events: DataFrame) -> DataFrame:
    """A row a run of JOB_EVENT rows."""
    end = lambda c: F.max_by(c, F.when(F.col("event") == "end", F.col("at"))).alias(c)
    return events.groupBy("run_id").agg(F.min("job").alias("job"), F.min(F.when(F.col("event") == "start", F.col("at"))).alias("started_at"), F.max(F.when(F.col("event") == "end", F.col("at"))).alias("finished_at"), end("ok"), end("stats"), end("error"))


def run_job(spark: SparkSession, job: str, work: Callable[[], dict], runs_path: str) -> dict:
    """Run ``work`` between its two rows; an error is recorded, not raised."""
    runs, stats, error = Runs(spark, runs_path), None, None
    run_id = runs.started(job)
    try:
        stats = work()
    except Exception as e:  # noqa: BLE001
        error = f"{type(e).__name__}: {e}"
    runs.ended(job, run_id, stats, error)
    return {"ok": error is None, "stats": stats, "error": error}


class RunListener(StreamingQueryListener):
    """Writes the start row and the end row of every run of named stream queries.

    The end row's stats are the sums of what the triggers read and of the queries' own observed counters
    (``DataFrame.observe``), so that counting needs no pass of its own.
    """

    def __init__(self, runs: Runs, names: set[str] | None = None) -> None:
        self.runs, self.names, self.held = runs, names, {}

    def onQueryStarted(self, event) -> None:  # noqa: ANN001, N802
        if self.names is None or event.name in self.names:
            self.held[str(event.runId)] = (event.name or str(event.id), {"triggers": 0, "rows": 0})
            self.runs.started(event.name or str(event.id), str(event.runId))

    def onQueryProgress(self, event) -> None:  # noqa: ANN001, N802
        p = event.progress
        if str(p.runId) in self.held:
            stats = self.held[str(p.runId)][1]
            stats["triggers"] += 1
            stats["rows"] += p.numInputRows
            for name, row in p.observedMetrics.items():
                for counter, n in row.asDict().items():
                    key = f"{name}.{counter}"
                    stats[key] = stats.get(key, 0) + (n or 0)

    def onQueryIdle(self, event) -> None:  # noqa: ANN001, N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: ANN001, N802
        if held := self.held.pop(str(event.runId), None):
            self.runs.ended(held[0], str(event.runId), held[1], event.exception)


class Counted:
    """An ingest whose counters come from the pass that does the work; see ``counted_ingest``."""

    def __init__(self, rows: DataFrame, seen: Observation, found: Observation, held: DataFrame) -> None:
        self.rows, self._seen, self._found, self._held = rows, seen, found, held

    def counters(self) -> dict[str, int]:
        """What screening.counters gives, once the rows have been written or read; waits for that."""
        found = self._found.get
        self._held.unpersist()
        return self._seen.get | {"matched": found["inserted"] + found["updated"]} | found


def counted_ingest(sightings: DataFrame, brands: DataFrame, allowlist: DataFrame, candidates: DataFrame, as_of: Column) -> Counted:
    """screening.ingest with its counters observed on the way: the sightings are scanned once.

    The first sighting of each domain is held (in memory or on disk) while the run lasts, as several steps use it.
    """
    seen, found = Observation(), Observation()
    allowed, place = free(sightings, "allowed"), free(candidates, "place")
    listed = allowlist.select(F.col("domain").alias("name"), F.lit(True).alias(allowed)).distinct()
    rows = sightings.join(listed, "name", "left").observe(seen, F.count("*").alias("seen"), F.count_if(F.coalesce(allowed, F.lit(False))).alias("skipped_allowlisted")).drop(allowed)
    first = screening.earliest_sightings(rows).persist()
    matched, matches = screening.matched_domains(first, brands, allowlist)
    known = state.refresh_seen(candidates, matched, as_of, mark=place)
    new = state.new_candidates(state.insert_if_absent(candidates, matches, "domain"), matched, as_of).withColumn(place, F.lit("inserted"))
    out = known.withColumn(place, F.when(F.col(place), "updated")).unionByName(new)
    out = out.observe(found, F.count_if(F.col(place) == "inserted").alias("inserted"), F.count_if(F.col(place) == "updated").alias("updated"))
    return Counted(out.drop(place), seen, found, first)


def scan_outcome(results: DataFrame) -> DataFrame:
    """One row for a scan of several logs (log_url, entries, names, skipped, error): it failed only if all logs did."""
    failed = F.count_if(F.col("error").isNotNull())
    return results.agg(
        F.count("*").alias("logs"), failed.alias("failures"), F.coalesce(F.sum("entries"), F.lit(0)).alias("entries"), F.coalesce(F.sum("names"), F.lit(0)).alias("names"),
        F.coalesce(F.sum("skipped"), F.lit(0)).alias("skipped"), hit_rate(F.sum("names"), F.sum("entries")).alias("hit_rate"),
        ((F.count("*") == 0) | (failed < F.count("*"))).alias("ok"),
    )


def hit_rate(found: Column, read: Column) -> Column:
    """Found of a hundred read, to four decimals; null if nothing was read."""
    return F.round(F.try_divide(found.cast("double"), read) * 100, 4)


def source_health(answers: DataFrame, source: str, term: str, rows: str) -> DataFrame:
    """By source: terms queried, those with rows, the ones without any (in order), whether the source is degraded, and the rate.

    answers has a row a query; a source is degraded if it was queried and no term had rows.
    """
    hits = F.count_if(F.col(rows) > 0)
    empty = F.array_sort(F.collect_set(F.when(F.col(rows) > 0, None).otherwise(F.col(term))))
    return answers.groupBy(source).agg(F.count("*").alias("queried"), hits.alias("with_rows"), (hits == 0).alias("degraded"), hit_rate(hits, F.count("*")).alias("hit_rate"), empty.alias("empty_terms"))


def with_cursors(logs: DataFrame, cursors: DataFrame) -> DataFrame:
    """Logs (url, ...) with last_index (0 for new ones), those that were scanned longest ago first."""
    rows = logs.join(cursors.select("url", "last_index", "last_scanned_at"), "url", "left").withColumn("last_index", F.coalesce("last_index", F.lit(0)))
    return rows.orderBy(F.asc_nulls_first("last_scanned_at"), "ord")


def as_json(rows: DataFrame) -> DataFrame:
    """Each row as one JSON line, as an endpoint would return it: what is null says so."""
    return rows.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("json"))


def category_ceilings() -> dict[str, int]:
    """The most points that signals of a category can give together."""
    w = C.WEIGHTS
    return {
        "name": w["name.homoglyphNonAscii"] + w["name.phishingKeyword"] + w["name.mixedScript"], "infrastructure": w["infrastructure.resolves"] + w["infrastructure.hasMx"],
        "registration": w["registration.ageUnder3Days"], "content": sum(w[f"content.{k}"] for k in ("passwordField", "brandOnPage", "passwordAndBrand", "formPostsOffsite")),
        "certificate": w["certificate.certSameDayAsRegistration"] + w["certificate.freeDvIssuer"], "hosting": w["hosting.knownAbusedAsn"], "mitigating": 0,
    }


def category_use(scored: DataFrame) -> DataFrame:
    """By category: its ceiling, the most points that a row (signals) has in it, and how many rows reach the ceiling.

    Points taken away count as none; a row without signals in a category has none there.  A table without rows
    has every category, with nothing in it.
    """
    def points(name: str) -> Column:
        return F.coalesce(F.aggregate("signals", F.lit(0), lambda n, s: n + F.when((s["category"] == name) & (s["points"] > 0), s["points"].cast("int")).otherwise(0)), F.lit(0))

    return category_totals(scored.select(*[points(c).alias(c) for c in category_ceilings()]))


def category_totals(points: DataFrame) -> DataFrame:
    """As category_use, of rows with their points by category (``scoring.category_points``), all categories in one pass."""
    ceilings = category_ceilings()
    found = points.agg(*[F.struct(F.lit(c).alias("category"), F.lit(n).alias("ceiling"), F.coalesce(F.max(c), F.lit(0)).alias("most"), (F.count_if(F.col(c) >= n) if n else F.lit(0).cast("long")).alias("reached")).alias(c) for c, n in ceilings.items()])
    return found.select(F.explode(F.array(*ceilings)).alias("u")).select("u.*")


def due_share(rows: DataFrame, as_of: Column) -> DataFrame:
    """By status: candidates, and how many of them are due."""
    return rows.groupBy("status").agg(F.count("*").alias("candidates"), F.count_if(F.col("next_recheck_at") <= as_of).alias("due"))
