"""Appends that can run again: verifications, risk scores and reports by run.

Each run has a partition of its own, ``run=<id>``, and writing it again replaces it.  So a run that
failed half way is simply repeated: what it had written is written anew, and nothing is
there twice.  Ids of rows follow from their contents, so that a repeated run gives the same ones.

Defined results: a run without rows has an empty partition; tables that don't exist yet are empty.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from namelens.operators import ranking, state
from namelens.plans import screening
from namelens.sources import lookups
from namelens.streaming.snapshots import Snapshots

REPORT = "id string, candidate_id string, domain string, kind string, note string, contact string, status string, created_at timestamp, resolved_at timestamp, resolution string"


def append(rows: DataFrame, folder: str, run: str) -> None:
    """Write the rows of a run to a table, in place of what the run had written before."""
    if not re.fullmatch(r"[A-Za-z0-9_.-]+", run):
        raise ValueError(f"a run's id is letters, digits, dots, dashes and underscores, not {run!r}")
    rows.write.mode("overwrite").parquet(f"{folder.rstrip('/')}/run={run}")


def of_run(spark: SparkSession, folder: str, run: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/run={run}")


def table(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """All runs of a table, with their ``run``."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    there = path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)
    return spark.read.schema(f"{schema}, run string").parquet(folder) if there else spark.createDataFrame([], f"{schema}, run string")


def assess(candidates: Snapshots, number: int, run: str, folder: str, bundles: DataFrame, brands: DataFrame, as_of: Column, n: int = 25) -> dict[str, DataFrame]:
    """A recheck run: the answers (bundles) of due candidates become verifications, scores and new states.

    Each step reads what the step before has written, so that they agree even if answers can't be read
    twice.  number: the batch of the candidates' snapshot; the run again is the batch again.
    """
    spark = bundles.sparkSession
    append(lookups.verification_rows(bundles), f"{folder}/verifications", run)
    verifications = of_run(spark, f"{folder}/verifications", run)
    before = candidates.read(before=number)
    due = ranking.due(before, as_of, n).join(verifications.select(F.col("candidate_id").alias("id")), "id", "left_semi").persist()
    try:
        known, lost = screening.with_brands(due, brands)
        after, scores = screening.recheck(known, verifications, as_of, brands)
        append(scores, f"{folder}/risk_scores", run)

        def merge(old: DataFrame) -> DataFrame:
            return state.upsert(old, after.select(*old.columns), "domain")

        candidates.apply(number, known.select("domain"), merge)
        append(lost, f"{folder}/errors", run)
    finally:
        due.unpersist()
    return {"verifications": verifications, "risk_scores": of_run(spark, f"{folder}/risk_scores", run), "errors": of_run(spark, f"{folder}/errors", run)}


def take_reports(reports: DataFrame, folder: str, run: str, as_of: Column) -> DataFrame:
    """Write the reports (candidate_id, domain, kind, note, contact) of a run that are accepted, as open ones; the others, with why not.

    One that names neither a candidate nor a domain is about nothing; repeated ones within a run are one report.
    """
    about = F.col("candidate_id").isNotNull() | (F.length(F.trim("domain")) > 0)
    checked = state.checked_reports(reports).withColumn("about", F.coalesce(about, F.lit(False)))
    good = checked.where("accepted AND about").select(
        F.sha2(F.concat_ws("|", F.lit(run), *[F.coalesce(F.col(c).cast("string"), F.lit("\u0000")) for c in ("candidate_id", "domain", "kind", "note", "contact")]), 256).alias("id"), F.col("candidate_id").cast("string").alias("candidate_id"),
        F.nullif(F.lower(F.trim("domain")), F.lit("")).alias("domain"), "kind", F.trim("note").alias("note"), F.nullif(F.trim("contact"), F.lit("")).alias("contact"), F.lit("open").alias("status"), as_of.alias("created_at"),
        F.lit(None).cast("timestamp").alias("resolved_at"), F.lit(None).cast("string").alias("resolution"),
    )
    append(good.dropDuplicates(["id"]), f"{folder}/reports", run)
    return checked.where("NOT (accepted AND about)").withColumn("error", F.when(~F.col("about"), "no domain").otherwise("kind, note or contact")).select(*reports.columns, "error")
