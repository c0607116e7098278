import json

from pyspark.sql import functions as F

from namelens import constants as C
from namelens.plans import jobs


def test_runs(spark, tmp_path):
    path = str(tmp_path / "runs")
    assert jobs.run_job(spark, "scan", lambda: {"n": 3}, path)["ok"]
    assert not jobs.run_job(spark, "scan", lambda: 1 / 0, path)["ok"]
    rows = {r["ok"]: r for r in spark.read.parquet(path).collect()}
    assert json.loads(rows[True]["stats"]) == {"n": 3} and rows[False]["error"].startswith("ZeroDivisionError")


def test_scan_outcome(spark):
    of = lambda rows: jobs.scan_outcome(spark.createDataFrame(rows, "log_url string, entries long, names long, skipped long, error string")).first().asDict()
    assert of([("a", 1000, 3, 0, None), ("b", 0, 0, 5, "down")]) == {"logs": 2, "failures": 1, "entries": 1000, "names": 3, "skipped": 5, "hit_rate": 0.3, "ok": True}
    assert not of([("a", 0, 0, 0, "down")])["ok"] and of([])["ok"]


def test_cursors_and_json(spark):
    logs = spark.createDataFrame([(0, "a"), (1, "b"), (2, "c")], "ord int, url string")
    cursors = spark.createDataFrame([("a", 9, "2025-01-02"), ("b", 5, "2025-01-01")], "url string, last_index long, last_scanned_at string")
    rows = jobs.with_cursors(logs, cursors)
    assert [(r["url"], r["last_index"]) for r in rows.collect()] == [("c", 0), ("b", 5), ("a", 9)]
    assert json.loads(jobs.as_json(rows).first()["json"])["url"] == "c"


def test_ceilings_and_due(spark):
    ceilings = jobs.category_ceilings()
    assert ceilings["name"] < C.TIER_MEDIUM and ceilings["content"] == 52 and sum(ceilings.values()) >= 100
    df = spark.createDataFrame([("new", "2025-01-01"), ("new", "2026-01-01")], "status string, next_recheck_at string")
    assert tuple(jobs.due_share(df, F.lit("2025-06-01")).first()) == ("new", 2, 1)
