"""Recorded logs: conditions in the scan, admission, and what a stream tells of its logs."""

import json

import pytest
from pyspark.sql import functions as F
from test_sources import certificate, leaf

from namelens.plans import jobs
from namelens.sources import certificates, logs


def record(top, log, n, each=10, names=lambda i: [f"n{i}.com"], head=None):
    (top / log).mkdir(parents=True, exist_ok=True)
    for first in range(0, n, each):
        lines = [json.dumps({"leaf_input": leaf(certificate(names(i)), ms=1_700_000_000_000 + i)}) for i in range(first, min(n, first + each))]
        (top / log / f"{first:08d}.jsonl").write_text("\n".join(lines) + "\n")
    if head:
        (top / log / "head.json").write_text(json.dumps(head))


@pytest.fixture
def top(spark, tmp_path):
    spark.dataSource.register(logs.RecordedLogs)
    spark.dataSource.register(logs.RecordedNames)
    return tmp_path / "logs"


def opened(monkeypatch):
    seen, real = [], logs.Recording.lines
    monkeypatch.setattr(logs.Recording, "lines", lambda self, log, first: (seen.append((log, first)), real(self, log, first))[1])
    return seen


# --- conditions in the scan


def test_conditions_reach_the_reader(spark, top, monkeypatch):
    record(top, "one", 40)
    record(top, "two", 40)
    seen = opened(monkeypatch)
    reader = logs.RecordedLogs({"path": str(top), "pushdown": "true"}).reader(None)
    D = logs  # noqa: N806
    left = list(reader.pushFilters([D.EqualTo(("log_url",), "one"), D.GreaterThan(("idx",), 14), D.LessThanOrEqual(("idx",), 27), D.IsNotNull(("idx",)), D.EqualTo(("leaf_input",), "x")]))
    assert left == [D.EqualTo(("leaf_input",), "x")]
    parts = reader.partitions()
    seen.clear()  # the head counts the last file
    rows = [r for p in parts for r in reader.read(p)]
    assert [(r[0], r[1]) for r in rows] == [("one", i) for i in range(15, 28)] and seen == [("one", 10), ("one", 20)]
    reader = logs.RecordedLogs({"path": str(top), "pushdown": "true"}).reader(None)
    assert not list(reader.pushFilters([D.In(("idx",), (3, 35)), D.In(("log_url",), ("two", "three"))]))
    assert [(r[0], r[1]) for p in reader.partitions() for r in reader.read(p)] == [("two", 3), ("two", 35)]


CONDITIONS = [
    "log_url = 'one' AND idx >= 12 AND idx < 31", "idx IN (1, 25, 39) AND name LIKE 'n%'", "name LIKE '%5.com'", "name LIKE '%n1%' AND log_url <> 'one'", "name = 'n7.com'", "name IN ('n7.com', 'n8.com') AND idx > 7",
    "name LIKE 'n%' AND timestamp_ms > 1700000000020", "idx = 5 OR name = 'n9.com'", "log_url = 'none'", "idx > 5 AND idx < 3", "log_url IS NULL", "idx IS NOT NULL AND NOT name = 'n3.com'",
]


@pytest.mark.parametrize("condition", CONDITIONS)
def test_pushed_conditions_equal_those_above_the_scan(spark, top, condition):
    record(top, "one", 40, names=lambda i: [f"n{i}.com", f"*.N{i}.com", f"www.n{i}.com"])
    record(top, "two", 25)
    read = lambda: spark.read.format("recorded_names").option("path", str(top)).load()
    plain = sorted(map(tuple, read().where(condition).collect()))
    df = logs.recorded(spark, str(top)).where(condition)
    assert sorted(map(tuple, df.collect())) == plain
    plan = spark._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")
    if condition in CONDITIONS[:3] + CONDITIONS[4:6]:  # nothing is left for Spark to test
        assert "Filter (" not in plan and "PushedFilters: [" in plan, plan


def test_names_equal_the_decoded_entries(spark, top):
    record(top, "one", 30, names=lambda i: [f"A{i % 7}.com", f"*.b{i}.org", "bad name.com"])
    (top / "one" / "00000030.jsonl").write_text('{"leaf_input": "???"}\n{"other": 1}\n')
    read = lambda kind: spark.read.format(kind).option("path", str(top)).load()
    want = sorted(map(str, certificates.sightings(read("recorded_logs")).collect()))
    assert sorted(map(str, logs.sightings(read("recorded_names")).collect())) == want and len(want) == 37


# --- admission


def test_shares():
    assert logs.shares({"a": 5, "b": 100, "c": 100}, 105, []) == {"a": 5, "b": 50, "c": 50}
    assert logs.shares({"a": 5, "b": 3}, 100, []) == {"a": 5, "b": 3}
    assert logs.shares({"a": 5, "b": 5, "c": 5}, 2, ["c", "a", "b"]) == {"a": 1, "b": 0, "c": 1}
    assert logs.shares({"a": 7, "b": 9}, 9, ["b", "a"]) == {"a": 4, "b": 5}
    assert logs.shares({}, 5, []) == {} and logs.shares({"a": 0}, 5, ["a"]) == {"a": 0}


def stopped(offset):
    return {log: (o["next"], o["stopped"], o["skipped"]) for log, o in offset.items()}


def test_uneven_logs_share_a_budget(top):
    record(top, "large", 200)
    record(top, "mid", 50)
    record(top, "small", 5)
    reader = logs.RecordedLogs({"path": str(top), "start": "0", "entries": "65", "per_trigger": "40"}).streamReader(None)
    assert stopped(reader.latestOffset()) == {"large": (30, "budget", 0), "mid": (30, "budget", 0), "small": (5, "caught-up", 0)}
    assert stopped(reader.latestOffset()) == {"large": (70, "limit", 0), "mid": (50, "caught-up", 0), "small": (5, "caught-up", 0)}
    for _ in range(10):
        last = reader.latestOffset()
    assert {o["stopped"] for o in last.values()} == {"caught-up"} and last == reader.latestOffset()


def test_scarce_budget_rotates(top):
    for log in "abc":
        record(top, log, 6)
    reader = logs.RecordedLogs({"path": str(top), "start": "0", "entries": "1"}).streamReader(None)
    order = []
    for _ in range(6):
        was = {log: o["next"] for log, o in (reader.now or reader.initialOffset()).items()}
        order += [log for log, o in reader.latestOffset().items() if o["next"] > was[log]]
    assert order == list("abcabc")


def test_seconds_follow_the_measured_rate(top):
    record(top, "one", 400, each=100)
    reader = logs.RecordedLogs({"path": str(top), "start": "0", "seconds": "2", "rate": "10"}).streamReader(None)
    times = iter([0.0, 1.0, 1.0, 2.0, 2.0])
    reader.clock = lambda: next(times)
    assert reader.latestOffset()["one"]["next"] == 20  # two seconds at ten entries each
    assert reader.latestOffset()["one"]["next"] == 20 + 30  # twenty in the last second: the rate is now 15
    one = reader.latestOffset()["one"]  # thirty in the last second: 22.5
    assert (one["next"], one["stopped"]) == (50 + 45, "budget")


def test_lag_and_errors(top):
    record(top, "far", 100)
    record(top, "near", 20)
    record(top, "lost", 10, head={"tree_size": 15, "timestamp": 7})
    record(top, "bad", 10)
    (top / "bad" / "x.jsonl").write_text("")
    reader = logs.RecordedLogs({"path": str(top), "start": "0", "max_lag": "30", "per_trigger": "25"}).streamReader(None)
    now = reader.latestOffset()
    assert stopped(now) == {"far": (95, "limit", 70), "near": (20, "caught-up", 0), "lost": (0, "error", 0), "bad": (0, "error", 0)}
    assert "no entries recorded from 10 on, the head is 15" in now["lost"]["error"] and now["bad"]["error"]
    (top / "bad" / "x.jsonl").unlink()
    record(top, "lost", 15)
    assert stopped(reader.latestOffset()) == {"far": (100, "caught-up", 0), "near": (20, "caught-up", 0), "lost": (15, "caught-up", 0), "bad": (10, "caught-up", 0)}


def test_stream_tells_what_it_did(spark, top, tmp_path):
    record(top, "far", 100, head={"tree_size": 100, "timestamp": 1_700_000_000_000})
    record(top, "near", 20)
    record(top, "lost", 10, head={"tree_size": 15, "timestamp": 7})
    start = lambda: spark.readStream.format("recorded_names").option("path", str(top)).option("start", 0).option("max_lag", 30).option("entries", 24).load().writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).start()
    query = start()
    query.processAllAvailable()
    report = logs.scan_report(spark, query.recentProgress)
    query.stop()
    per_log = {r["log_url"]: r for r in report.groupBy("log_url").agg(F.sum("entries").alias("entries"), F.sum("skipped").alias("skipped"), F.max_by("stopped", "batch").alias("stopped"), F.max("error").alias("error"), F.min("from_index").alias("first")).collect()}
    assert {k: (r["entries"], r["skipped"], r["stopped"], r["first"]) for k, r in per_log.items()} == {"far": (30, 70, "caught-up", 70), "near": (20, 0, "caught-up", 0), "lost": (0, 0, "error", 0)}
    assert {r["stopped"] for r in report.collect()} == {"budget", "caught-up", "error"}
    got = sorted((r["log_url"], r["idx"]) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == [("far", i) for i in range(70, 100)] + [("near", i) for i in range(20)]
    record(top, "near", 30)
    query = start()  # goes on from the checkpoint
    query.processAllAvailable()
    query.stop()
    got = sorted((r["log_url"], r["idx"]) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == [("far", i) for i in range(70, 100)] + [("near", i) for i in range(30)]
    outcome = jobs.scan_outcome(report.groupBy("log_url").agg(F.sum("entries").alias("entries"), F.sum("entries").alias("names"), F.sum("skipped").alias("skipped"), F.max("error").alias("error"))).first()
    assert (outcome["logs"], outcome["failures"], outcome["skipped"], outcome["ok"]) == (3, 1, 70, True)
    assert sorted(map(tuple, logs.heads(spark, str(top)).collect())) == [("far", 100, 1_700_000_000_000), ("lost", 15, 7)]
