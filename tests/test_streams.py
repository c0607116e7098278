"""Incremental state, timers, windows and sessions as streams."""

import datetime
import random

import pytest
from pyspark.sql import functions as F
from test_state import AS_OF, SIGHTING, now, sightings

from namelens.operators import ranking
from namelens.plans import screening
from namelens.sources import seed
from namelens.streaming import ingest, snapshots, timers

T = lambda hour, minute=0: datetime.datetime(2024, 1, 1, hour, minute)


@pytest.fixture(scope="module")
def brands(spark):
    return seed.brands(spark)


@pytest.fixture(scope="module")
def allowlist(spark):
    return seed.allowlist(spark)


def run(query):
    query.processAllAvailable()
    query.stop()


# --- incremental state


def test_field_names():
    assert snapshots.field_names("a string, b struct<x:int,y:array<struct<p:int, q:int>>>, c map<string,int>") == ["a", "b", "c"]
    assert len(snapshots.field_names(ingest.CANDIDATE)) == 21


def counted(old, delta):
    return old.unionByName(delta).groupBy("k").agg(F.sum("n").alias("n"))


def test_batch_writes_its_buckets_only(spark, tmp_path):
    state = snapshots.Snapshots(spark, str(tmp_path / "s"), "k string, n long", "k", 64)
    put = lambda number, keys: state.apply(number, (d := spark.createDataFrame([(k, 1) for k in keys], "k string, n long")).select("k"), lambda old: counted(old, d))
    assert put(0, [f"k{i}" for i in range(500)] + [None]) == set(range(64))
    for number, keys in ((1, ["k1"]), (2, ["k1", "k2", "new"]), (3, [])):
        touched = put(number, keys)
        files = list((tmp_path / "s" / "data").glob(f"batch={number}/bucket=*/*.parquet"))
        assert len(touched) <= len(set(keys)) and len(files) == len(touched) and {int(f.parent.name[7:]) for f in files} == touched
    got = {r["k"]: r["n"] for r in state.read().collect()}
    assert got == {f"k{i}": 1 for i in range(500)} | {None: 1, "k1": 3, "k2": 2, "new": 1}
    assert {r["k"]: r["n"] for r in state.read(before=2).where("k = 'k1'").collect()} == {"k1": 2}


def test_replay_and_failure_change_nothing(spark, tmp_path):
    state = snapshots.Snapshots(spark, str(tmp_path / "s"), "k string, n long", "k", 8)
    delta = spark.createDataFrame([("a", 1), ("b", 1)], "k string, n long")
    merge = lambda old: counted(old, delta)
    state.apply(0, delta.select("k"), merge)
    with pytest.raises(Exception, match="boom"):  # fails after half of the work
        state.apply(1, delta.select("k"), lambda old: counted(old, delta).withColumn("n", F.when(F.col("k") == "b", F.raise_error(F.lit("boom")).cast("long")).otherwise(F.col("n"))))
    assert {tuple(r) for r in state.read().collect()} == {("a", 1), ("b", 1)} and state.batches() == [0]
    for _ in range(3):
        state.apply(1, delta.select("k"), merge)
    assert {tuple(r) for r in state.read().collect()} == {("a", 2), ("b", 2)}


def test_lost_rows_and_vacuum(spark, tmp_path):
    state = snapshots.Snapshots(spark, str(tmp_path / "s"), "k string, n long", "k", 8)
    delta = spark.createDataFrame([(f"k{i}", 1) for i in range(100)], "k string, n long")
    for number in range(4):
        some = delta.where(F.col("k") == f"k{number}") if number else delta
        state.apply(number, some.select("k"), lambda old, some=some: counted(old, some))
    want = {tuple(r) for r in state.read().collect()}
    state.vacuum(keep=1)
    assert state.batches() == [3] and {tuple(r) for r in state.read().collect()} == want
    held = state.manifest()
    assert {(int(f.parent.name[7:]), int(f.parent.parent.name[6:])) for f in (tmp_path / "s" / "data").glob("batch=*/bucket=*/*.parquet")} == set(held.items())
    state.apply(4, delta.select("k"), lambda old: old.where(F.lit(False)))
    assert state.read().count() == 0 and state.manifest() == {}
    state.apply(5, delta.select("k"), lambda old: counted(old, delta))
    assert state.read().count() == 100


def test_stream_equals_batch(spark, brands, allowlist, tmp_path):
    r = random.Random(2)
    rows = [(i, f"{r.choice(['hdfcbank', 'paytm', 'hdfcbnak', 'zzz'])}-{r.randint(0, 5)}.com", None, "2025-05-01") for i in range(60)]
    for k in range(3):
        sightings(spark, rows[20 * k : 20 * k + 20]).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(SIGHTING).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    ingest.start(source, brands, allowlist, str(tmp_path / "state"), str(tmp_path / "cp"), AS_OF).awaitTermination()
    state = ingest.candidates_in(spark, str(tmp_path / "state"))
    streamed = {r["domain"]: (r["matched_term"], r["times_seen"] >= 1) for r in state.read().collect()}
    _, new = screening.ingest(sightings(spark, rows), brands, allowlist, spark.createDataFrame([], ingest.CANDIDATE), now())
    assert streamed and streamed == {r["domain"]: (r["matched_term"], True) for r in new.collect()}
    before = {tuple(r) for r in state.read().select("domain", "times_seen").collect()}
    # the last batch again, as after a failure between its write and the stream's own mark
    last = state.batches()[-1]
    files = sorted((tmp_path / "in").glob("*.parquet"), key=lambda f: f.stat().st_mtime)
    ingest.merge_batch(state, last, spark.read.schema(SIGHTING).parquet(str(files[-1])), brands, allowlist, now())
    assert {tuple(r) for r in state.read().select("domain", "times_seen").collect()} == before


# --- timers

CANDIDATES = "domain string, id string, status string, publish_state string, next_recheck_at timestamp, updated_at timestamp"


def test_timers_equal_the_batch_queue(spark, tmp_path):
    r = random.Random(4)
    newest, given, batch = {}, [], 0

    def put(rows):
        nonlocal batch
        spark.createDataFrame(rows, CANDIDATES).coalesce(1).write.parquet(str(tmp_path / "in" / f"b{batch}"))
        batch += 1
        stream.processAllAvailable()

    put_first = [("first.com", "0", "verified", "hidden", T(1), T(0))]
    spark.createDataFrame(put_first, CANDIDATES).coalesce(1).write.parquet(str(tmp_path / "in" / "b_"))
    source = spark.readStream.schema(CANDIDATES).parquet(str(tmp_path / "in" / "*")).withWatermark("updated_at", "0 seconds")
    with timers.stores(spark):
        due = timers.due_rows(timers.schedules(source, F.unix_millis("updated_at")), "EventTime")
        stream = due.writeStream.format("memory").queryName("due_now").option("checkpointLocation", str(tmp_path / "cp")).start()
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass", None) != timers.STORE["spark.sql.streaming.stateStore.providerClass"]
    stream.processAllAvailable()
    newest["first.com"] = put_first[0]
    told = set()
    for hour in range(1, 12):
        rows = [(f"d{i}.com", str(i), r.choice(["new", "verified", "verified", "retired"]), r.choice(["hidden", "published", "cleared"]), T(r.randrange(24), r.randrange(60)), T(hour)) for i in r.sample(range(12), 4)]
        put(rows)
        now_due = {(x["domain"], x["due_at"]) for x in spark.table("due_now").collect()}
        # what the batch queue finds at this hour, of schedules that haven't been given yet
        newest |= {x[0]: x for x in rows}
        table = spark.createDataFrame(list(newest.values()), CANDIDATES)
        told |= {(x["domain"], x["next_recheck_at"]) for x in ranking.due(table, F.lit(T(hour)), 1000).collect()}
        given = [(x["domain"], x["due_at"]) for x in spark.table("due_now").collect()]
        assert now_due == told, hour
    assert len(given) == len(set(given)) and len(given) > 5
    stream.stop()


def test_timers_of_many_domains_share_buckets(spark, tmp_path):
    """A key of the state holds many domains, and its one timer gives all that are due; the rows are those of the batch queue."""
    rows = lambda hour, every: [(f"d{i}.com", str(i), "retired" if i % 7 == hour else "verified", "hidden", T((i + hour) % 12, i % 60), T(hour)) for i in range(0, 3000, every)]
    source = spark.readStream.schema(CANDIDATES).parquet(str(tmp_path / "in" / "*")).withWatermark("updated_at", "0 seconds")
    newest, told, stream = {}, set(), None
    for n, (hour, every) in enumerate([(3, 1), (6, 5), (8, 3000)]):
        spark.createDataFrame(rows(hour, every), CANDIDATES).coalesce(1).write.parquet(str(tmp_path / "in" / f"b{n}"))
        if stream is None:
            with timers.stores(spark):
                stream = timers.due_rows(timers.schedules(source, F.unix_millis("updated_at")), "EventTime").writeStream.format("memory").queryName("due_many").option("checkpointLocation", str(tmp_path / "cp")).start()
        stream.processAllAvailable()
        newest |= {x[0]: x for x in rows(hour, every)}
        told |= {(x["domain"], x["id"], x["next_recheck_at"]) for x in ranking.due(spark.createDataFrame(list(newest.values()), CANDIDATES), F.lit(T(hour)), 10_000).collect()}
        given = [tuple(x) for x in spark.table("due_many").collect()]
        assert len(given) == len(set(given)) and set(given) == told, hour
    # the schedules of a bucket, its timer, and the timer's index
    assert 0 < stream.lastProgress["stateOperators"][0]["numRowsTotal"] <= 3 * 1024
    stream.stop()


def test_due_once_rescheduled_and_retired(spark, tmp_path):
    """By the machine's own clock."""
    start = datetime.datetime.now(datetime.timezone.utc).replace(tzinfo=None)
    at = lambda s: start + datetime.timedelta(seconds=s)
    put = lambda n, rows: spark.createDataFrame(rows, CANDIDATES).coalesce(1).write.parquet(str(tmp_path / "in" / f"b{n}"))
    put(0, [("a.com", "1", "verified", "hidden", at(-60), at(0)), ("b.com", "2", "verified", "hidden", at(3600), at(0)), ("c.com", "3", "verified", "hidden", at(-60), at(0)), ("c.com", "3", "retired", "hidden", at(-60), at(1)), (None, "4", "verified", "hidden", at(-60), at(0)), ("d.com", "5", "verified", "hidden", None, at(0))])
    source = spark.readStream.schema(CANDIDATES).parquet(str(tmp_path / "in" / "*"))
    with timers.stores(spark):
        stream = timers.due_rows(timers.schedules(source, F.unix_millis("updated_at"))).writeStream.format("memory").queryName("due_clock").option("checkpointLocation", str(tmp_path / "cp")).start()

    def wait(n):
        import time

        for _ in range(120):
            if spark.table("due_clock").count() >= n:
                break
            time.sleep(0.5)
        return sorted(x["domain"] for x in spark.table("due_clock").collect())

    assert wait(1) == ["a.com"]
    put(1, [("a.com", "1", "verified", "hidden", at(-30), at(2)), ("b.com", "2", "retired", "hidden", at(-30), at(2)), ("a.com", "1", "verified", "hidden", at(-90), at(1))])
    assert wait(2) == ["a.com", "a.com"]
    put(2, [("b.com", "2", "verified", "hidden", at(-20), at(3))])
    assert wait(3) == ["a.com", "a.com", "b.com"]
    stream.stop()


# --- windows and sessions


def test_sessions_with_late_rows(spark, tmp_path):
    schema = "user string, at timestamp"
    put = lambda n, rows: spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in" / f"b{n}"))
    put(0, [("a", T(1, 0)), ("a", T(1, 10)), ("b", T(1, 5)), (None, T(1, 0)), ("a", None)])
    source = spark.readStream.schema(schema).parquet(str(tmp_path / "in" / "*"))
    stream = ingest.sessions(source, "user", "at", "30 minutes", "1 hour").writeStream.format("memory").queryName("sessions").option("checkpointLocation", str(tmp_path / "cp")).start()
    stream.processAllAvailable()
    put(1, [("a", T(0, 45)), ("a", T(4, 0))])  # the first is late, but within the delay
    stream.processAllAvailable()
    put(2, [("a", T(1, 20)), ("b", T(6, 0))])  # the first is too late
    stream.processAllAvailable()
    got = {(r["user"], r["started"], r["last_at"], r["n"]) for r in spark.table("sessions").collect()}
    assert got == {("a", T(0, 45), T(1, 10), 3), ("b", T(1, 5), T(1, 5), 1), (None, T(1, 0), T(1, 0), 1), ("a", T(4, 0), T(4, 0), 1)}
    stream.stop()


def test_sliding_windows(spark):
    rows = spark.createDataFrame([(T(1, 30),), (T(2, 15),)], "first_seen_at timestamp")
    got = {r["window"]["start"].hour: r["count"] for r in ingest.counts_by_window(rows, "2 hours", slide="1 hour").collect()}
    assert got == {0: 1, 1: 2, 2: 1}
