"""Sinks that run again, runs with start and end rows, counters on the way, search answers, entities at any depth."""

import json

import pytest
from pyspark.sql import functions as F
from test_state import AS_OF, BATCH, BRANDS, SIGHTING, now, sightings

from namelens.operators import state
from namelens.plans import jobs, screening, sinks
from namelens.sources import lookups, watchlist
from namelens.streaming import ingest


@pytest.fixture(scope="module")
def brands(spark):
    return watchlist.brands_of(spark, BRANDS)


@pytest.fixture(scope="module")
def allowlist(spark):
    return spark.createDataFrame([("Ok-Paytm.com ",)], "domain string")


# --- sinks


def test_run_is_replaced(spark, tmp_path):
    folder = str(tmp_path / "t")
    rows = lambda n: spark.range(n).withColumnRenamed("id", "k")
    assert sinks.table(spark, folder, "k long").count() == 0
    sinks.append(rows(5), folder, "a")
    sinks.append(rows(3), folder, "b")
    with pytest.raises(Exception, match="boom"):
        sinks.append(rows(9).withColumn("k", F.when(F.col("k") < 4, F.col("k")).otherwise(F.raise_error(F.lit("boom")).cast("long"))), folder, "b")
    sinks.append(rows(4), folder, "b")
    count = lambda: {r["run"]: r["count"] for r in sinks.table(spark, folder, "k long").groupBy("run").count().collect()}
    assert count() == {"a": 5, "b": 4}
    sinks.append(rows(0), folder, "a")
    assert count() == {"b": 4}
    with pytest.raises(ValueError, match="run's id"):
        sinks.append(rows(1), folder, "../x")


BUNDLE = """candidate_id string, checked_at timestamp, dns struct<resolves:boolean,a_records:array<string>,has_mx:boolean,ns_records:array<string>,error:string>,
rdap struct<registrar:string,created_at:timestamp,age_days:int,statuses:array<string>,error:string>,
content struct<page_title:string,has_password_field:boolean,brand_terms_on_page:array<string>,form_posts_offsite:boolean,looks_parked:boolean,content_risk_score:int>"""


def test_assess_half_way_and_again(spark, brands, allowlist, tmp_path, monkeypatch):
    held = ingest.candidates_in(spark, str(tmp_path / "state"), 8)
    ingest.merge_batch(held, 0, sightings(spark, BATCH), brands, allowlist, now())
    later = F.to_timestamp(F.lit("2025-06-02 12:00:00"))
    first = [r["id"] for r in held.read().orderBy("domain").collect()]
    assert len(first) == 2
    bundles = spark.createDataFrame([(i, None, (True, ["1.2.3.4"], True, [], None), (None, None, 1, [], None), ("t", True, ["hdfcbank"], True, False, 90)) for i in first], BUNDLE).withColumn("checked_at", later)
    before = held.read().select("domain", "status").collect()
    real, calls = screening.recheck, []

    def fails_once(*a, **k):
        calls.append(1)
        if len(calls) == 1:
            raise RuntimeError("lost")
        return real(*a, **k)

    monkeypatch.setattr(screening, "recheck", fails_once)
    go = lambda: sinks.assess(held, 1, "r1", str(tmp_path / "out"), bundles, brands.withColumn("name", F.upper("slug")), later)
    with pytest.raises(RuntimeError):
        go()
    assert held.read().select("domain", "status").collect() == before
    for _ in range(2):  # and once more, after it had finished
        out = go()
        assert out["verifications"].count() == 2 and out["risk_scores"].count() == 2
    scores = out["risk_scores"].collect()
    assert len({r["id"] for r in scores}) == 2 and all(any(s["label"] == "The page asks visitors for a password or PIN" for s in r["contributing_signals"]) for r in scores)
    assert {s["label"] for r in scores for s in r["contributing_signals"] if s["key"] == "content.brandOnPage"} == {"The page uses the brand's name (HDFC)", "The page uses the brand's name (PAYTM)"}
    after = {r["domain"]: (r["status"], r["recheck_count"], r["times_seen"]) for r in held.read().collect()}
    assert set(after.values()) == {("verified", 0, 1)} and len(after) == 2
    assert sinks.table(spark, str(tmp_path / "out" / "verifications"), "id string").count() == 2


def test_reports(spark, tmp_path):
    rows = [("c1", None, "dispute", "this is our own site", None), ("c1", None, "dispute", "this is our own site", None), (None, " Bad.com ", "confirm", "looks like phishing", " me@x.org "), (None, None, "other", "about nothing at all", None), ("c2", None, "spam", "not a known kind", None), ("c3", None, "other", "short", None)]
    reports = spark.createDataFrame(rows, "candidate_id string, domain string, kind string, note string, contact string")
    for _ in range(2):
        refused = sinks.take_reports(reports, str(tmp_path), "r1", now())
    got = sinks.table(spark, str(tmp_path / "reports"), sinks.REPORT).collect()
    assert sorted((r["candidate_id"] or "", r["domain"], r["contact"], r["status"]) for r in got) == [("", "bad.com", "me@x.org", "open"), ("c1", None, None, "open")]
    assert sorted(r["error"] for r in refused.collect()) == ["kind, note or contact", "kind, note or contact", "no domain"]


def test_upsert_keeps_rows_without_a_key(spark):
    of = lambda rows: spark.createDataFrame(rows, "k long, v long")
    got = sorted(map(tuple, state.upsert(of([(1, 1), (2, 2), (None, 3)]), of([(2, 7), (None, 9), (4, None), (1, None)]), "k").collect()), key=str)
    assert got == sorted([(1, None), (2, 7), (None, 3), (None, 9), (4, None)], key=str)


# --- runs and counters


def test_runs_have_a_start_and_an_end(spark, tmp_path):
    path = str(tmp_path / "runs")
    assert jobs.run_job(spark, "scan", lambda: {"n": spark.read.schema(jobs.JOB_EVENT).parquet(path).where("event = 'start'").count()}, path) == {"ok": True, "stats": {"n": 1}, "error": None}
    jobs.run_job(spark, "scan", lambda: 1 / 0, path)
    runs = jobs.Runs(spark, path)
    runs.started("killed")
    rows = sorted(runs.table().collect(), key=lambda r: str(r["ok"]))
    assert [(r["job"], r["ok"]) for r in rows] == [("scan", False), ("killed", None), ("scan", True)]
    assert rows[1]["finished_at"] is None and rows[0]["error"].startswith("ZeroDivisionError") and all(r["started_at"] for r in rows)


def test_listener_writes_runs_of_streams(spark, tmp_path):
    for k in range(2):
        sightings(spark, BATCH[3 * k : 3 * k + 3]).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    runs = jobs.Runs(spark, str(tmp_path / "runs"))
    listener = jobs.RunListener(runs, {"scan"})
    spark.streams.addListener(listener)
    try:
        source = spark.readStream.schema(SIGHTING).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        rows = source.observe("names", F.count("*").alias("seen"), F.count_if(F.col("issuer").isNull()).alias("without_issuer"))
        write = lambda df, name, out: df.writeStream.queryName(name).format("parquet").option("path", str(tmp_path / out)).option("checkpointLocation", str(tmp_path / f"cp-{out}")).trigger(availableNow=True).start()
        write(rows, "scan", "a").awaitTermination()
        bad = write(rows.withColumn("ord", F.raise_error(F.lit("broken")).cast("long")), "scan", "b")
        with pytest.raises(Exception, match="broken"):
            bad.awaitTermination()
        write(rows, "other", "c").awaitTermination()
        for _ in range(60):
            table = runs.table().collect()
            if sum(r["finished_at"] is not None for r in table) == 2:
                break
            import time

            time.sleep(0.5)
    finally:
        spark.streams.removeListener(listener)
    by_ok = {r["ok"]: r for r in table}
    assert len(table) == 2 and {r["job"] for r in table} == {"scan"}
    assert json.loads(by_ok[True]["stats"]) == {"triggers": 2, "rows": 6, "names.seen": 6, "names.without_issuer": 1} and "broken" in by_ok[False]["error"]


def test_counters_come_from_one_scan(spark, brands, allowlist, tmp_path):
    allowed = allowlist.unionByName(spark.createDataFrame([("other.org",)], "domain string"))
    sightings(spark, BATCH).coalesce(1).write.parquet(str(tmp_path / "in"))
    batch = spark.read.schema(SIGHTING).parquet(str(tmp_path / "in"))
    empty = spark.createDataFrame([], ingest.CANDIDATE)
    read = spark.sparkContext.accumulator(0)
    told = F.udf(lambda x: (read.add(1), x)[1]).asNondeterministic()
    for round_ in range(2):
        counted = jobs.counted_ingest(batch.withColumn("source", told("source")), brands, allowed, empty, now())
        counted.rows.write.mode("overwrite").parquet(str(tmp_path / f"out{round_}"))
        got = counted.counters()
        assert read.value == 7 * (round_ + 1)  # each sighting once
        _, matches = screening.matched(batch, brands, allowed)
        assert got == screening.counters(batch, matches, empty, allowed).first().asDict()
        assert (got["seen"], got["matched"], got["inserted"], got["updated"]) == (7, 2, 2 - 2 * round_, 2 * round_)
        empty = spark.read.schema(ingest.CANDIDATE).parquet(str(tmp_path / f"out{round_}"))
    known, new = screening.ingest(batch, brands, allowed, spark.createDataFrame([], ingest.CANDIDATE), now())
    assert sorted(r["domain"] for r in known.unionByName(new).collect()) == sorted(r["domain"] for r in spark.read.parquet(str(tmp_path / "out0")).collect())


# --- search answers and registrations


def test_search_answers(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(lookups, "MOST_BYTES", 1000)
    row = lambda name, until: {"id": 1, "common_name": name, "name_value": f"{name}\nwww.{name}", "entry_timestamp": "2025-06-01T10:00:00", "not_after": until}
    rows = json.dumps([row("live.com", "2026-01-01T00:00:00"), row("expired.com", "2025-01-01T00:00:00"), row("undated.com", None)])
    recorded = [
        ("good", 1, 200, rows, None), ("good", 2, 200, "[]", None), ("late", 1, 200, "[]", None), ("late", 2, 200, rows, None), ("none", 1, 200, "[]", None), ("none", 2, 200, "[]", None), ("none", 3, 200, rows, None),
        ("large", 1, 200, json.dumps([row("x" * 2000, None)]), None), ("large", 2, 200, rows, None), ("busy", 1, 503, None, None), ("busy", 2, None, None, "aborted"), ("busy", 3, 200, rows, None), ("down", 1, 503, "", None), ("down", 2, 503, "", None), ("down", 3, 502, "", None), ("down", 4, 200, rows, None),
        ("gone", 1, 404, "", None), ("gone", 2, 200, rows, None), ("html", 1, 200, "<html>\n <b>", None), ("once", 1, 200, "[]", None), ("object", 1, 200, "{}", None), ("object", 2, 200, '{"a": [1]}', None),
    ]
    names = ["term", "attempt", "status", "body", "error"]
    (tmp_path / "answers.json").write_text("\n".join(json.dumps(dict(zip(names, r, strict=True))) for r in recorded))
    answers = lookups.read_answers(spark, str(tmp_path / "answers.json"))
    got = {r["term"]: (r["attempts"], r["attempt"], r["rows"], r["error"] and r["error"].partition(": ")[2]) for r in lookups.search_outcomes(answers).collect()}
    assert got == {
        "good": (1, 1, 3, None), "late": (2, 2, 3, None), "none": (2, 2, 0, None), "large": (1, None, 0, "answer of 0 MB, over the 0 MB cap"), "busy": (3, 3, 3, None), "down": (3, None, 0, "HTTP 502"), "gone": (1, None, 0, "HTTP 404"),
        "html": (1, None, 0, "not JSON: <html> <b>"), "once": (1, None, 0, None), "object": (2, 2, 0, None),
    }
    live = lookups.answered_rows(answers, now())
    assert sorted({(r["term"], r["common_name"]) for r in live.collect()}) == sorted((t, n) for t in ("good", "late", "busy") for n in ("live.com", "undated.com"))
    assert lookups.search_sightings(live.where("term = 'late'"), now(), 24).count() == 4


def test_registrars_at_any_depth(spark):
    card = lambda *f: {"roles": ["registrar"], "vcardArray": ["vcard", [["version", {}, "text", "4.0"], *f]]}
    deep = card(["fn", {}, "text", "Deep"])
    for _ in range(9):
        deep = {"roles": ["abuse"], "entities": [{"handle": 1}, deep]}
    iana = {"roles": ["x", "registrar"], "publicIds": [{"type": None}, {"type": "IANA Registrar ID", "identifier": "42"}]}
    bodies = {
        1: {"entities": [deep, card(["fn", {}, "text", "Top"])]}, 2: {"entities": [card(["fn", {}, "text", "Outer"]) | {"entities": [card(["fn", {}, "text", "Inner"])]}]}, 3: {"entities": [card(["fn", {}, "text", 7]) | {"entities": [iana]}, card(["fn", {}, "text", "Next"])]},
        4: {"entities": []}, 5: {}, 6: {"entities": {"not": "a list"}}, 7: {"entities": [{"roles": "registrar"}, None, 3]}, 8: {"entities": [card(["adr", {}, "text", "no"], ["fn"], ["fn", {}, "text", ["list"]], ["fn", {}, "text", "Third"])]},
    }
    df = spark.createDataFrame([(k, json.dumps(v)) for k, v in bodies.items()] + [(9, "{"), (10, None)], "k long, json string")
    assert {r["k"]: r["registrar"] for r in lookups.registrars(df, "k").collect()} == {1: "Deep", 2: "Outer", 3: "IANA registrar 42", 8: "Third"}
    assert lookups.registrars(df.limit(0), "k").count() == 0


def test_services_with_clashing_names(spark):
    names = spark.createDataFrame([("a.com", 1, 2, 3)], "domain string, suffix int, tld int, `x.y` int")
    services = spark.createDataFrame([("com", "u")], "tld string, url string")
    assert tuple(lookups.with_service(names, services).first()) == ("a.com", 1, 2, 3, "u")
