import random

import pytest
from pyspark.sql import functions as F

from namelens.operators import ranking, state
from namelens.plans import screening, views
from namelens.sources import watchlist
from namelens.streaming import ingest

AS_OF = "2025-06-01 12:00:00"
BRANDS = [("hdfc", ["hdfcbank.com"], ["hdfcbank"]), ("paytm", ["paytm.com"], ["paytm"])]
SIGHTING = "ord long, name string, issuer string, not_before timestamp, logged_at timestamp, source string"


def now():
    return F.to_timestamp(F.lit(AS_OF))


def sightings(spark, rows):
    df = spark.createDataFrame([(i, n, issuer, None, at, "ct") for i, n, issuer, at in rows], "ord long, name string, issuer string, not_before string, logged_at string, source string")
    return df.withColumns({"not_before": F.col("not_before").cast("timestamp"), "logged_at": F.col("logged_at").cast("timestamp")})


@pytest.fixture(scope="module")
def brands(spark):
    return watchlist.brands_of(spark, BRANDS)


@pytest.fixture(scope="module")
def allowlist(spark):
    return spark.createDataFrame([("Ok-Paytm.com ",)], "domain string")


BATCH = [
    (0, "www.hdfcbank-login.com", "A", "2025-05-02"), (1, "hdfcbank-login.com", "B", "2025-05-01"), (2, "paytm-kyc.in", None, None), (3, "paytm-kyc.in", "C", "2025-05-01"),
    (4, "hdfcbank.com", "D", "2025-05-01"), (5, "ok-paytm.com", "D", "2025-05-01"), (6, "other.org", "D", "2025-05-01"),
]


def test_ingest_and_replay(spark, brands, allowlist):
    empty = spark.createDataFrame([], ingest.CANDIDATE)
    known, new = screening.ingest(sightings(spark, BATCH), brands, allowlist, empty, now())
    got = {r["domain"]: r for r in new.collect()}
    assert known.count() == 0 and set(got) == {"hdfcbank-login.com", "paytm-kyc.in"}
    assert got["hdfcbank-login.com"]["cert_issuer"] == "B" and got["paytm-kyc.in"]["cert_issuer"] is None
    assert got["paytm-kyc.in"]["publish_state"] == "hidden" and (got["paytm-kyc.in"]["next_recheck_at"] - got["paytm-kyc.in"]["created_at"]).seconds == 360
    again, fresh = screening.ingest(sightings(spark, BATCH), brands, allowlist, new, now())
    assert fresh.count() == 0 and {r["times_seen"] for r in again.collect()} == {2}


@pytest.mark.parametrize(("rows", "want"), [([None, "2025-01-01"], 0), (["2025-01-02", "2025-01-01"], 1), (["2025-01-01", None], 0), (["2025-01-01", "2025-01-01"], 0)])
def test_earliest(spark, rows, want):
    df = spark.createDataFrame([("k", i, t) for i, t in enumerate(rows)], "k string, o int, t string")
    assert [r["o"] for r in ranking.earliest_in_batch(df, ["k"], "t", "o").collect()] == [want]


def test_upsert_and_counters(spark):
    old = spark.createDataFrame([(1, "a", 10), (2, "b", 20)], "k int, v string, n int")
    delta = spark.createDataFrame([(2, None), (3, "c")], "k int, v string")
    assert sorted(tuple(r) for r in state.upsert(old, delta, "k").collect()) == [(1, "a", 10), (2, None, 20), (3, "c", None)]
    added = state.accumulate(old.select("k", "n"), spark.createDataFrame([(2, 5), (2, 1), (9, 4)], "k int, n int"), "k", ["n"])
    assert sorted(tuple(r) for r in added.collect()) == [(1, 10), (2, 26), (9, 4)]


def test_refresh_issuer(spark, brands, allowlist):
    _, new = screening.ingest(sightings(spark, BATCH), brands, allowlist, spark.createDataFrame([], ingest.CANDIDATE), now())
    seen = spark.createDataFrame([("hdfcbank-login.com", None, None)], "domain string, issuer string, logged_at timestamp")
    issuer = lambda keep: {r["domain"]: r["cert_issuer"] for r in state.refresh_seen(new, seen, now(), keep).collect()}["hdfcbank-login.com"]
    assert issuer(False) is None and issuer(True) == "B"


@pytest.mark.parametrize(("resolves", "count", "tier", "want"), [
    (False, 12, "low", (13, "verified", 24)), (False, 13, "low", (14, "retired", 24)), (False, 13, "medium", (14, "verified", 24)), (True, 9, "low", (0, "verified", 48)), (True, 9, "high", (0, "verified", 6)), (None, 0, "low", (1, "verified", 24)),
])
def test_schedule(spark, resolves, count, tier, want):
    df = spark.createDataFrame([(resolves, count, tier, "hidden")], "resolves boolean, recheck_count int, tier string, publish_state string")
    r = state.after_recheck(df, now()).withColumn("h", (F.unix_timestamp("next_recheck_at") - F.unix_timestamp(now())) / 3600).first()
    assert (r["recheck_count"], r["status"], r["h"]) == want


def test_review_reports_prune(spark):
    c = spark.createDataFrame([("1", "a.com", "b1", "pending_review", "verified"), ("2", "b.com", "b1", "published", "verified"), ("3", "c.com", "b2", "cleared", "retired")], "id string, domain string, matched_brand_id string, publish_state string, status string")
    c = c.withColumns({"reviewed_at": F.lit(None).cast("timestamp"), "reviewed_note": F.lit(None).cast("string")})
    after, allowed = state.review(c, spark.createDataFrame([("1", "clear", "fine", "me")], "id string, action string, note string, reviewer string"), now())
    got = {r["id"]: (r["publish_state"], r["status"], r["reviewed_note"]) for r in after.collect()}
    assert got == {"1": ("cleared", "retired", "fine"), "2": ("published", "verified", None), "3": ("cleared", "retired", None)}
    assert [(r["domain"], r["reason"]) for r in allowed.collect()] == [("a.com", "fine")]
    reports = spark.createDataFrame([("r1", "1", "dispute", "open", None, None), ("r2", "2", "dispute", "open", None, None), ("r3", None, "other", "open", None, None)], "id string, candidate_id string, kind string, status string, resolved_at timestamp, resolution string")
    assert {r["id"]: r["status"] for r in state.resolve_reports(reports, after.where("publish_state = 'cleared'"), now()).collect()} == {"r1": "resolved", "r2": "open", "r3": "open"}
    pruned = state.prune(c, spark.createDataFrame([("a.com",), ("a.com",)], "domain string"), now())
    assert {r["id"]: r["publish_state"] for r in pruned.collect()} == {"1": "pending_review", "2": "hidden", "3": "cleared"}


def test_reports_checked(spark):
    df = spark.createDataFrame([("dispute", "x" * 10, None), ("dispute", " short   ", None), ("bad", "x" * 20, None), ("other", "x" * 4001, None), ("other", "x" * 20, "c" * 201), (None, None, None)], "kind string, note string, contact string")
    assert [r["accepted"] for r in state.checked_reports(df).collect()] == [True, False, False, False, False, False]


def test_clamp():
    assert [ranking.clamp(x, 1, 200) for x in (float("nan"), -5, 3.9, 1e9, float("inf"))] == [1, 1, 3, 200, 1]


def test_round_robin(spark):
    df = spark.createDataFrame([(0, "g"), (1, "g"), (2, "c"), (3, "g"), (4, "d"), (5, "c")], "o int, op string")
    assert [r["o"] for r in ranking.round_robin(df, "op", "o", 5).collect()] == [0, 2, 4, 1, 5]


def test_round_robin_keeps_rows_without_group_and_columns(spark):
    df = spark.createDataFrame([(0, None, "x"), (1, None, "y"), (2, "c", "z")], "o int, op string, of string")
    rows = ranking.round_robin(df, "op", "o")
    assert [(r["o"], r["of"], r["depth"]) for r in rows.collect()] == [(0, "x", 1), (2, "z", 1), (1, "y", 2)]
    assert [r["o"] for r in ranking.round_robin(df, "op", "o", 2).collect()] == [0, 2]
    clash = spark.createDataFrame([("k", 1, 5, 7), ("k", 2, 6, 8), (None, 3, 1, 9)], "key string, tie int, at int, place int")
    assert sorted((r["tie"], r["place"]) for r in ranking.history(clash, "key", "at", "tie", 1).collect()) == [(2, 8), (3, 9)]


def test_page_and_listing(spark):
    df = spark.range(30)
    assert [tuple(r) for r in ranking.page_with_total(df, [F.desc("id")], 2, 3).collect()] == [(27, 30), (26, 30), (25, 30)]
    assert ranking.page_with_total(df.limit(0), [F.desc("id")]).count() == 0
    brands = spark.createDataFrame([("b", "x", True), ("a", "y", True), ("c", "x", False)], "name string, category string, active boolean")
    assert [r["name"] for r in ranking.brand_listing(brands).collect()] == ["b", "a"]


def test_accumulate_keeps_columns(spark):
    held = spark.createDataFrame([("a", 1, "x", 9), ("b", None, "y", 8)], "k string, n long, label string, n_added int")
    got = state.accumulate(held, spark.createDataFrame([("b", 2), ("c", 3), ("b", 1)], "k string, n long"), "k", ["n"])
    assert got.columns == held.columns and sorted(tuple(r) for r in got.collect()) == [("a", 1, "x", 9), ("b", 3, "y", 8), ("c", 3, None, None)]


def test_clear_needs_a_reason(spark):
    rows = spark.createDataFrame([("1", "a.com", "b", "published", "verified")], "id string, domain string, matched_brand_id string, publish_state string, status string").withColumns({"reviewed_at": F.lit(None).cast("timestamp"), "reviewed_note": F.lit(None).cast("string")})
    for note, want in ((None, "published"), (" ab ", "published"), ("abc", "cleared")):
        after, allowed = state.review(rows, spark.createDataFrame([("1", "clear", note, "me")], "id string, action string, note string, reviewer string"), now())
        assert after.first()["publish_state"] == want and allowed.count() == (want == "cleared")
    decisions = spark.createDataFrame([("publish", None), ("drop", "abc"), (None, "abc"), ("clear", "abc")], "action string, note string")
    assert [r["accepted"] for r in state.checked_decisions(decisions).collect()] == [True, False, False, True]


def test_prefixes_and_lost_brands(spark):
    df = spark.createDataFrame([("test-a",), ("b",), (None,), ("test%",)], "d string")
    assert [r["d"] for r in state.with_prefix(df, "d", "test-").collect()] == ["test-a"]
    assert [r["d"] for r in state.without_prefix(df, "d", "test-").collect()] == ["b", None, "test%"]
    due = spark.createDataFrame([("1", "a.com", "b1"), ("2", "b.com", "gone"), ("3", "c.com", None)], "id string, domain string, matched_brand_id string")
    known, lost = screening.with_brands(due, spark.createDataFrame([("b1",)], "id string"))
    assert [r["id"] for r in known.collect()] == ["1"] and sorted(r["id"] for r in lost.collect()) == ["2", "3"]
    reports = spark.createDataFrame([(1, None, "open", 5), (2, "x", "open", 1), (3, None, "resolved", 1), (4, None, "open", 2)], "id int, candidate_id string, status string, created_at int")
    assert [r["id"] for r in views.orphan_reports(reports).collect()] == [4, 1]


def _tables(spark):
    c = spark.createDataFrame([("1", "published"), ("2", "hidden"), ("3", "pending_review")], "id string, publish_state string")
    for name, kind in (("domain", "string"), ("unicode_domain", "string"), ("matched_brand_id", "string"), ("matched_term", "string"), ("match_kind", "string"), ("homoglyph_flag", "boolean"), ("cert_issuer", "string"), ("cert_issued_at", "timestamp"), ("first_seen_at", "timestamp"), ("last_seen_at", "timestamp")):
        c = c.withColumn(name, F.lit("b" if name == "matched_brand_id" else None).cast(kind))
    brands = spark.createDataFrame([("b", "B", "b", "bank", [])], "id string, name string, slug string, category string, official_domains array<string>")
    scores = spark.createDataFrame([("s1", "1", 50, "medium", "2025-01-01"), ("s2", "1", 90, "high", "2025-01-02"), ("s3", "2", 99, "high", "2025-01-02")], "id string, candidate_id string, score int, tier string, computed_at string")
    scores = scores.withColumn("contributing_signals", F.array(F.struct(F.lit("k").alias("key"), F.lit(5).alias("points"), F.lit("name").alias("category"))))
    v = spark.createDataFrame([("v1", "1", True, 3, None, None, True, False, "2025-01-01")], "id string, candidate_id string, resolves boolean, domain_age_days int, registrar string, page_title string, has_password_field boolean, looks_parked boolean, checked_at string")
    return c, brands, scores, v


def test_feed_and_visibility(spark):
    c, brands, scores, v = _tables(spark)
    items = {r["id"]: r for r in views.feed_items(views.public_feed(c, brands, scores, v)).collect()}
    assert set(items) == {"1", "3"} and items["1"]["score"] == 90 and items["1"]["confirmed"] and items["1"]["brand"]["official_domain"] is None
    assert (items["3"]["score"], items["3"]["tier"], items["3"]["signals"], items["3"]["status"]) == (0, "medium", [], "unconfirmed")
    seen = views.visible_to("anon", {"candidates": c, "brands": brands, "risk_scores": scores, "verifications": v, "allowlist": brands, "reports": brands})
    assert {k: d.count() for k, d in seen.items()} == {"candidates": 2, "brands": 1, "risk_scores": 2, "verifications": 1, "allowlist": 0, "reports": 0}
    assert views.visible_to("service", {"reports": brands})["reports"].count() == 1


def test_recheck_and_counters(spark):
    due = spark.createDataFrame([("1", "hdfcbank-login.com", "exact_token", 0, "hidden", 0)], "id string, domain string, match_kind string, edit_distance int, publish_state string, recheck_count int")
    due = due.withColumns({"homoglyph_detail": F.struct(F.lit(False).alias("mixed_script")), "cert_issued_at": now(), "cert_issuer": F.lit("O=ZeroSSL"), "status": F.lit("new"), "next_recheck_at": now()})
    checks = spark.createDataFrame([("1", True, True, 1, True, ["hdfcbank"], True, False, None)], "candidate_id string, resolves boolean, has_mx boolean, domain_age_days int, has_password_field boolean, brand_terms_on_page array<string>, form_posts_offsite boolean, looks_parked boolean, asn_reputation_score int")
    checks = checks.withColumn("domain_created_at", now() - F.make_dt_interval(days=F.lit(1)))
    after, scores = screening.recheck(due, checks, now())
    assert after.first()["publish_state"] == "published" and scores.first()["tier"] == "high"
    assert tuple(screening.recheck_counters(due, after).first()) == (1, 1, 1, 0, 0)


def test_relative_time(spark):
    df = spark.createDataFrame([("2025-06-01 11:59:30",), ("2025-06-01 11:58:59",), ("2025-06-01 10:00:00",), ("2025-05-30 12:00:00",), ("2025-03-01 12:00:00",), ("2023-01-01 12:00:00",), (None,), ("2026-01-01 00:00:00",)], "t string")
    assert [r["x"] for r in df.select(views.relative_time(F.col("t").cast("timestamp"), now()).alias("x")).collect()] == ["just now", "1 minute ago", "2 hours ago", "2 days ago", "3 months ago", "2 years ago", "unknown", "just now"]
