"""Answers of the endpoints: shapes, paging, guards, ties, nulls, empty tables."""

import json

import pytest
from pyspark.sql import functions as F

from namelens import constants as C
from namelens.plans import answers, jobs, views

CANDIDATE = "id bigint, domain string, unicode_domain string, matched_brand_id bigint, matched_term string, match_kind string, edit_distance int, homoglyph_flag boolean, cert_issuer string, cert_issued_at timestamp, first_seen_at string, last_seen_at timestamp, publish_state string"
BRAND = "id bigint, name string, slug string, category string, official_domains array<string>, aliases array<string>, active boolean"
SCORE = "id bigint, candidate_id bigint, computed_at string, score int, tier string, contributing_signals array<struct<key:string,points:int>>"
CHECK = "id bigint, candidate_id bigint, checked_at string, resolves boolean, domain_age_days int, registrar string, page_title string, has_password_field boolean, looks_parked boolean"


def candidate(id_, state="published", seen="2025-01-01 00:00:00", brand=1):
    return (id_, f"d{id_}.com", None, brand, "acme", "substring", 0, False, None, None, seen, None, state)


def tables(spark, candidates, scores=(), checks=()):
    brands = [(1, "Acme", "acme", "bank", ["acme.com"], [], True), (2, "Zed", "zed", "other", [], ["z"], False)]
    time = lambda df, c: df.withColumn(c, F.to_timestamp(c))
    return (
        time(spark.createDataFrame(list(candidates), CANDIDATE), "first_seen_at"), spark.createDataFrame(brands, BRAND),
        time(spark.createDataFrame(list(scores), SCORE), "computed_at"), time(spark.createDataFrame(list(checks), CHECK), "checked_at"),
    )


SCORES = [(1, 1, "2025-01-01 00:00:00", 10, "low", []), (2, 1, "2025-01-01 00:00:00", 90, "high", [("k", 5)]), (3, 2, "2025-01-01 00:00:00", 99, "high", None)]
CANDIDATES = [candidate(1), candidate(2, "pending_review"), candidate(3, "hidden"), candidate(4, seen=None), candidate(5, brand=2), candidate(6, brand=9), candidate(7, brand=None), candidate(8, seen="2025-02-01 00:00:00")]


def ids(row):
    return [i["id"] for i in row["items"]]


def test_feed_page(spark):
    t = tables(spark, CANDIDATES, SCORES, [(i, 1, f"2025-01-{i:02} 00:00:00", True, i, "r", None, i == 9, False) for i in range(1, 10)])
    row = answers.feed_page(*t).first()
    assert (ids(row), row["total"], row["limit"], row["offset"]) == ([4, 8, 1, 2, 5], 5, C.PAGE_SIZE, 0)
    item = row["items"][2]
    assert (item["score"], item["tier"], item["confirmed"], item["statusLabel"], item["hasPasswordField"], item["domainAgeDays"], item["brand"]["officialDomain"]) == (90, "high", True, "High confidence", True, 9, "acme.com")
    new = row["items"][0]
    assert (new["score"], new["tier"], new["signals"], new["resolves"], new["confirmed"], new["statusLabel"]) == (0, "medium", [], None, False, "Unconfirmed - under review")
    assert (row["items"][3]["confirmed"], row["items"][3]["statusLabel"], row["items"][4]["brand"]["officialDomain"]) == (False, "Unconfirmed - under review", None)
    page = lambda **k: answers.feed_page(*t, **k).first()
    assert ids(page(brand="zed")) == [5] and ids(page(category="bank")) == [4, 8, 1, 2] and ids(page(tier="medium")) == [2]
    assert ids(page(tier="high", brand="acme")) == [4, 8, 1] and ids(page(tier="odd")) == ids(row) and ids(page(brand="nobody")) == []
    assert (ids(page(limit=2, offset=1)), page(limit=2, offset=1)["total"]) == ([8, 1], 5)
    last = page(limit=-3, offset=99)
    assert (last["items"], last["total"], last["limit"], last["offset"]) == ([], 5, 1, 99)
    assert (page(limit=10**6)["limit"], page(limit=float("nan"))["limit"]) == (C.MAX_PAGE_SIZE, 1)


def test_feed_page_as_json(spark):
    text = jobs.as_json(answers.feed_page(*tables(spark, [candidate(1)]))).first()["json"]
    item = json.loads(text)["items"][0]
    assert item["lastCheckedAt"] is None and item["brand"]["slug"] == "acme" and "unicodeDomain" in item and item["editDistance"] == 0


def test_page_ranks_only_its_rows(spark, capsys):
    answers.feed_page(*tables(spark, CANDIDATES, SCORES)).explain("formatted")
    plan = capsys.readouterr().out
    assert "TakeOrderedAndProject" in plan and "BroadcastHashJoin LeftSemi" in plan


def test_records(spark):
    checks = [(i, 1, None if i == 30 else "2025-01-01 00:00:00" if i < 3 else f"2025-01-{i:02} 00:00:00", True, i, None, None, False, False) for i in range(1, 31)]
    checks += [(99, 3, "2025-01-01 00:00:00", True, 1, None, None, True, False)]
    t = tables(spark, CANDIDATES, SCORES, checks)
    asked = spark.createDataFrame([(1,), (1,), (2,), (3,), (77,), (None,)], "id bigint")
    rows = answers.candidate_records(asked, *t).collect()
    assert len(rows) == 6
    got = {r["id"]: r for r in rows}
    assert [h["domain_age_days"] for h in got[1]["history"]] == list(range(29, 9, -1)) and got[1]["item"]["domainAgeDays"] == 29
    assert (got[2]["history"], got[2]["error"], got[2]["item"]["score"]) == ([], None, 99)
    tied = answers.candidate_records(asked.where("id = 2").distinct(), *tables(spark, CANDIDATES, (), [(i, 2, "2025-01-01 00:00:00", True, i, None, None, False, False) for i in (5, 100, 20)])).first()
    assert [h["domain_age_days"] for h in tied["history"]] == [100, 20, 5]
    for i in (3, 77, None):
        assert tuple(got[i]) == (i, "not_found", None, None, None)
    assert answers.candidate_records(asked.limit(0), *t).count() == 0


def test_queues(spark):
    pending = [candidate(i, "pending_review") for i in (1, 2, 3, 4)] + [candidate(5)]
    t = tables(spark, pending, [(i, i, "2025-01-01 00:00:00", s, "medium", []) for i, s in ((1, 50), (2, 60), (3, 60))])
    row = answers.review_queue(*t).first()
    assert (row["queue"], row["count"], ids(row)) == ("candidates", 4, [4, 2, 3, 1])
    assert ids(answers.review_queue(*t, n=2).first()) == [4, 2]
    reports = spark.createDataFrame([(1, "open", "2025-01-02"), (2, "open", "2025-01-01"), (3, "resolved", "2025-01-01"), (4, "open", None)], "id bigint, status string, created_at string")
    row = answers.report_queue(reports).first()
    assert (row["queue"], row["count"], ids(row)) == ("reports", 3, [4, 2, 1])
    assert tuple(answers.report_queue(reports.limit(0)).first()) == ("reports", 0, [])


def test_report_rows(spark):
    reports = spark.createDataFrame([(1, 5, "open", "other", "2025-01-02"), (2, 5, "open", "dispute", "2025-01-03"), (3, 5, "resolved", "dispute", "2025-01-01"), (4, 6, "open", None, None), (5, None, "open", "dispute", None), (6, 7, "resolved", "dispute", None), (7, 5, "open", "other", "2025-01-02")], "id bigint, candidate_id bigint, status string, kind string, created_at string").withColumn("note", F.lit(""))
    rows = views.report_rows(spark.createDataFrame([(4,), (5,), (6,), (7,)], "id bigint"), reports).collect()
    assert [(r["id"], r["disputed"], r["report_id"]) for r in rows] == [(5, True, 1), (5, True, 7), (5, True, 2), (4, False, None), (6, False, 4), (7, False, None)]
    assert views.report_rows(spark.range(0), reports.limit(0)).count() == 0


def test_outcomes(spark):
    known = spark.createDataFrame([(1, "a.com"), (2, "b.com"), (3, "c.com")], "id bigint, domain string")
    reports = spark.createDataFrame([(1, "open"), (1, "open"), (1, "resolved"), (2, "open"), (None, "open")], "candidate_id bigint, status string")
    decisions = spark.createDataFrame([(1, "clear", "mine"), (2, "publish", None), (3, "clear", "x"), (9, "hide", None), (2, "drop", None), (None, "hide", None), (2, "", None), (3, "hide", "")], "id bigint, action string, note string")
    got = sorted((tuple(r) for r in answers.decision_outcomes(known, reports, decisions).collect()), key=str)
    required = "id and action are required"
    assert got == sorted([
        (1, True, None, "a.com", "cleared", True, 2), (2, True, None, "b.com", "published", False, 0), (3, False, "a reason is required to clear", None, None, None, None), (9, False, "candidate not found", None, None, None, None),
        (2, False, "action must be one of: publish, clear, hide", None, None, None, None), (None, False, required, None, None, None, None), (2, False, required, None, None, None, None), (3, True, None, "c.com", "hidden", False, 0),
    ], key=str)


@pytest.mark.parametrize(("settings", "rows", "ok", "reachable", "hint"), [({"a": True}, 3, True, True, "can be read."), ({"a": True}, 0, True, True, "is empty."), ({"a": True}, None, False, False, "can't be read."), ({"a": True, "b": False}, 3, False, None, "not set: b.")])
def test_health(spark, settings, rows, ok, reachable, hint):
    def read():
        return spark.range(rows) if rows is not None else spark.read.parquet("/nowhere/at/all")

    row = answers.health(spark, settings, read, F.to_timestamp(F.lit("2025-01-01 00:00:00"))).first()
    assert (row["ok"], row["database"]["reachable"]) == (ok, reachable) and row["hint"].endswith(hint)


def test_stats_and_watchlist(spark):
    t = tables(spark, CANDIDATES)
    row = answers.stats(t[0], t[1], F.to_timestamp(F.lit("2025-02-01 12:00:00"))).first()
    assert row.asDict() == {"highConfidence": 4, "underReview": 1, "seenLast24h": 1, "seenLast7d": 1, "brandsWatched": 1}
    assert [tuple(r) for r in answers.watchlist(t[1]).collect()] == [("Acme", "acme", "bank", ["acme.com"], [], True)]


def test_category_use(spark):
    kind = "signals array<struct<category:string,points:int>>"
    rows = spark.createDataFrame([([("name", 40), ("name", 4), ("name", -9)],), ([("mitigating", -5)],), ([],), (None,)], kind)
    got = {r["category"]: (r["most"], r["reached"]) for r in jobs.category_use(rows).collect()}
    assert got["name"] == (44, int(jobs.category_ceilings()["name"] <= 44)) and got["mitigating"] == (0, 0) and got["content"] == (0, 0)


def test_category_use_of_no_rows_and_in_one_pass(spark):
    rows = spark.createDataFrame([([("name", 40)],)] * 3, "signals array<struct<category:string,points:int>>")
    got = {r["category"]: (r["ceiling"], r["most"], r["reached"]) for r in jobs.category_use(rows.where("false")).collect()}
    assert got == {c: (n, 0, 0) for c, n in jobs.category_ceilings().items()}
    plan = jobs.category_use(rows)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate") < plan.index("Aggregate")  # categories part after the rows are added up
