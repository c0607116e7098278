"""Recorded fetches: guards, order of attempts, budget, content type, size; against a plain reading of the rules."""

import random

import pytest

from namelens.sources import fetches as f

TARGET = "id string, domain string, a_records array<string>, terms array<string>, deadline_ms bigint"
LOGIN = b"<title>Acme</title><form action='https://x.evil.com/p'><input type=password></form>" + b"y" * 1500


def run(spark, targets, rows, most=f.MOST_BYTES):
    out = f.checks(spark.createDataFrame(targets, TARGET), spark.createDataFrame(rows, f.FETCH), most)
    return {r["id"]: r["content"] for r in out.collect()}


def fetch(id_, scheme, status=200, kind="text/html", body=LOGIN, error=None, at=0, took=10, url=None):
    return (id_, scheme, at, took, status, kind, url, body, error)


def test_each_case(spark):
    ok = ["1.2.3.4"]
    targets = [(i, "shop.com", a, ["acme"], d) for i, a, d in (
        ("none", [], None), ("null", None, None), ("private", ["1.2.3.4", "10.0.0.1"], None), ("https", ok, None), ("http", ok, None), ("both fail", ok, None), ("late", ok, 5), ("late second", ok, 5_000),
        ("slow", ok, None), ("pdf", ok, None), ("no type", ok, None), ("unrecorded", ok, None), ("moved", ok, None), ("broken", ok, None),
    )]
    rows = [
        fetch("none", "https"), fetch("private", "https"), fetch("https", "https"), fetch("https", "http", body=b""), fetch("http", "https", None, error="tls"), fetch("http", "http", 404), fetch("both fail", "https", None, error="tls"),
        fetch("both fail", "http", None, error="refused"), fetch("late", "https", at=5), fetch("late second", "https", None, error="tls"), fetch("late second", "http", at=6_000), fetch("slow", "https", took=6_001),
        fetch("slow", "http", took=6_000), fetch("pdf", "https", kind="application/pdf"), fetch("no type", "https", kind=None), fetch("moved", "https", url="https://other.com/x"), fetch("broken", "https", body=b"<title>a\xff\xfeb</title>"),
    ]
    got = run(spark, targets, rows)
    assert len(got) == len(targets)
    errors = {k: v["error"] for k, v in got.items() if v["error"]}
    assert errors == {
        "none": f.NOT_RESOLVED, "null": f.NOT_RESOLVED, "private": f.PRIVATE, "both fail": "refused", "late": f.OVER_BUDGET, "late second": f.OVER_BUDGET, "unrecorded": f.NO_ANSWER,
    }
    assert {k for k, v in got.items() if not v["attempted"]} == {"none", "null", "private"}
    for k in errors:
        c = got[k]
        assert (c["http_status"], c["final_url"], c["page_title"], c["has_password_field"], c["brand_terms_on_page"], c["looks_parked"], c["content_risk_score"]) == (None, None, None, False, [], False, 0)
    assert (got["https"]["final_url"], got["https"]["has_password_field"], got["https"]["form_posts_offsite"], got["https"]["brand_terms_on_page"]) == ("https://shop.com/", True, True, ["acme"])
    assert (got["http"]["http_status"], got["http"]["final_url"]) == (404, "http://shop.com/")
    assert got["slow"]["final_url"] == "http://shop.com/" and got["moved"]["final_url"] == "https://other.com/x"
    assert (got["pdf"]["http_status"], got["pdf"]["has_password_field"], got["pdf"]["looks_parked"]) == (200, False, True)
    assert got["no type"]["has_password_field"] and got["broken"]["page_title"] == "a��b"


def test_only_the_first_bytes_are_read(spark):
    body = b"z" * 2000 + b"<input type=password>"
    for most, found in ((len(body), True), (len(body) - 1, True), (2010, False)):
        assert run(spark, [("a", "x.com", ["1.1.1.1"], None, None)], [fetch("a", "https", body=body)], most)["a"]["has_password_field"] is found
    cut = run(spark, [("a", "x.com", ["1.1.1.1"], None, None)], [fetch("a", "https", body="<title>é</title>".encode())], 8)["a"]
    assert cut["http_status"] == 200 and cut["page_title"] is None


@pytest.mark.parametrize("seed", range(3))
def test_against_the_rules(spark, seed):
    rng = random.Random(seed)
    targets, rows, want = [], [], {}
    for i in range(150):
        id_, deadline = str(i), rng.choice([None, 0, 3_000, 20_000])
        a = rng.choice([None, [], ["9.9.9.9"], ["9.9.9.9"], ["9.9.9.9"], ["192.168.0.1"]])
        targets.append((id_, "x.com", a, [], deadline))
        tries, at = {}, 0
        for scheme in ("https", "http"):
            kind = rng.choice(["ok", "ok", "error", "none"])
            took = rng.choice([10, 2_500, 7_000])
            if kind != "none":
                tries[scheme] = (at, took, kind)
                rows.append(fetch(id_, scheme, 200 if kind == "ok" else None, error=None if kind == "ok" else f"{scheme} failed", at=at, took=took))
            at += took
        if not a:
            want[id_] = (False, f.NOT_RESOLVED, None)
        elif a[0].startswith("192"):
            want[id_] = (False, f.PRIVATE, None)
        else:
            outcome = None
            for scheme in ("https", "http"):
                if scheme not in tries:
                    outcome = (True, f.NO_ANSWER, None)
                    continue
                at, took, kind = tries[scheme]
                room = 6_000 if deadline is None else min(6_000, deadline - at)
                if room <= 0:
                    outcome = (True, f.OVER_BUDGET, None)
                    break
                if took > room:
                    outcome = (True, f.TOO_SLOW, None)
                elif kind == "error":
                    outcome = (True, f"{scheme} failed", None)
                else:
                    outcome = (True, None, f"{scheme}://x.com/")
                    break
            want[id_] = outcome
    got = run(spark, targets, rows)
    assert {k: (v["attempted"], v["error"], v["final_url"]) for k, v in got.items()} == want


def test_empty_tables_clashing_columns_and_repeats(spark):
    assert run(spark, [], []) == {}
    from pyspark.sql import functions as F

    targets = spark.createDataFrame([("a", "x.com", ["1.1.1.1"], None, None)] * 2, TARGET).withColumns({c: F.lit(1) for c in ("held", "found", "page", "status", "body", "https")})
    out = f.checks(targets, spark.createDataFrame([fetch("a", "https", 200), fetch("a", "https", 500, at=9), fetch(None, "https"), fetch("a", "ftp", 1, at=-1)], f.FETCH))
    assert out.columns == [*targets.columns, "content"]
    assert [r["content"]["http_status"] for r in out.collect()] == [200, 200]
