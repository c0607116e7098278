import base64
import json
import struct

import pytest
from pyspark.sql import functions as F

from namelens.sources import certificates, logs, lookups, watchlist


def der(tag: int, value: bytes) -> bytes:
    n = len(value)
    size = bytes([n]) if n < 128 else bytes([0x82]) + n.to_bytes(2, "big")
    return bytes([tag]) + size + value


def certificate(names: list[str], critical: bool = False) -> bytes:
    every = b"".join(der(0x82, n.encode("latin1")) for n in names)
    return b"\x30\x82junk" + bytes.fromhex("0603551d11") + (b"\x01\x01\xff" if critical else b"") + der(0x04, der(0x30, every)) + b"tail"


def leaf(body: bytes, kind: int = 0, ms: int = 1_700_000_000_000) -> str:
    return base64.b64encode(b"\0\0" + struct.pack(">QH", ms, kind) + (b"h" * 32 if kind == 1 else b"") + len(body).to_bytes(3, "big") + body).decode()


def test_names():
    assert certificates.dns_names(certificate(["a.com", "*.b.org", "no-dot", "bad name.com", "x.y"])) == ["a.com", "*.b.org"]
    assert certificates.dns_names(certificate(["a.com"] * 200, critical=True)) == ["a.com"] * 200
    assert certificates.dns_names(certificate([f"{i}.com" for i in range(6000)])) == [n for n in (f"{i}.com" for i in range(5000)) if len(n) >= 4]
    whole = certificate(["good.com"])
    for cut in range(len(whole)):
        assert all(n == "good.com" for n in certificates.dns_names(whole[:cut]))


def test_leaves(spark):
    rows = [("l/", 0, leaf(certificate(["A.com", "*.a.com"]))), ("l/", 1, leaf(certificate(["b.com"]), 1)), ("l/", 2, "????"), ("l/", 3, leaf(certificate(["a.com"]))), ("l/", 4, leaf(b"x", 7)), ("l/", 5, None)]
    entries = spark.createDataFrame(rows, "log_url string, idx long, leaf_input string")
    got = {(r["ord"], r["name"]) for r in certificates.sightings(entries).collect()}
    assert got == {(0, "a.com"), (1, "b.com")}
    assert tuple(certificates.scan_totals(entries).select("entries", "names", "unparsed").first()) == (6, 4, 3)


def test_start_index(spark):
    df = spark.createDataFrame([(0, 10_000), (500, 600), (700, 600), (0, 100), (1, 1_000_000)], "c long, h long")
    at, skipped = certificates.start_index(F.col("c"), F.col("h"), 300_000)
    assert [tuple(r) for r in df.select(at, skipped).collect()] == [(8000, 0), (500, 0), (0, 0), (0, 0), (700_000, 699_999)]


def test_log_list(spark):
    body = {"operators": [{"name": "G", "logs": [{"url": "https://a", "state": {"usable": {}}}, {"url": "https://b/", "state": {"retired": {}}}]}, {"logs": [{"url": "https://c/", "description": "C", "state": {"usable": {}}}]}]}
    got = [tuple(r) for r in certificates.usable_logs(spark.createDataFrame([(json.dumps(body),)], "json string")).orderBy("ord").select("url", "description", "operator").collect()]
    assert got == [("https://a/", "https://a", "G"), ("https://c/", "C", "unknown")]


def test_search_rows(spark):
    rows = [
        (0, "C=US, O=Let's Encrypt, CN=R3", "hdfcbank-secure.com", "hdfcbank-secure.com\n*.hdfcbank-secure.com\n www.hdfcbank-secure.com", "2025-06-01T10:00:00", "2025-06-01T09:00:00"),
        (1, "CN=Google Trust Services LLC", "paytm-verify.in", "paytm-verify.in", "2025-06-01T07:00:00.123", None), (2, "O=Let's Encrypt", "old.com", "old.com", "2025-05-20T00:00:00", None),
        (3, "O=Other", "hdfcbank-secure.com", None, "2025-06-01T11:00:00Z", None), (4, None, "undated.com", None, None, "bad"),
    ]
    df = spark.createDataFrame(rows, "ord long, issuer_name string, common_name string, name_value string, entry_timestamp string, not_before string")
    got = {r["name"]: r for r in lookups.search_sightings(df, F.to_timestamp(F.lit("2025-06-01 12:00:00")), 24).collect()}
    assert set(got) == {"hdfcbank-secure.com", "www.hdfcbank-secure.com", "paytm-verify.in", "undated.com"}
    assert got["hdfcbank-secure.com"]["issuer"] == "Let's Encrypt" and got["hdfcbank-secure.com"]["logged_at"].hour == 10
    assert got["paytm-verify.in"]["issuer"] == "Google Trust Services LLC" and got["undated.com"]["issuer"] is None


def test_registration(spark):
    vcard = ["vcard", [["version", {}, "text", "4.0"], ["fn", {}, "text", "Reg Ltd"]]]
    body = {"events": [{"eventAction": "expiration", "eventDate": "2030-01-01T00:00:00Z"}, {"eventAction": "registration", "eventDate": "2025-05-30T06:00:00Z"}], "status": ["active"], "entities": [{"roles": ["abuse"], "entities": [{"roles": ["registrar"], "vcardArray": vcard}]}]}
    iana = {"entities": [{"roles": ["registrar"], "publicIds": [{"type": "IANA Registrar ID", "identifier": "42"}]}]}
    df = spark.createDataFrame([(json.dumps(body),), (json.dumps(iana),), ("{",)], "j string")
    got = [r["r"].asDict() for r in df.select(lookups.registration(F.col("j"), F.to_timestamp(F.lit("2025-06-01 12:00:00"))).alias("r")).collect()]
    assert (got[0]["age_days"], got[0]["registrar"], got[0]["statuses"]) == (2, "Reg Ltd", ["active"])
    assert (got[1]["age_days"], got[1]["registrar"]) == (None, "IANA registrar 42")
    assert got[2]["registrar"] is None


def test_services_and_servers(spark):
    boot = {"services": [[["com", "NET"], ["http://a/", "https://b/"]], [["in"], ["http://in/"]], [["co.in"], ["https://co/"]]]}
    services = lookups.service_urls(spark.createDataFrame([(json.dumps(boot),)], "json string"))
    names = spark.createDataFrame([("a.com",), ("b.co.in",), ("c.in",), ("d.xyz",)], "domain string")
    assert {r["domain"]: r["service_url"] for r in lookups.with_service(names, services).collect()} == {"a.com": "https://b/", "b.co.in": "https://co/", "c.in": "http://in/", "d.xyz": None}
    rows = spark.createDataFrame([(["1.2.3.4"], None, None, ["ns"], None, None), (None, None, None, None, "ENOTFOUND", "ENOTFOUND"), (None, None, ["m"], None, "ETIMEOUT", "ETIMEOUT")], "a array<string>, b array<string>, m array<string>, n array<string>, ac string, nc string")
    got = [(r["d"]["resolves"], r["d"]["has_mx"], r["d"]["error"]) for r in rows.select(lookups.name_servers(*(F.col(c) for c in rows.columns)).alias("d")).collect()]
    assert got == [(True, False, None), (False, False, None), (False, True, "ETIMEOUT")]
    may = spark.createDataFrame([(["8.8.8.8"],), (["10.0.0.1", "8.8.8.8"],), ([],)], "a array<string>").select(lookups.may_fetch(F.col("a")).alias("m")).collect()
    assert [r["m"] for r in may] == [True, False, False]


def test_recorded_logs(spark, tmp_path):
    for log, n in (("one", 5), ("two", 3)):
        (tmp_path / "logs" / log).mkdir(parents=True)
        for first in range(0, n, 2):
            lines = [json.dumps({"leaf_input": leaf(certificate([f"{log}{i}.com"]))}) for i in range(first, min(n, first + 2))]
            (tmp_path / "logs" / log / f"{first:08d}.jsonl").write_text("\n".join(lines) + "\n")
    spark.dataSource.register(logs.RecordedLogs)
    batch = spark.read.format("recorded_logs").option("path", str(tmp_path / "logs")).load()
    assert sorted((r["log_url"], r["idx"]) for r in batch.collect()) == [("one", i) for i in range(5)] + [("two", i) for i in range(3)]
    stream = spark.readStream.format("recorded_logs").option("path", str(tmp_path / "logs")).option("per_trigger", 2).load()
    query = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).start()
    query.processAllAvailable()
    query.stop()
    assert {r["name"] for r in certificates.sightings(spark.read.parquet(str(tmp_path / "out"))).collect()} == {f"one{i}.com" for i in range(5)} | {f"two{i}.com" for i in range(3)}


def test_recorded_logs_by_file(spark, tmp_path):
    (tmp_path / "logs" / "one").mkdir(parents=True)
    for first in range(0, 40, 10):
        lines = [json.dumps({"leaf_input": leaf(certificate([f"n{i}.com"]))}) for i in range(first, first + 10)]
        (tmp_path / "logs" / "one" / f"{first:08d}.jsonl").write_text("\n".join(lines) + "\n")
    spark.dataSource.register(logs.RecordedLogs)
    read = lambda start: spark.read.format("recorded_logs").option("path", str(tmp_path / "logs")).option("start", start).load()
    assert read(0).rdd.getNumPartitions() == 4 and sorted(r["idx"] for r in read(15).collect()) == list(range(15, 40)) and read(15).rdd.getNumPartitions() == 3
    with pytest.raises(Exception, match="no log has entries from 40 on"):
        read(40).collect()
    reader = logs.RecordedLogs({"path": str(tmp_path / "logs"), "per_trigger": "7"}).streamReader(None)
    at = lambda: {log: o["next"] for log, o in reader.latestOffset().items()}
    assert reader.initialOffset()["one"]["next"] == 0 and at() == {"one": 7} and at() == {"one": 14}
    reader.now["one"]["next"] = 99  # a cursor beyond the head
    assert at() == {"one": 7}


def test_start_at_agrees_with_columns(spark):
    rows = [(c, h, lag) for c in (0, 5, 2500, 9000) for h in (0, 100, 5000) for lag in (0, 10, 3000)]
    at, skipped = certificates.start_index(F.col("c"), F.col("h"), F.col("lag"))
    got = [tuple(r) for r in spark.createDataFrame(rows, "c long, h long, lag long").select(at, skipped).collect()]
    assert got == [certificates.start_at(*r) for r in rows]


def test_kept_names(spark):
    entries = spark.createDataFrame([("l/", 0, leaf(certificate(["keep.com", "drop.com"])))], "log_url string, idx long, leaf_input string")
    assert [r["name"] for r in certificates.sightings(entries, lambda n: F.startswith(n, F.lit("keep"))).collect()] == ["keep.com"]


def test_watchlist(spark):
    rows = [(0, "HDFC Bank", "hdfc", "bank", ["hdfcbank.com"], [], ["netHDFC"], [], True), (1, "X", "x", "other", ["x.in"], None, None, None, False)]
    brands = watchlist.with_terms(spark.createDataFrame(rows, watchlist.BRAND)).withColumn("last_polled_at", F.lit(None).cast("timestamp"))
    assert brands.orderBy("ord").first()["match_terms"] == ["hdfcbank", "nethdfc"]
    assert [r["term"] for r in watchlist.scanner_terms(brands).collect()] == ["hdfcbank", "nethdfc"]
    assert [r["terms"] for r in watchlist.poll_round(brands, 3).collect()] == [["hdfcbank", "nethdfc"]]


def test_seed(spark):
    from namelens.sources import seed

    brands = seed.brands(spark)
    terms = {r["slug"]: r["match_terms"] for r in brands.collect()}
    assert len(terms) == 26 and seed.allowlist(spark).where("brand_id IS NOT NULL").count() == 26
    assert "canara" not in terms["canara-bank"] and "canaranetbanking" in terms["canara-bank"] and "npciupi" not in terms["npci-upi"]
    assert all(list(map(len, t)) == sorted(map(len, t), reverse=True) for t in terms.values())
    assert seed.allowlist(spark, brands.where("slug <> 'sbi'")).where("brand_id IS NULL").count() == 3
