import random
import re

import pytest
from conftest import data_dir
from pyspark.sql import functions as F

from namelens import constants as C
from namelens import queries, queries_more  # noqa: F401
from namelens.functions import content, domains, edit, folding
from namelens.operators import matching, prefilter, scoring
from namelens.sources import watchlist

BRANDS = [
    ("hdfc-bank", ["hdfcbank.com"], ["hdfcbank", "hdfc"]), ("sbi", ["sbi.co.in", "onlinesbi.sbi"], ["statebankofindia", "onlinesbi", "sbi"]),
    ("paytm", ["paytm.com"], ["paytm"]), ("uidai-aadhaar", ["uidai.gov.in"], ["uidai", "aadhaar"]),
]
ALLOWED = ["hdfcbank.com", "sbi.co.in", "paytm.com", "hdfclife.com"]
LIVE = dict(resolves=True, has_mx=True, domain_age_days=1, has_password_field=True, brand=True, form_posts_offsite=True, looks_parked=False)
DORMANT = dict(resolves=False, has_mx=False, domain_age_days=2, has_password_field=False, brand=False, form_posts_offsite=False, looks_parked=False)
PARKED = DORMANT | dict(resolves=True, domain_age_days=5, looks_parked=True)
BUSINESS = DORMANT | dict(resolves=True, has_mx=True, domain_age_days=2200)
GOLDEN = [
    ("hdfcbank.com", LIVE, None, None, None), ("hdfclife.com", BUSINESS, None, None, None), ("hdfcbank.zendesk.com", LIVE, None, None, None),
    ("occupied.com", LIVE, None, None, None), ("sbicapital-markets.example", DORMANT, None, None, None), ("newfintech-portal.com", DORMANT, None, None, None),
    ("hdfc-consulting.com", BUSINESS, None, "low", 26), ("hdfcbank-login.com", DORMANT, None, "medium", 46), ("paytm-rewards.xyz", PARKED, None, "medium", 45),
    ("xn--pytm-loa.com", DORMANT, None, "medium", 46), ("hdfcbank-secure-login.com", LIVE, "C=US, O=Let's Encrypt", "high", 100),
    ("onlinesbi-kyc-update.in", LIVE, "Let's Encrypt", "high", 100), ("hdfcbamk.com", LIVE, None, "high", 100),
]
MUST_PASS = "hdfcbank.xyz hdfcbank-login.com www.hdfcbank-secure.tk myhdfcbanknet.com onlinesbi-verify.co paytm-rewards.xyz aadhaar-update.in hdfcbamk.com paytmm.com xn--pytm-loa.com".split()
MUST_NOT = "joshnesbitt.co.uk google.com wikipedia.org occupied.com phon-repair.com consulting-group.net".split()
ONLY_SOUND = "hdfxbamk.com p4ytm-login.com 5bi-x.com".split()


def names(spark, values):
    return spark.createDataFrame([(v,) for v in values], "name string")


@pytest.fixture(scope="module")
def brands(spark):
    return watchlist.brands_of(spark, BRANDS)


def test_golden_cases(spark, brands):
    allowed = spark.createDataFrame([(d,) for d in ALLOWED], "domain string")
    rows = [(n, *(v[k] for k in LIVE), issuer) for n, v, issuer, _, _ in GOLDEN]
    checks = spark.createDataFrame(rows, "name string, resolves boolean, has_mx boolean, domain_age_days int, has_password_field boolean, brand boolean, form_posts_offsite boolean, looks_parked boolean, cert_issuer string")
    found = matching.best_matches(checks.select("name"), brands, allowed)
    day = F.to_timestamp(F.lit("2025-06-01"))
    joined = found.join(checks, F.col("domain") == F.col("name")).withColumns({
        "mixed_script": F.col("homoglyph_detail.mixed_script"), "cert_issued_at": day, "domain_created_at": day - F.make_dt_interval(days="domain_age_days"),
        "brand_terms_on_page": F.when(F.col("brand"), F.array("matched_term")), "asn_reputation_score": F.lit(None).cast("int"),
    })
    got = {r["domain"]: (r["tier"], r["score"]) for r in scoring.scored(joined).collect()}
    assert got == {n: (tier, score) for n, _, _, tier, score in GOLDEN if tier}


def test_kinds(spark, brands):
    values = ["hdfcbank.xyz", "myhdfcbanknet.com", "myhdfcbanklogin-login.com", "hdfcbnak.com", "xn--pytm-loa.com", "my-kyc-onlinesbix.com", "uidaix.com", "hdfcbank.com"]
    got = {r["domain"]: (r["match_kind"], r["edit_distance"], r["matched_term"]) for r in matching.best_matches(names(spark, values), brands).collect()}
    assert got == {
        "hdfcbank.xyz": ("exact_token", 0, "hdfcbank"), "myhdfcbanknet.com": ("substring", 0, "hdfcbank"), "myhdfcbanklogin-login.com": ("keyword_combo", 0, "hdfcbank"),
        "hdfcbnak.com": ("edit_distance", 1, "hdfcbank"), "xn--pytm-loa.com": ("homoglyph", 0, "paytm"), "my-kyc-onlinesbix.com": ("keyword_combo", 0, "onlinesbi"),
    }


def _brute(name, terms):
    """The kind and distance of a plain ASCII label against each term."""
    label = name.partition(".")[0]
    folded = folding.fold_text(label)["folded"]
    tokens = [t for t in "".join(c if c.isalnum() else " " for c in folded).split()]
    flat = "".join(tokens)
    out = {}
    for t in terms:
        if t in tokens or flat == t:
            out[t] = ("exact_token", 0)
        elif len(t) >= 5 and t not in C.TOKEN_ONLY_TERMS and t in flat:
            out[t] = ("substring", 0)
        elif len(t) >= 6:
            d = min((edit.alignment_distance(p, t, 2) for p in {flat, *tokens} - set(C.STOP_PROBES)), default=3)
            if 1 <= d <= 2:
                out[t] = ("edit_distance", d)
    return out


def test_pairs_against_brute_force(spark, brands):
    r = random.Random(4)
    terms = [t for _, _, every in BRANDS for t in every]
    made = set()
    for _ in range(250):
        t = list(r.choice(terms))
        for _ in range(r.randint(0, 3)):
            i = r.randrange(len(t))
            t[i : i + r.randint(0, 1)] = r.choice("abcdefghilmnoprst015")
        made.add("".join(t) + r.choice(["", "-login", "x", "-pay", "bank"]) + ".com")
    made = sorted(n for n in made if "--" not in n and not n.startswith("-"))
    got = {}
    for x in matching.candidate_pairs(matching.screened(names(spark, made)), matching.explode_terms(brands)).collect():
        got.setdefault(x["domain"], {})[x["term"]] = (x["kind"], x["distance"])
    assert got == {n: b for n in made if (b := _brute(n, terms))}


@pytest.mark.parametrize("mode", ["compat", "sound"])
def test_prefilter(spark, mode):
    terms = [t for _, _, every in BRANDS for t in every]
    got = {r["name"] for r in prefilter.interesting(names(spark, MUST_PASS + MUST_NOT + ONLY_SOUND), terms, mode).collect()}
    assert set(MUST_PASS) <= got and not set(MUST_NOT) & got
    assert set(ONLY_SOUND) <= got if mode == "sound" else not set(ONLY_SOUND) & got


def test_sound_filter_keeps_all_matches(spark, brands):
    r = random.Random(9)
    values = sorted({"".join(r.sample(t, len(t)) if r.random() < 0.1 else t[: i] + r.choice("abcdt") + t[i + r.randint(0, 1) :]) + ".com" for _, _, every in BRANDS for t in every for i in range(len(t))})
    matched = {r["domain"] for r in matching.best_matches(names(spark, values), brands).collect()}
    passed = {r["name"] for r in prefilter.interesting(names(spark, values), [t for _, _, every in BRANDS for t in every], "sound").collect()}
    assert matched and matched <= passed


def test_empty(spark, brands):
    assert matching.best_matches(names(spark, []), brands).count() == 0
    assert matching.best_matches(names(spark, ["a.com"]), watchlist.brands_of(spark, BRANDS).where("false")).count() == 0
    assert prefilter.interesting(names(spark, ["a.com"]), []).count() == 0


def test_weights():
    w = C.WEIGHTS
    name = w["name.homoglyphNonAscii"] + w["name.phishingKeyword"] + w["name.mixedScript"]
    assert name < C.TIER_MEDIUM < C.TIER_HIGH
    assert all(v < 0 for k, v in w.items() if k in C.MITIGATING)
    assert all(v >= 0 for k, v in w.items() if k not in C.MITIGATING)
    assert set(C.STRONG_SIGNALS) <= set(w)


def test_gates(spark):
    rows = spark.createDataFrame([(80, False, ["name", "content"], ["content.passwordField"]), (80, True, ["content"], ["content.passwordField"]), (80, True, ["name", "content"], ["x"]), (80, True, ["name", "content"], ["content.passwordField"]), (50, True, ["name"], ["x"]), (10, True, [], ["x"])], "s int, r boolean, c array<string>, k array<string>")
    tier, note = scoring.gated(F.col("s"), F.col("r"), F.col("c"), F.col("k"))
    got = [(r["t"], r["n"]) for r in rows.select(tier.alias("t"), note.alias("n")).collect()]
    few = "Held below high confidence: only 1 independent kind of evidence (content). High confidence needs at least 2."
    assert got == [("medium", C.GATE_NOTES["dead"]), ("medium", few), ("medium", C.GATE_NOTES["weak"]), ("high", None), ("medium", None), ("low", None)]
    states = rows.select(scoring.publish_state(F.lit("high"), F.lit("cleared")).alias("x")).first()["x"]
    assert states == "cleared"


def test_legitimate_pages_have_no_strong_signal(spark):
    page = "<html><title>Bakery</title><form action='/order'><input name=email></form>" + "x" * 2000
    got = spark.createDataFrame([(page,)], "h string").select(content.has_password_field(F.col("h")).alias("p")).first()["p"]
    assert got is False


@pytest.mark.parametrize("name", ["signal_score", "signal_split", "gate_notes", "signal_labels"])
def test_scores_and_signals_are_compiled(spark, name):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = queries.QUERIES[name](spark, data_dir("sf0.001"))._jdf.queryExecution()
        steps = [line for line in plan.optimizedPlan().toString().splitlines() if " Project [" in line or line.startswith("Project [")]
        lists = [line for line in steps if "Uses look-alike" in line]
        # the list of signals is made in one step, and no lambda reads it there; nothing else needs one
        assert len(lists) == (name != "signal_score")
        assert all("concat(CASE WHEN (match_kind" in line and "gate.note" not in line and ".points" not in line and ".label" not in line for line in lists)
        assert not any("aggregate(" in line or "filter(array" in line for line in steps)
        code = spark._jvm.org.apache.spark.sql.execution.debug.__getattr__("package$").__getattr__("MODULE$").codegenString(plan.executedPlan())
        sizes = [int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", code)]
        assert sizes and max(sizes) < 8000  # longer methods are left uncompiled by the JVM
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_has_keyword_is_keyword_hits(spark):
    words = ["login", "LOGINS", "my-login.com", "mylogin.com", "payses", "pays", "payes", "paymentss", "kyc_otp", "é-kyc", "ékycé", "kyc1", "1kyc", "", "-", "cares", "bonus", "bonuses", "bonu", "reactivations-x", "x\nlogin", "authenticate", None]
    rows = spark.createDataFrame([(w,) for w in words], "w string")
    got = rows.select("w", (F.size(domains.keyword_hits(domains.tokenize(F.col("w")))) > 0).alias("want"), domains.has_keyword(F.col("w")).alias("got")).collect()
    assert [(r["w"], r["got"]) for r in got] == [(r["w"], r["want"] if r["w"] is not None else None) for r in got]


def test_scored_row_of_nulls_and_own_columns(spark):
    kinds = {"edit_distance": "int", "mixed_script": "boolean", "resolves": "boolean", "has_mx": "boolean", "domain_age_days": "int", "domain_created_at": "timestamp", "cert_issued_at": "timestamp", "has_password_field": "boolean", "brand_terms_on_page": "array<string>", "form_posts_offsite": "boolean", "looks_parked": "boolean", "asn_reputation_score": "int"}
    rows = spark.createDataFrame([{}], ", ".join(f"{c} {kinds.get(c, 'string')}" for c in scoring.INPUT))
    mine = rows.withColumns({"found": F.lit("mine"), "points_name": F.lit(7)})
    full = mine.withColumns({"match_kind": F.lit("homoglyph"), "has_mx": F.lit(True), "domain_age_days": F.lit(1), "has_password_field": F.lit(True), "cert_issuer": F.lit("C=US, O=Let's Encrypt"), "domain": F.lit("a-kyc.com"), "looks_parked": F.lit(True)})
    for notes in (False, True):
        empty, dead = (scoring.scored(df, notes).first() for df in (mine, full))
        assert (empty["score"], empty["categories"], empty["tier"], empty["gate_note"], empty["signals"], empty["found"], empty["points_name"]) == (0, [], "low", None, [], "mine", 7)
        assert (dead["score"], dead["categories"], dead["tier"]) == (28 + 10 + 6 + 14 + 22 + 4 - 15, ["name", "infrastructure", "registration", "content", "certificate"], "medium")
        assert [s["key"] for s in dead["signals"]] == ["name.homoglyphNonAscii", "name.phishingKeyword", "infrastructure.hasMx", "registration.ageUnder3Days", "content.passwordField", "content.looksParked", "certificate.freeDvIssuer"]
    full = full.withColumn("looks_parked", F.lit(False))
    assert [s["label"] for s in scoring.scored(full, True).first()["signals"] if s["key"] == "gate.note"] == [C.GATE_NOTES["dead"]]
