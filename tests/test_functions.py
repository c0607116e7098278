import itertools
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from namelens.functions import content, domains, edit, folding
from namelens.functions.register import register


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x")).alias("y")).first()["y"]


@pytest.mark.parametrize(("name", "want"), [
    ("*.A.B.sbi.co.in.", "sbi.co.in"), ("1.2.3.4", None), ("localhost", None), ("co.in", "co.in"), ("s3.amazonaws.com", "amazonaws.com"),
    ("x.y.pages.dev", "y.pages.dev"), ("", None), (None, None), ("a b.com", None), ("x" * 64 + ".com", None), ("::1.com", None), ("a.b.s3.amazonaws.com", "b.s3.amazonaws.com"), ("..a..com", "a.com"),
])
def test_registrable_domain(spark, name, want):
    assert one(spark, name, domains.registrable_domain) == want


@pytest.mark.parametrize(("name", "want"), [("sbi-kyc-update.co.in", "sbi-kyc-update"), ("co.in", "co.i"), ("localhost", ""), ("a.github.io", "a")])
def test_registrable_label(spark, name, want):
    assert one(spark, name, domains.registrable_label) == want


def test_tokens_and_keywords(spark):
    assert one(spark, "SBI-kyc--update", domains.tokenize) == ["sbi", "kyc", "update"]
    hits = lambda x: one(spark, x, lambda c: domains.keyword_hits(domains.tokenize(c)))
    assert hits("paytm-rewards.xyz") == ["reward"]
    assert hits("x.gov.in") == ["gov"]
    assert hits("carefree.com") == []
    assert hits("bonuses-login-logins") == ["bonus", "login"]


@pytest.mark.parametrize(("ip", "want"), [("10.0.0.1", True), ("172.16.0.1", True), ("100.64.0.1", True), ("::1", True), ("fd00::1", True), ("bad", True), ("8.8.8.8", False), ("2001:db8::1", False), ("224.0.0.1", True), ("1.2.3", True), ("", True)])
def test_private_address(spark, ip, want):
    assert one(spark, ip, domains.is_private_address) is want


def test_match_terms(spark):
    row = spark.createDataFrame([("HDFC Bank", ["hdfcbank.com", "sbi.co.in", "x"], ["hb", "Ab Cd"])], "n string, d array<string>, a array<string>")
    got = row.select(domains.match_terms(F.col("n"), F.col("d"), F.col("a")).alias("t")).first()["t"]
    assert got == ["hdfcbank", "abcd", "sbi"]
    kept = row.select(domains.final_terms(F.array(F.lit("aaa"), F.lit("bbbb")), F.array(F.lit("CCCCC")), F.array(F.lit("bbbb"))).alias("t")).first()["t"]
    assert kept == ["ccccc", "aaa"]


@pytest.mark.parametrize(("label", "folded", "suspicious", "mixed"), [("päytm", "paytm", True, False), ("ｅ", "e", False, False), ("h0fc", "hofc", False, False), ("hdfcbаnk", "hdfcbank", True, True), ("Login-1", "login-l", False, False)])
def test_fold(spark, label, folded, suspicious, mixed):
    got = one(spark, label, folding.fold)
    assert (got["folded"], got["suspicious"], got["mixed_script"]) == (folded, suspicious, mixed)


def test_fold_null_and_paths_agree(spark):
    assert one(spark, None, folding.fold) is None
    for label in ("abc", "4bc-0x", "ABC", "---", ""):
        got, want = one(spark, label, folding.fold).asDict(recursive=True), folding.fold_text(label)
        assert got == want


def test_punycode(spark):
    assert one(spark, "xn--pytm-loa.com", folding.to_unicode) == "päytm.com"
    assert one(spark, "paytm.com", folding.to_unicode) is None
    assert one(spark, "xn--\u0001.com", folding.to_unicode) is None


def test_alignment_distance():
    d = edit.alignment_distance
    assert d("hdfcbnak", "hdfcbank", 2) == 1
    assert d("hdfxbamk", "hdfcbank", 2) == 2
    assert d("ca", "abc") == 3
    assert d("abcdefgh", "ijklmnop", 2) == 3
    assert d("", "ab") == 2


def _plain(a, b):
    d = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, j in itertools.product(range(len(a) + 1), range(len(b) + 1)):
        if not i or not j:
            d[i][j] = i + j
            continue
        d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
        if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
            d[i][j] = min(d[i][j], d[i - 2][j - 2] + 1)
    return d[-1][-1]


@settings(max_examples=300, deadline=None)
@given(st.text("abc", max_size=7), st.text("abc", max_size=7))
def test_alignment_distance_property(a, b):
    assert edit.alignment_distance(a, b) == _plain(a, b)
    assert edit.alignment_distance(a, b, 2) == min(3, _plain(a, b))


def test_neighbourhood_finds_all_close_pairs(spark):
    r = random.Random(3)
    words = sorted({"".join(r.choice("abcd") for _ in range(r.randint(5, 8))) for _ in range(120)})
    df = spark.createDataFrame([(w,) for w in words], "w string").select("w", F.explode(edit.neighbourhood(F.col("w"))).alias("k"))
    found = {(x["a"], x["b"]) for x in df.withColumnRenamed("w", "a").join(df.withColumnRenamed("w", "b"), "k").where("a < b").select("a", "b").distinct().collect()}
    close = {(a, b) for a, b in itertools.combinations(words, 2) if _plain(a, b) <= 2}
    assert close and close <= found


def test_content(spark):
    page = '<html><head><TITLE lang=x>Hdfc &amp;lt; co\n  login</title></head><form action="https://evil.example/x"><input type=password></form></html>'
    rows = spark.createDataFrame([(page,), ("",), (None,), ('<input id="shipping">' + "x" * 2000,), ("Coming Soon" + "y" * 3000,)], "h string")
    got = [r["c"].asDict() for r in rows.select(content.analyse(F.col("h"), F.lit("hdfc.com"), F.array(F.lit("HDFC"), F.lit("co"))).alias("c")).collect()]
    assert got[0] == {"page_title": "Hdfc < co login", "has_password_field": True, "brand_terms_on_page": ["HDFC"], "form_posts_offsite": True, "looks_parked": False, "content_risk_score": 95}
    assert got[1]["looks_parked"] and got[2]["looks_parked"] and got[1]["content_risk_score"] == 0
    assert got[3]["has_password_field"] and not got[3]["looks_parked"]
    assert got[4]["looks_parked"] and not got[4]["has_password_field"]


def test_offsite(spark):
    f = lambda action: one(spark, f'<form method=post action="{action}">', lambda h: content.form_posts_offsite(h, F.lit("a.com")))
    assert [f("https://b.com/x"), f("https://a.com/x"), f("https://x.A.com/"), f("/local"), f("https://ba.com")] == [True, False, False, False, True]


def test_sql_functions(spark):
    register(spark)
    row = spark.sql("SELECT normalize_name(' *.A.com. ') n, tokenize_label('a-B') t, fold_label('päy') f, osa_within_two('ab', 'ba') d").first()
    assert (row["n"], row["t"], row["f"], row["d"]) == ("a.com", ["a", "b"], "pay", 1)


def plain_fold(label):
    """The rules of folding, written out one character after the other."""
    import unicodedata

    from namelens import constants as C

    to_ascii = {c: to for to, every in C.LOOKALIKES.items() for c in every} | C.DIGIT_SWAPS | {chr(z + d): str(d) for z in C.DIGIT_ZEROS for d in range(10)}
    out = {"folded": "", "suspicious": False, "substitutions": [], "mixed_script": False, "scripts": []}
    for c in unicodedata.normalize("NFKC", label):
        stripped = "".join(x for x in unicodedata.normalize("NFD", c) if not "̀" <= x <= "ͯ") or c
        to = to_ascii.get(stripped, to_ascii.get(c, stripped.lower()))
        script = [n for n, ranges in C.SCRIPTS.items() if any(a <= ord(c) <= b for a, b in ranges)]
        out["scripts"] += [n for n in script[:1] if n != "Digit" and n not in out["scripts"]]
        listed = stripped in to_ascii or c in to_ascii
        if stripped != c or (listed and to != c):
            out["substitutions"].append({"from": c, "to": to, "codepoint": f"U+{ord(c):04X}"})
            out["suspicious"] |= ord(c) > 127
        elif ord(c) > 127 and stripped not in to_ascii:
            out["suspicious"] = True
        out["folded"] += to
    out["mixed_script"] = len(out["scripts"]) > 1
    out["suspicious"] |= out["mixed_script"]
    return out


def test_folding_by_tables_equals_the_rules(spark):
    import random

    from namelens import constants as C

    listed = "".join(C.LOOKALIKES.values()) + "".join(chr(z + d) for z in C.DIGIT_ZEROS for d in range(10))
    r = random.Random(9)
    pool = listed + "abcXYZ0135 -.éÀçñüß̧́̈ｆｕ１①ﬁ½㎏ἀ가각ㄱאبअকー漢𝐚𝟛😀"
    texts = list(listed) + [chr(cp) for cp in range(0x20, 0x3000)] + ["".join(r.choice(pool) for _ in range(r.randrange(200))) for _ in range(500)]
    assert all(folding.fold_text(t) == plain_fold(t) for t in texts)
    some = texts[-500:] + list(listed)
    rows = spark.createDataFrame([(t,) for t in some], "t string").select("t", folding.fold(F.col("t")).alias("f"), folding.folded(F.col("t")).alias("s")).collect()
    for row in rows:
        want = plain_fold(folding.decode_text(row["t"]) or row["t"])
        assert row["f"].asDict(recursive=True) == want and row["s"] == want["folded"]
