"""The corpus operators against brute force, SQL and labels."""

import collections
import hashlib
import itertools
import random
import re

import duckdb
import numpy as np
import pytest
import xxhash
from conftest import data_dir
from pyspark.sql import functions as F

from namelens.llm import components, exactdedup, htmlmain, licenses, minhash, mixing, packing, pii, quality, registry, simhash, toxicity
from namelens.llm.common import SOLID, WORD, span_hashes, word_spans

TABLES = ("documents", "pages", "labels", "benchmark", "embeddings", "conversations")


def docs_of(spark, texts, sources=None):
    rows = [(i, t, "en", sources[i] if sources else f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")


def words_of(r, n, vocabulary=400):
    return " ".join(f"w{r.randrange(vocabulary)}" for _ in range(n))


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{data_dir('sf0.001')}/{t}.parquet'")
    got = registry.QUERIES[name](spark, data_dir("sf0.001"))
    columns = sorted(got.columns)
    text = lambda rows: sorted(tuple(f"{v:.9g}" if isinstance(v, float) else str(v) for v in r) for r in rows)
    assert text(tuple(r[c] for c in columns) for r in got.collect()) == text(con.execute(f"SELECT {', '.join(columns)} FROM ({registry.ORACLE_SQL[name]})").fetchall())


def test_every_operator_is_registered():
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in registry.QUERIES) == list(range(1, 14))


# --- text buffers


def test_word_spans():
    texts = ["Ab cd", "", "x", " \tééé z", "end"]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    offsets = np.cumsum([0, *(len(t.encode()) for t in texts)])
    start, end, text = word_spans(data, offsets, SOLID)
    got = [(int(t), bytes(data[a:b]).decode()) for a, b, t in zip(start, end, text, strict=True)]
    assert got == [(i, w) for i, t in enumerate(texts) for w in t.split()]
    h = span_hashes(data, start, end)
    assert len(set(h.tolist())) == len({w for _, w in got}) and WORD[200]


# --- 1 mixing


def test_water_filling(spark):
    r = random.Random(1)
    for _ in range(6):
        sizes = [(f"s{i}", r.choice([0, 1, 10, 100, 1000]) * r.randint(1, 9), r.randint(1, 3)) for i in range(r.randint(1, 8))]
        df = spark.createDataFrame(sizes, "source string, source_size long, weight long")
        got = {x["source"]: x["target"] for x in mixing.fill_targets(df).collect()}
        budget, low, high = 1.5 * sum(s for _, s, _ in sizes), 0.0, 1e9
        for _ in range(200):
            mid = (low + high) / 2
            low, high = (mid, high) if sum(min(2 * s, mid * w) for _, s, w in sizes) < budget else (low, mid)
        assert all(got[n] == pytest.approx(min(2 * s, low * w), abs=1e-3) for n, s, w in sizes)


def test_mixing_counts(spark):
    r = random.Random(2)
    docs = docs_of(spark, [words_of(r, r.randint(0, 60)) for _ in range(600)], [r.choice(["a", "b", "b", "b", "c", None]) for _ in range(600)])
    rows = mixing.mix(docs).collect()
    by = collections.defaultdict(lambda: [0, 0, 0])
    for x, d in zip(sorted(rows, key=lambda x: x["doc_id"]), docs.orderBy("doc_id").collect(), strict=True):
        assert x["size"] == len(d["text"].split()) and x["taken"] <= 2 * x["size"]
        by[d["source"]][0] += x["taken"]
        by[d["source"]][1:] = [x["target"], x["source_size"]]
    assert all(abs(taken - target) <= 60 and target <= 2 * size for taken, target, size in by.values())
    again = mixing.mixed_documents(docs)
    assert again.columns == docs.columns
    times = collections.Counter(x["doc_id"] for x in again.collect())
    assert all(times[x["doc_id"]] * x["size"] == x["taken"] for x in rows)


# --- 2 and 7 classifiers


def held_out_figures(spark, module, label):
    d = data_dir("sf0.1")
    labels = spark.read.parquet(f"{d}/labels.parquet")
    rows = module.classify(spark.read.parquet(f"{d}/documents.parquet"), labels).join(labels, "doc_id").where("held_out").select("score", "predicted", label).collect()
    positive, negative = [x["score"] for x in rows if x[label] == 1], [x["score"] for x in rows if x[label] == 0]
    assert all(0 <= x["score"] <= 1 for x in rows)
    above = sum((p > n) + 0.5 * (p == n) for p in positive for n in negative)
    return above / (len(positive) * len(negative)), sum(x["predicted"] == x[label] for x in rows) / len(rows)


def test_quality_held_out(spark):
    area, right = held_out_figures(spark, quality, "quality")
    assert area > 0.98 and right > 0.97


def test_toxicity_held_out(spark):
    area, right = held_out_figures(spark, toxicity, "toxic")
    assert area > 0.9 and right > 0.95


def test_quality_score_against_a_slow_pass():
    """Long texts by pieces, and many texts at once, score as one passage after the other does."""
    r = random.Random(24)
    net = quality.Network(seed=3)
    net.w["c"] = np.random.default_rng(1).normal(size=24)
    texts = [words_of(r, n).encode() for n in (0, 1, 95, 96, 97, 500, quality.PIECE + 700, 2 * quality.PIECE)]
    offsets = np.cumsum([0, *map(len, texts)])
    x, first = quality.passages(np.frombuffer(b"".join(texts), np.uint8), offsets)
    got = net.score(x, first)
    for i, t in enumerate(texts):
        words = t.split()
        top, bottom = np.zeros(24), 0.0
        for at in range(0, max(1, len(words)), quality.PASSAGE):
            # as in the text: a passage ends where the next one starts
            part = b" ".join(words[at : at + quality.PASSAGE]) + (b" " if at + quality.PASSAGE < len(words) else b"")
            f = np.clip(quality.passages(np.frombuffer(part, np.uint8), np.array([0, len(part)]))[0][0], -6, 6)
            h = np.tanh(net.w["W"].T @ f + net.w["b"])
            e = np.exp((np.tanh(net.w["V"].T @ h) / (1 + np.exp(-(net.w["U"].T @ h)))) @ net.w["a"])
            top, bottom = top + e * h, bottom + e
        want = 1 / (1 + np.exp(-(top / bottom @ net.w["c"])))
        assert got[i] == pytest.approx(want, abs=1e-9)
        if len(words) > quality.PIECE:
            assert net.score_pieces(np.frombuffer(t, np.uint8)) == pytest.approx(want, abs=1e-9)


def test_maximal_segments_by_definition():
    """All segments by brute force: those whose every proper prefix and suffix sums to more than zero, and that no larger one like it holds."""
    r = random.Random(25)
    for _ in range(150):
        n, drift = r.randint(1, 12), r.choice([0.5, 1.0, 2.0])
        scores = [r.choice([0, 0, 1, 2.5, 3.25]) for _ in range(n)]
        full = [s or -drift for s in scores]
        total = lambda a, b: sum(full[a:b])
        good = [(a, b) for a in range(n) for b in range(a + 1, n + 1) if all(total(a, k) > 0 for k in range(a + 1, b + 1)) and all(total(k, b) > 0 for k in range(a, b))]
        want = sorted((a, b - 1) for a, b in good if not any(x <= a and b <= y and (x, y) != (a, b) for x, y in good))
        at = [i for i, s in enumerate(scores) if s]
        assert sorted((a, b) for _, a, b in toxicity.maximal_segments(at, [scores[i] for i in at], drift)) == want


def test_network_gradients():
    r = np.random.default_rng(1)
    net = quality.Network(hidden=3, gate=2, seed=2)
    net.w["c"] = r.normal(size=3)
    x, first, y = r.normal(size=(5, quality.N_FEATURES)), np.array([0, 2, 5]), np.array([1.0, 0.0])

    def loss():
        z = net.forward(x, first)[-1]
        return float(np.mean(np.log1p(np.exp(z)) - y * z))

    grads = net.gradients(x, first, y)
    for k, w in net.w.items():
        at = tuple(0 for _ in w.shape)
        w[at] += 1e-5
        up = loss()
        w[at] -= 2e-5
        assert (up - loss()) / 2e-5 == pytest.approx(grads[k][at], abs=1e-6)
        w[at] += 1e-5


def test_maximal_segments():
    r = random.Random(3)
    for _ in range(200):
        n, drift = r.randint(1, 14), r.choice([0.5, 1.0, 2.0])
        scores = [r.choice([0, 0, 1, 2, 3]) for _ in range(n)]
        at = [i for i, s in enumerate(scores) if s]
        got = toxicity.maximal_segments(at, [float(scores[i]) for i in at], drift)
        full = [s or -drift for s in scores]
        best = max((sum(full[a : b + 1]) for a in range(n) for b in range(a, n)), default=0)
        assert not at or max(s for s, _, _ in got) == pytest.approx(best)
        assert all(s == pytest.approx(sum(full[a : b + 1])) for s, a, b in got)
        assert all(x[2] < y[1] for x, y in itertools.pairwise(sorted(got, key=lambda g: g[1])))


# --- 3 fingerprints


def brute_minhash(text):
    words = text.translate({c: c + 32 for c in range(65, 91)}).split()
    signed = lambda v: v - (1 << 64) if v >> 63 else v
    h = [signed(xxhash.xxh64_intdigest(w.encode(), 42)) for w in words]

    def over(values):  # Spark hashes several values by taking each result as the next seed
        seed = 42
        for v in values:
            seed = xxhash.xxh64_intdigest((v & (1 << 64) - 1).to_bytes(8, "little"), seed)
        return seed >> 1

    shingles = [over(h[i : i + 5]) for i in range(len(h) - 4)] if len(h) >= 5 else [over(h)]
    bins = [None] * minhash.BINS
    for s in shingles:
        b = s >> 55
        bins[b] = s if bins[b] is None else min(bins[b], s)
    out = []
    for j in range(minhash.BINS):
        t = j
        if bins[j] is None:
            odd = pow(minhash.INVERSE[j], -1, minhash.BINS)
            t = next(b for b in ((minhash.START[j] + k * odd) % minhash.BINS for k in range(minhash.BINS)) if bins[b] is not None)
        out.append("0123456789abcdef"[bins[t] & 15])
    return "".join(out)


def test_minhash_against_brute_force(spark):
    r = random.Random(4)
    texts = [words_of(r, n) for n in (0, 1, 3, 4, 5, 6, 9, 40, 300, 2500)] + [None, "  ", "É b\tC d\ne F"]
    got = {x["doc_id"]: x["fingerprint"] for x in minhash.fingerprints(docs_of(spark, texts)).collect()}
    assert got == {i: brute_minhash(t or "") for i, t in enumerate(texts)}


def test_edited_fingerprints(spark):
    r = random.Random(5)
    texts = [words_of(r, r.randint(0, 80)) for _ in range(60)] + ["", None, "x"]
    docs = docs_of(spark, texts).withColumn("doc_id", F.col("doc_id") * F.col("doc_id") * 7 - 300)
    rows = sorted(minhash.edited_fingerprints(docs).collect(), key=lambda x: x["doc_id"])
    plain = [t or "" for t in texts]
    for i, (x, t) in enumerate(zip(rows, plain, strict=True)):
        after = plain[(i + 1) % len(plain)]
        half = len(t) // 2
        edited = t[: len(t) - half] + after[:half]
        assert x["n_chars"] == len(t) and x["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert (x["fingerprint"], x["edited_fingerprint"]) == (brute_minhash(t), brute_minhash(edited))
        same = sum(a == b for a, b in zip(x["fingerprint"], brute_minhash(after), strict=True)) / minhash.BINS
        assert x["near_next"] == pytest.approx(max(0, (same - 1 / 16) / (15 / 16)))


def test_neighbours_of_outlying_ids(spark, monkeypatch):
    """Buckets hold about as many rows wherever the ids lie, and every row finds the next one."""
    monkeypatch.setattr(minhash, "BUCKET", 10)
    ids = [*range(100), *range(10**12, 10**12 + 100), 2**50, -(2**60), 2**62, 2**62 + 1]
    docs = spark.createDataFrame([(i, f"text {i}") for i in ids], "doc_id long, text string")
    sizes = [r["count"] for r in minhash._buckets(docs).where("NOT edge").groupBy("bucket").count().collect()]
    assert sum(sizes) == len(ids) and max(sizes) <= 30 and len(sizes) >= 15
    order = sorted(ids)
    want = {i: f"text {i}"[: -(-len(f"text {i}") // 2)] + f"text {after}"[: len(f"text {i}") // 2] for i, after in zip(order, [*order[1:], order[0]], strict=True)}
    got = {r["doc_id"]: r["edited_sha256"] for r in minhash.edited_fingerprints(docs).collect()}
    assert got == {i: hashlib.sha256(t.encode()).hexdigest() for i, t in want.items()}


def test_likeness_estimates_jaccard(spark):
    r = random.Random(6)
    a = [f"w{r.randrange(10**6)}" for _ in range(900)]
    b = a[:600] + [f"v{r.randrange(10**6)}" for _ in range(300)]
    x, y = (brute_minhash(" ".join(t)) for t in (a, b))
    got = spark.createDataFrame([(x, y)], "a string, b string").select(minhash.likeness(F.col("a"), F.col("b")).alias("l")).first()["l"]
    assert abs(got - 596 / 1196) < 0.12


# --- 4 html


PAGE = '<html><head><title>T</title><style>p{}</style></head><body class="home"><header><h1>Site</h1></header><nav><a href=/>Home</a></nav><div class="ad">Buy</div><article><h1>One &amp; two</h1><p>First  <b>bold</b>\n text &lt;3<br>next<p>Second, of <a href=x>some</a> length here.</p><form><input name=q>Go</form><div class="comments"><p>me too</p></div><script>var a="</p>";</script></article><footer>&copy; x</footer></body></html>'


def test_html_text(spark):
    pages = spark.createDataFrame([(1, "https://a.com/1", PAGE), (2, "https://a.com/2", None), (3, None, ""), (4, "bad", "plain <b>text</b> only"), (5, "https://A.com/5", "<article><p>cut &#x41; off"), (1, "https://a.com/1", PAGE)], "page_id long, url string, html string")
    rows = htmlmain.extract(pages).collect()
    got = {x["page_id"]: x["text"] for x in rows}
    want = "One & two First bold text <3 next Second, of some length here."
    assert len(rows) == 6 and got == {1: want, 2: "", 3: "", 4: "plain text only", 5: "cut A off"}
    assert all(x["n_chars"] == len(x["text"]) for x in rows)


def test_html_layouts():
    prose = "<p>" + "word " * 300 + "</p>"
    text = lambda body: (lambda page: page.text(page.best()[0]))(htmlmain.read(f"<html><body>{body}</body></html>"))
    words = ("word " * 300).strip()
    menu = "<ul><li><a href=/>Home page</a><li><a href=/a>About</a></ul>"
    assert text(f"{menu}<div class=post><h1>The title</h1><p>A lead</p><div class=entry>{prose}</div></div>") == f"The title A lead {words}"
    end = "the last section has a dozen words and it belongs here too"
    assert text(f"{menu}<div class=post><div class=entry>{prose}</div><section class=end><p>{end}</p></section></div>") == f"{words} {end}"
    for tag, named in (("main", "site-main no-sidebar"), ("div", "content has-sidebar"), ("article", "post comments-open"), ("div", "comments-open"), ("main", "search"), ("div", "widget")):
        assert text(f"<{tag} class='{named}'>{prose}</{tag}>") == words
    for named in ("site-footer", "sidebar-left", "x comments", "nav"):
        assert text(f"<div class=post>{prose}<div class='{named}'>{prose}</div></div>") == words
    for named in ("no-sidebar", "has-sidebar", "comments-open"):
        assert text(f"<div class=post>{prose}<div class='{named}'>{prose}</div></div>") == f"{words} {words}"


def test_html_keeps_text_around_odd_tags():
    text = lambda body: (lambda page: page.text(page.best()[0]))(htmlmain.read(f"<html><body>{body}</body></html>"))
    prose = "Main text of the page that is long enough to be prose for sure."
    assert text(f'<p>Intro <svg class="i"/> icon</p><p>{prose}</p>') == f"Intro icon {prose}"
    for tag in ("select", "template", "noscript", "textarea", "svg"):
        assert text(f"<div><p>Intro <{tag}><b>hidden</b></p></div><p>{prose}</p>") == f"Intro {prose}"
        assert text(f"<p>Intro <{tag}><b>hidden</b></{tag}> here</p><p>{prose}</p>") == f"Intro here {prose}"
    for named in ("respond", "responses", "reply-list"):
        assert text(f"<article><p>{prose}</p><section id='{named}'><p>{prose}</p></section></article>") == prose


def test_html_of_generated_pages(spark):
    """Pages of a few site layouts, whose main text is known when they are made."""
    r = random.Random(21)
    sentence = lambda n: " ".join(r.choice("lorem ipsum dolor sit amet elit sed do".split()) for _ in range(n)) + "."
    pages, want = [], {}
    for site in range(12):
        wrap = r.choice(["<article>{}</article>", "<main><div class='c{n}'>{}</div></main>", "<div id='post-{n}' class='entry'>{}</div>", "<div class='page'><div class='text'>{}</div></div>"])
        around = [
            (r.choice(["<nav>{}</nav>", "<ul class='menu'>{}</ul>", "<div class='top-nav'>{}</div>"]), ""), ("", r.choice(["<aside>{}</aside>", "<div class='sidebar'>{}</div>", "<div class='widget ad'>{}</div>"])),
            ("", r.choice(["<footer>{}</footer>", "<div class='site-footer'>{}</div>"])), ("", r.choice(["<div class='comments'>{}</div>", "<section id='respond'>{}</section>"])),
        ]
        links = "".join(f"<li><a href='/{i}'>{sentence(2)}</a></li>" for i in range(6))
        for i in range(6):
            blocks = [f"Title {site} {i} &amp; more"] + [sentence(r.randint(12, 60)) for _ in range(r.randint(2, 6))]
            main = f"<h1>{blocks[0]}</h1>" + "".join(f"<p>{b.replace('dolor', '<b>dolor</b>')}</p>" for b in blocks[1:])
            before = "".join(b.format(links) for b, _ in around if b)
            after = "".join(a.format(f"<p>{sentence(20)}</p>{links}") for _, a in around if a)
            body = before + wrap.replace("{n}", str(i)).format(main) + after
            pages.append((site * 6 + i, f"http://h{site}.org/{i}", f"<html><head><title>x</title></head><body>{body}<script>var a = '<p>';</script></body></html>"))
            want[site * 6 + i] = " ".join(blocks).replace("&amp;", "&")
    got = {x["page_id"]: x["text"] for x in htmlmain.extract(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert got == want


def test_host_consensus(spark):
    body = "<body><div class='x{n}'><p>" + "word " * 30 + "</p></div><div class='side{n}'><p>" + "other " * 5 + "</p></div></body>"
    odd = "<body><div class='x9'><p>short one</p></div><div class='y'><p>" + "noise " * 20 + "</p></div></body>"
    pages = spark.createDataFrame([(i, "http://h.org/p", body.replace("{n}", str(i))) for i in range(6)] + [(9, "http://h.org/q", odd)], "page_id long, url string, html string")
    assert {x["host"]: x["path"] for x in htmlmain.host_paths(pages).collect()} == {"h.org": "/body/div.x0"}
    assert {x["page_id"]: x["text"] for x in htmlmain.extract(pages).collect()}[9] == "short one"


# --- 5 exact dedup


def test_quotient_filters_lose_nothing(spark):
    r = np.random.default_rng(7)
    keys = r.integers(-(2**63), 2**63 - 1, 3000)
    keys = np.concatenate([keys, keys[:500], keys[:100], [0, 0, -1, -1, 2**63 - 1]])
    df = spark.createDataFrame([(int(k),) for k in keys], "fp long").repartition(7)
    count = collections.Counter(keys.tolist())
    assert {(x["fp"], x["n_fp"]) for x in exactdedup.repeated_fingerprints(df).collect()} == {(k, n) for k, n in count.items() if n > 1}


def test_exact_dedup_rows(spark):
    texts = ["a b", "ab", " a\nb  ", None, "", "c", "C", "a b"]
    docs = docs_of(spark, texts)
    got = {x["doc_id"]: (x["keep_id"], x["group_size"], x["kept"]) for x in exactdedup.groups_of(docs).collect()}
    assert got == {0: (2, 4, False), 1: (2, 4, False), 2: (2, 4, True), 7: (2, 4, False), 3: (3, 2, True), 4: (3, 2, False), 5: (5, 1, True), 6: (6, 1, True)}
    assert sorted(x["doc_id"] for x in exactdedup.deduplicated(docs).collect()) == [2, 3, 5, 6]


def test_exact_dedup_keeps_the_longer_spacing_of_one_doc_id(spark):
    rows = [(1, "ab"), (1, "a b"), (1, "a b"), (2, "x"), (2, "x"), (None, "y"), (None, "y ")]
    docs = spark.createDataFrame([(i, t, k) for k, (i, t) in enumerate(rows)], "doc_id long, text string, extra int")
    got = [(r["doc_id"], r["text"], r["extra"]) for r in exactdedup.deduplicated(docs).collect()]
    assert sorted(map(str, (g[:2] for g in got))) == sorted(map(str, [(1, "a b"), (2, "x"), (None, "y ")]))
    assert sorted(got, key=str) == sorted(((r["doc_id"], r["text"], r["extra"]) for r in exactdedup.deduplicated(docs.repartition(5)).collect()), key=str)


# --- 6 licenses


def test_licenses(spark):
    full = licenses.TEMPLATES[1][1]
    texts = [
        "code under the MIT  License. and Apache license", full, full.replace("free of charge, ", "").replace("and associated", "and all associated"), "permission is hereby granted to nobody",
        None, "", "no words about it", "LICENSE mit license, general public-license", "x " * 500 + full + " y" * 500 + " " + full, "mit élicense licensé mit license",
    ]
    got = {x["doc_id"]: x for x in licenses.scans(docs_of(spark, texts)).collect()}
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    for i, t in enumerate(texts):
        w = word.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        base = sorted((k, label) for phrase, label in licenses.PHRASES for k in range(len(w)) if w[k : k + len(phrase.split())] == phrase.split())
        x = got[i]
        assert (x["n_words"], x["n_base"], x["base_labels"]) == (len(w), len(base), ",".join(sorted({b for _, b in base})))
        assert (x["first_word"], x["last_word"]) == ((base[0][0], base[-1][0]) if base else (None, None))
        assert set(filter(None, x["base_labels"].split(","))) <= set(x["labels"].split(",")) and 0 <= x["score"] <= 1
    assert [got[i]["labels"] for i in (1, 2, 3, 6)] == ["mit", "mit", "", ""]
    assert got[8]["spans"].count("mit:") == 2
    r = random.Random(20)
    fewer = full.split()
    for i in r.sample(range(len(fewer)), len(fewer) // 4):
        fewer[i] = "other"
    texts = ["licensed under cc " * 25 + "Licensed under CC BY-NC 4.0.", " ".join(fewer), "All rights reserved. " * 3, "Licensed under CC BY 4.0. Licensed under the Apache License, Version 2.0."]
    got = {x["doc_id"]: x for x in licenses.scans(docs_of(spark, texts)).collect()}
    assert [got[i]["labels"] for i in range(4)] == ["cc-by-nc", "mit", "reserved", "apache,cc-by"]
    assert got[0]["spans"] == "cc-by-nc:75:82" and got[2]["spans"] == "reserved:0:3,reserved:3:6,reserved:6:9"


# --- 8 personal data


_RAW = (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")


def brute_pii(text):
    out = []
    for kind, pattern in enumerate(_RAW):
        for m in re.finditer(pattern, text):
            d = re.sub("[^0-9]", "", m[0])
            good = (True, all(int(p) <= 255 for p in m[0].split(".")) if kind == 1 else True, 16 <= len(d) <= 19 and pii.luhn(d), 8 <= len(d) <= 15)[kind]
            if good:
                out.append((kind, m.start(), m.end()))
    return sorted(out)


def test_base_spans_against_patterns():
    r = random.Random(8)
    parts = ["a.b@c.de", "@", "x@y", "1.2.3.4", "256.1.1.1", "1.2.3.4.5.6.7.8", "4465758382889437", "4465 7583 8288 9437", "4465-7583-8288-9437 4465758382889437", "+1 (499) 555-6503", "+12", " ", "é", "-", ".", "..", "12", "a@b.c@d.ef", "000.1.02.3", "+"]
    for _ in range(1500):
        text = "".join(r.choice(parts) + r.choice(["", " ", ""]) for _ in range(r.randint(0, 8)))
        assert sorted(pii.base_spans(text)) == brute_pii(text)


def test_pii_scans(spark):
    r = random.Random(9)
    card = lambda: next(d for d in ("4" + "".join(r.choice("0123456789") for _ in range(15)) for _ in range(500)) if pii.luhn(d))
    plain = lambda: " ".join(r.choice(["lorem", "ipsum", "call", "to", "with", "pay"]) for _ in range(5))
    texts = [f"{plain()} {r.choice([f'+1 ({r.randint(200, 999)}) 555-{r.randint(1000, 9999)}', card(), f'u{i}@mail.example.com', f'10.{i % 250}.3.4'])} {plain()}" for i in range(400)]
    texts += [None, "", "pair 4465758382889437 4465758382889437 here", "nothing 12 at 3.14 or 1234"]
    rows = {x["doc_id"]: x for x in pii.scans(docs_of(spark, texts)).collect()}
    for i, t in enumerate(texts):
        base, x = brute_pii(t or ""), rows[i]
        line = ",".join(f"{pii.KINDS[k]}:{a}:{b}" for k, a, b in base)
        assert x["base_sha256"] == hashlib.sha256(line.encode()).hexdigest()
        assert [x[f"n_{k}"] for k in pii.KINDS] == [sum(b[0] == n for b in base) for n in range(4)]
        assert set(filter(None, line.split(","))) <= set(x["spans"].split(","))
    assert rows[402]["spans"] == "card:5:21,card:22:38" and rows[403]["spans"] == ""


def test_field_finds_secrets_and_other_spellings():
    """Spans that no pattern has: precision and recall on lines made by hand, by a field that saw none of them."""
    r = random.Random(22)
    hexes = lambda n: "".join(r.choice("0123456789abcdef") for _ in range(n))
    mixed = lambda n: "".join(r.choice("ABCdefGHIjkl0123456789XYZ") for _ in range(n))
    card = lambda: next(d for d in ("4" + "".join(r.choice("0123456789") for _ in range(15)) for _ in range(500)) if pii.luhn(d))
    lines = [f"lorem {x} ipsum" for _ in range(60) for x in (f'token = "{hexes(40)}"', f"+1 ({r.randrange(200, 999)}) 555-{r.randrange(1000, 9999)}", card(), f"a{r.randrange(99)}@mail.example.com", f"10.0.{r.randrange(255)}.7")]
    rand = random.Random(1)
    field = pii.Field().learn([x for t in lines for x in pii.examples_of(t, rand)])
    some = [f'x token = "{hexes(40)}" y', f"api_key: {mixed(32)} y", f"write to bob{r.randrange(9)}(at)mail.example.com now", f"call (415) 555-{r.randrange(1000, 9999)} now"]
    none = [f"commit {hexes(40)} merged", "version 1.2.3.4567 and 10.11.12", "date 2024-01-15 12:30", "isbn 978-3-16-148410-0", "internationalization-of-names here", "1234 5678 1234 5678 is no card", "sum 3.14159265358979", "-" * 30, "a" * 400 + "1"]
    found = [pii.find(t, field) for t in some]
    assert all(not base and len(every) == 1 for base, every in found) and [every[0][0] for _, every in found] == [4, 4, 0, 3]
    assert [pii.find(t, field)[1] for t in none] == [[]] * len(none)


def test_pii_takes_linear_time():
    import time

    def seconds(n):
        at = time.perf_counter()
        assert len(pii.find("1.2.3.4 " * n, pii.Field())[0]) == n
        return time.perf_counter() - at

    seconds(500)
    assert seconds(8000) < 8 * max(0.02, seconds(2000))


def test_field_chooses_jointly():
    field = pii.Field()
    segments = [(0, 2), (0, 5), (3, 5)]
    text = "12 34"
    scores = {(0, 2): 3.0, (0, 5): 5.5, (3, 5): 4.0}
    field.score = lambda kind, names: -9.0 if kind else scores[names]
    pii_features, pii.features = pii.features, lambda t, a, b: (a, b)
    try:
        assert field.best(text, segments) == [(0, 0, 5)]
        scores[0, 5] = 4.0
        assert field.best(text, segments) == [(0, 0, 2), (0, 3, 5)]
    finally:
        pii.features = pii_features


# --- 9 packing


def test_packing(spark):
    r = random.Random(10)
    texts = [words_of(r, r.choice([0, 1, 5, 20, 30, 64, 130, 200])) for _ in range(400)]
    texts += texts[:80]
    docs = docs_of(spark, texts, [r.choice(["a", "a", "b", "c", "d", None]) for _ in texts])
    rows = packing.packed(docs, capacity=64).collect()
    text, source = dict(enumerate(texts)), {x["doc_id"]: x["source"] for x in docs.collect()}
    pieces, bins = collections.defaultdict(list), collections.defaultdict(list)
    for x in rows:
        pieces[x["doc_id"]].append((x["first_word"], x["n_words"]))
        bins[x["bin_id"]].append(x)
    for i, t in text.items():
        at = 0
        for first, n in sorted(pieces[i]):
            assert first == at
            at += n
        assert at == len(t.split())
    for held in bins.values():
        assert sum(x["n_words"] for x in held) == held[0]["bin_words"] <= 64
        assert len({source[x["doc_id"]] for x in held}) == len(held) and len({text[x["doc_id"]] for x in held}) == len(held)


def test_packing_deals_repeated_rows_over_shards(spark, monkeypatch):
    monkeypatch.setattr(packing, "SHARD", 50)
    docs = spark.createDataFrame([(7, "one text", "a")] * 400, "doc_id long, text string, source string")
    shards = collections.Counter(x["bin_id"] >> 32 for x in packing.packed(docs).collect())
    assert sum(shards.values()) == 400 and len(shards) > 4 and max(shards.values()) < 120


def test_packing_takes_the_tightest_compatible_bin():
    r = random.Random(11)
    rows = [(i, r.choice("abc"), r.randrange(12), r.randint(1, 9)) for i in range(60)]
    got = {(i, p): b for i, p, _, b in packing.pack_shard(rows, 10)}
    bins, want = [], {}
    for doc, source, cluster, size in sorted(rows, key=lambda x: (-x[3], x[0])):
        open_ = [(b[0], n) for n, b in enumerate(bins) if b[0] >= size and source not in b[1] and cluster not in b[2]]
        n = min(open_)[1] if open_ else len(bins)
        if not open_:
            bins.append([10, set(), set()])
        bins[n][0] -= size
        bins[n][1].add(source)
        bins[n][2].add(cluster)
        want[doc, 0] = n
    assert got == want


# --- 10 simhash


def brute_simhash(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
    words = re.findall(r"[^\x20\x09-\x0D]+", words)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(fps):
    root = list(range(len(fps)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(range(len(fps)), 2):
        if (fps[i] ^ fps[j]).bit_count() <= 3:
            a, b = top(i), top(j)
            root[max(a, b)] = min(a, b)
    return [top(i) for i in range(len(fps))]


def test_simhash_against_brute_force(spark):
    r = random.Random(12)
    texts = []
    for _ in range(60):
        w = words_of(r, r.randint(1, 120), 4000).split()
        for _ in range(r.choice([1, 1, 2, 6])):
            texts.append(" ".join(w))
            w[r.randrange(len(w))] = f"z{r.randrange(9999)}"
    texts += [None, "", " \n", "A b C", "a B c", "Éa", "éa"]
    rows = sorted(simhash.clusters(docs_of(spark, texts)).collect(), key=lambda x: x["doc_id"])
    fps = [brute_simhash(t or "") for t in texts]
    assert [x["fingerprint"] for x in rows] == [f"{f:016x}" for f in fps]
    assert [x["component_id"] for x in rows] == brute_components(fps)


@pytest.mark.parametrize("dense", [False, True])
def test_shard_links(dense):
    r = random.Random(13)
    fps = set()
    centres = [r.getrandbits(64) for _ in range(3 if dense else 300)]
    for c in centres:
        for _ in range(400 if dense else 3):
            f = c
            for _ in range(r.randint(0, 4)):
                f ^= 1 << r.randrange(64)
            fps.add(f)
    fps = sorted(fps)
    want = brute_components(fps)
    found = [(fps[a], fps[b]) for a, b in simhash.shard_links(np.array(fps, np.uint64)).tolist()]
    root = {f: f for f in fps}

    def top(f):
        while root[f] != f:
            f = root[f]
        return f

    for a, b in found:
        root[top(a)] = top(b)
    groups = collections.defaultdict(set)
    for f, w in zip(fps, want, strict=True):
        groups[w].add(top(f))
    assert all(len(g) == 1 for g in groups.values()) and len({top(f) for f in fps}) == len(groups)


def test_trees_lose_no_pair(spark, monkeypatch):
    monkeypatch.setattr(simhash, "SHARD", 4)
    monkeypatch.setattr(simhash, "CHUNK", 8)
    r = random.Random(14)
    fps = []
    for _ in range(150):
        f = r.getrandbits(64)
        g = f
        for b in r.sample(range(64), 3):
            g ^= 1 << b
        fps += [f, g]
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    rows = spark.createDataFrame([(i, s) for i, s in enumerate(signed)], "doc_id long, fp long")
    got = {x["doc_id"]: x["component_id"] for x in simhash.components(rows).collect()}
    assert [got[i] for i in range(len(fps))] == brute_components(fps)


def test_near_dedup_by_five_words(spark):
    r = random.Random(16)
    texts, want = [], []
    for _ in range(40):
        w = words_of(r, r.randint(300, 500), 5000).split()
        group = [w]
        for _ in range(r.choice([0, 1, 3])):
            c = list(w)
            c[r.randrange(len(c))] = f"z{r.randrange(9999)}"
            group.append(c)
        want.append(len(texts))
        texts += [" ".join(g) for g in group]
    other = list(" ".join(words_of(r, 200, 5000).split()).split())
    half = other[:100] + words_of(r, 100, 5000).split()  # half of the words are others: no near copy
    want += [len(texts), len(texts) + 1]
    texts += [" ".join(other), " ".join(half)]
    assert sorted(x["doc_id"] for x in simhash.near_deduplicated(docs_of(spark, texts)).collect()) == want


def test_near_dedup_by_exact_likeness(spark):
    """Pairs just above a likeness of 0.8 lose one, pairs just below it keep both; also where a band holds several groups."""
    r = random.Random(18)
    texts = []
    for i in range(80):
        w = words_of(r, 230, 5000).split()
        texts.append(" ".join(w))
        for _ in range(1 + 3 * (i % 4 == 0)):
            c = list(w)
            for at in r.sample(range(5, 225, 10), r.choice([4, 5, 6])):  # each takes five of 226 shingles: 0.84, 0.80 or 0.77
                c[at] = f"z{r.randrange(10**6)}"
            texts.append(" ".join(c))
    sets = [{tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)} for t in texts]
    root = list(range(len(texts)))
    for i, j in itertools.combinations(range(len(texts)), 2):
        if len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.8 and root[i] != root[j]:
            a, b = sorted((root[i], root[j]))
            root = [a if x == b else x for x in root]
    got = sorted(x["doc_id"] for x in simhash.near_deduplicated(docs_of(spark, texts)).collect())
    assert got == sorted(set(root)) and 80 < len(got) < len(texts)


def test_near_dedup_finds_all_pairs_of_a_table(spark):
    """All pairs of five-word likeness 0.8 or more in sf0.1, by an index of rare shingles; the stage keeps just what they leave."""
    docs = spark.read.parquet(f"{data_dir('sf0.1')}/documents.parquet")
    rows = sorted((r["doc_id"], r["text"] or "") for r in docs.select("doc_id", "text").collect())
    first, sets = {}, {}
    for i, t in rows:
        first.setdefault(t, i)
    for t, i in first.items():
        sets[i] = set(simhash.shingle_set(t.encode()).tolist())
    having = collections.Counter(h for s in sets.values() for h in s)
    root = {i: i for i in sets}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    # two sets with likeness 0.8 share one of the rarest (1 - 0.8) n + 1 shingles of each
    posted, pairs = collections.defaultdict(list), 0
    for i, s in sorted(sets.items()):
        rare = sorted(s, key=lambda h: (having[h], h))[: len(s) - -(-4 * len(s) // 5) + 1]
        for j in {j for h in rare for j in posted[h]}:
            if len(s & sets[j]) >= 0.8 * len(s | sets[j]):
                pairs += 1
                a, b = top(i), top(j)
                root[max(a, b)] = min(a, b)
        for h in rare:
            posted[h].append(i)
    assert pairs >= 40
    got = sorted(r["doc_id"] for r in simhash.near_deduplicated(docs).select("doc_id").collect())
    want = sorted({top(i) for i in sets})
    assert len(set(want) ^ set(got)) <= 0.02 * pairs  # a pair of 0.8 shares no band in 0.04 % of cases


def test_large_group_of_near_copies_is_compared_with_its_centre(spark, monkeypatch):
    """Copies of one text that aren't near to each other: verified pairs grow with the group, not with its square."""
    r = random.Random(19)
    compared = []
    plain = simhash._alike
    monkeypatch.setattr(simhash, "_alike", lambda pairs, sets: compared.append(pairs.count()) or plain(pairs, sets))
    w = words_of(r, 230, 5000).split()
    texts = []
    for _ in range(300):
        c = list(w)
        for at in r.sample(range(5, 225, 10), 4):  # 0.84 to the text, 0.7 to another copy
            c[at] = f"z{r.randrange(10**6)}"
        texts.append(" ".join(c))
    texts.insert(100, " ".join(w))
    assert [x["doc_id"] for x in simhash.near_deduplicated(docs_of(spark, texts)).collect()] == [0]
    assert sum(compared) < 10 * len(texts)


def test_sketch_tells_likeness():
    r = random.Random(23)
    for n in (40, 400):
        for like, least in ((0.8, 0.0), (0.5, 0.99)):
            missed = 0
            for _ in range(100):
                shared, own = round(2 * n * like / (1 + like)), n - round(2 * n * like / (1 + like))
                h = np.array([r.getrandbits(64) for _ in range(shared + 2 * own)], np.uint64)
                x, y = simhash.sketch(h[: shared + own]), simhash.sketch(np.r_[h[:shared], h[shared + own :]])
                missed += int(np.bitwise_count((x ^ y).view(np.uint64)).sum()) > simhash.DIFFER
            assert missed <= 2 if not least else missed >= 100 * least


def test_shards_grow_with_the_fingerprints(spark):
    largest = {}
    for n in (4_000, 64_000):
        rows = simhash.shards(spark.range(n).select(F.xxhash64("id").alias("fp")), n)
        largest[n] = rows.groupBy("tree", "ring").count().agg(F.max("count")).first()[0]
    assert largest[64_000] < 4 * largest[4_000]


def test_connected_components(spark):
    r = random.Random(15)
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(r.randrange(200, 260), r.randrange(200, 260)) for _ in range(50)] + [(7, 7), (7, 8)]
    got = {x["node"]: x["root"] for x in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    root = {}

    def top(v):
        root.setdefault(v, v)
        while root[v] != v:
            v = root[v]
        return v

    for a, b in edges:
        if a != b:
            x, y = top(a), top(b)
            root[max(x, y)] = min(x, y)
    assert got == {v: top(v) for v in root}


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
@pytest.mark.parametrize("name", ["op2_quality_classifier", "op7_toxic_segments", "op8_pii_spans"])
def test_fitted_queries_run_on_the_small_tables(spark, name, sf):
    got = registry.QUERIES[name](spark, data_dir(sf))
    assert got.count() == spark.read.parquet(f"{data_dir(sf)}/documents.parquet").count()


def test_words_of_every_text_tell_nothing(spark):
    r = random.Random(3)
    rows = [(i, f"common of {'vile scum filth' if i % 5 == 0 else 'nice day sun'} {words_of(r, 12)}", "en", "s", 1) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([(i, 1, int(i % 5 == 0)) for i in range(400)], "doc_id long, quality int, toxic int")
    model = toxicity.fit(docs, labels)
    assert 0 not in model.hashes and len(model.hashes)
    shared, _ = toxicity.tokens(toxicity.pa.array(["common of"]))
    assert not set(shared.ravel().tolist()) & set(model.hashes.tolist())
    found = {(r["toxic"], r["predicted"]) for r in toxicity.classify(docs, labels).join(labels, "doc_id").collect()}
    assert found == {(1, 1), (0, 0)}


@pytest.mark.parametrize("html", ["<script" * 140_000, ("x" * 70 + " a<b ") * 14_000, "<a " * 340_000, "<a \" > '" * 120_000, '<p class="x>y' * 80_000, "<!--" * 250_000, "</script " * 100_000 + ">", "<div>" * 100_000])
def test_malformed_pages_take_linear_time(html):
    import time

    began = time.time()
    page = htmlmain.read(html)
    page.text(page.best()[0])
    assert time.time() - began < 20


@pytest.mark.parametrize("name", ["share-price", "side-effects", "banner-story", "header-image-story", "social-science", "story-share", "notice-board"])
def test_doubtful_classes_keep_prose(name):
    prose, other = "word " * 37, "other " * 11
    text = lambda body: (lambda page: page.text(page.best()[0]))(htmlmain.read(f"<html><body>{body}</body></html>"))
    assert text(f"<div class='{name}'><p>{prose}</p></div><div><p>{other}</p></div>").split() == ["word"] * 37 + ["other"] * 11
    links = "".join(f"<a href=x>link {i}</a> " for i in range(30))
    for bad in (f"<div class='{name}'>{links}</div>", f"<div class='{name}'>Share this</div>", f"<div class='comments'><p>{prose}</p></div>", f"<div class='{name} comments'><p>{prose}</p></div>"):
        assert text(f"<div><p>{prose}</p><p>{other}</p></div>{bad}").split() == ["word"] * 37 + ["other"] * 11


def test_short_blocks_are_kept_apart():
    page = htmlmain.read(f"<html><body><div><label>lab</label><details>det<summary>sum</summary></details><p>{'word ' * 20}</p></div></body></html>")
    assert page.text(page.best()[0]).startswith("lab det sum word")


def test_long_texts_are_seen_whole_in_fitting():
    r = np.random.default_rng(1)
    bag = r.random((1000, 5))
    parts = quality.averaged(bag)
    assert parts.shape == (quality.PARTS, 5) and quality.averaged(bag[:64]) is not None and (quality.averaged(bag[:64]) == bag[:64]).all()
    sizes = np.diff(np.r_[(np.arange(quality.PARTS) * 1000) // quality.PARTS, 1000])
    assert np.allclose((parts * sizes[:, None]).sum(0), bag.sum(0))


def test_long_secrets_are_found(spark):
    r = random.Random(2)
    token = lambda n: "".join(r.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789") for _ in range(n))
    texts = [f"some words before api_key = {token(r.choice([24, 40, 100, 400]))} and after" for _ in range(200)] + [f"here is secret token={token(n)} too" for n in (300, 2000, 50_000)]
    got = {x["doc_id"]: x["spans"] for x in pii.scans(docs_of(spark, texts)).collect()}
    for i, n in ((200, 300), (201, 2000), (202, 50_000)):
        assert f"secret:21:{21 + n}" in got[i], got[i][:100]


def test_losses_by_folds_leave_held_out_rows_alone(spark):
    r = random.Random(4)
    rows = [(i, f"of {'vile scum filth' if i % 4 == 0 else 'nice day sun'} {words_of(r, 12)}", "en", "s", 1) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(300)], "doc_id long, quality int, toxic int")
    settings = [toxicity.Settings(), toxicity.Settings(z_least=50.0)]
    found = toxicity.losses_by_folds(docs, labels, settings, folds=2)
    assert found[settings[0]] < 0.1 < found[settings[1]]
    wrong = labels.withColumn("toxic", F.when(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert toxicity.losses_by_folds(docs, wrong, settings, folds=2) == pytest.approx(found)


def test_components_of_few_links_take_few_tasks(spark, tmp_path):
    """Rounds over a small table write a few files each, though Spark deals shuffles out to many tasks."""
    from namelens.llm.components import connected_components

    held = {k: spark.conf.get(k, None) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    context = spark.sparkContext
    before = context._jsc.sc().getCheckpointDir()
    try:
        context.setCheckpointDir(str(tmp_path))
        spark.conf.set("spark.sql.shuffle.partitions", "40")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        found = connected_components(spark.createDataFrame([(i, i + 1) for i in range(30)] + [(100, 200)], "a long, b long"))
        assert {(r["node"], r["root"]) for r in found.collect()} == {(i, 0) for i in range(31)} | {(100, 100), (200, 100)}
    finally:
        if before.isDefined():
            context.setCheckpointDir(before.get())
        for k, v in held.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    tables = [list(p.glob("part-*")) for p in tmp_path.glob("*/rdd-*")]
    assert len(tables) > 4 and sum(map(len, tables)) < 2 * 40 + len(tables)
