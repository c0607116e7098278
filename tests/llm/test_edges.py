"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing column names."""

import collections
import itertools

import pytest
from conftest import data_dir
from pyspark.sql import functions as F

import corpus_pipeline
from namelens.llm import exactdedup, htmlmain, licenses, minhash, mixing, packing, pii, quality, simhash, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
ROWS = [
    (1, "the first text", "en", "a", 14), (1, "the first text", "en", "a", 14), (2, "the  first text", None, None, None), (None, "the first text", "en", "a", 1), (None, None, None, None, None),
    (None, None, None, None, None), (3, "", "en", "b", 0), (4, " \n\t", "en", "b", 3), (5, "word " * 30_000, "en", "c", None), (6, "é" * 5000, "fr", "c", None), (7, "5 " * 3000, "", "", None),
    (8, "the first text!", "en", "a", None), (9, "\x00 null sign \x01", "en", "a", None), (10, "😀 emoji 😀", "en", "a", None), (10, "another text", "en", "d", None),
]
LABELS = [(1, 1, 0), (2, None, None), (3, 0, 1), (None, 1, 1), (99, 1, 0), (5, 0, 0), (6, 1, 1), (7, 1, 0), (8, 1, 0), (8, 1, 0)]
#: Names that the operators use inside.
CLASHES = ("key", "fp", "sha", "size", "row", "label", "score", "h", "k_id", "kept_row", "mix_row", "bucket", "target", "times", "spans", "bin_id", "cluster", "v", "path", "host", "n", "keep", "count", "Text2", "a.b")


@pytest.fixture(scope="module", params=["rows", "empty", "nulls", "clashes"])
def docs(request, spark):
    rows = {"rows": ROWS, "empty": [], "nulls": [(None,) * 5] * 3, "clashes": ROWS}[request.param]
    df = spark.createDataFrame(rows, SCHEMA)
    if request.param == "clashes":
        df = df.withColumns({c: F.lit(i) for i, c in enumerate(CLASHES)})
    return df


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")


def key(r):
    return (r["doc_id"], r["text"])


def test_one_row_for_each(spark, docs, labels):
    n = docs.count()
    for rows in (
        mixing.mix(docs), quality.classify(docs, labels), quality.classify(docs, labels.limit(0)), minhash.edited_fingerprints(docs), minhash.fingerprints(docs), exactdedup.groups_of(docs),
        licenses.scans(docs), toxicity.classify(docs, labels), toxicity.classify(docs, labels.limit(0)), pii.scans(docs), simhash.clusters(docs),
    ):
        got = rows.collect()
        assert len(got) == n
        assert collections.Counter(r["doc_id"] for r in got) == collections.Counter(r["doc_id"] for r in docs.select("doc_id").collect())


def test_scores_are_defined(docs, labels):
    for module in (quality, toxicity):
        for r in module.classify(docs, labels).collect():
            assert 0 <= r["score"] <= 1 and r["predicted"] in (0, 1) and r["held_out"] in (True, False)


def test_exact_dedup_keeps_one_of_each_text(docs):
    squeeze = lambda t: "".join(c for c in t or "" if c not in " \t\n\x0b\x0c\r")
    rows = docs.collect()
    groups = exactdedup.groups_of(docs)
    assert groups.where("kept").count() == len({squeeze(r["text"]) for r in rows})
    kept = exactdedup.deduplicated(docs)
    assert kept.columns == docs.columns
    got = kept.collect()
    assert sorted(map(squeeze, (r["text"] for r in got))) == sorted({squeeze(r["text"]) for r in rows})
    assert {key(r) for r in got} <= {key(r) for r in rows}


def test_near_dedup_keeps_one_of_each_component(docs):
    kept = simhash.near_deduplicated(docs)
    assert kept.columns == docs.columns
    n = docs.select(F.coalesce("text", F.lit(""))).distinct().count()
    got = collections.Counter(key(r) for r in kept.collect())
    assert got.keys() <= {key(r) for r in docs.collect()} and (n > 0) <= len(got) <= n
    assert max(got.values(), default=1) == 1


def test_mixed_documents_columns(docs):
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns
    assert {key(r) for r in mixed.collect()} <= {key(r) for r in docs.collect()}


def test_accepted_columns(docs, labels):
    kept = quality.accepted(docs, labels)
    assert kept.columns == docs.columns and kept.count() <= docs.count()


def test_packing_keeps_all_words(docs):
    rows = packing.packed(docs, 100).collect()
    size = lambda t: len((t or "").split(" ")) if t == "" else len([w for w in (t or "").replace("\t", " ").replace("\n", " ").split(" ") if w])
    want = sum(0 if not r["text"] else size(r["text"]) for r in docs.collect())
    assert sum(r["n_words"] for r in rows) == want
    assert len({(r["bin_id"], r["place"]) for r in rows}) == len(rows) >= docs.count()


def test_pages(spark):
    for rows in ([], [(None, None, None)] * 2, [(1, "http://a.b/", "<div>" * 300 + "deep"), (1, "http://a.b/", "<div>" * 300 + "deep"), (2, "", "<p"), (3, "x", "<!-- open"), (4, "y", "<a href='" + "z" * 1000)]):
        pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"text": F.lit("x"), "host": F.lit(1), "path": F.lit(2)})
        got = htmlmain.extract(pages).collect()
        assert len(got) == len(rows) and all(r["n_chars"] == len(r["text"]) for r in got)


def test_stages(spark, tmp_path):
    spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    for rows in (ROWS, []):
        docs = spark.createDataFrame(rows, SCHEMA)
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, str(tmp_path))
            if name != corpus_pipeline.STAGES[-1][0]:
                assert out.columns == docs.columns
                docs = out
        assert "bin_id" in out.columns and (out.count() > 0) == bool(rows)


def test_pipeline_against_brute_force(spark):
    """Each stage of the pipeline keeps what its operator decides on the stage's own input."""
    d = data_dir("sf0.001")
    docs = spark.read.parquet(f"{d}/documents.parquet")
    quality_ids = {r["doc_id"] for r in quality.classify(docs, spark.read.parquet(f"{d}/labels.parquet")).where("predicted = 1").collect()}
    first = corpus_pipeline.keep_quality(spark, docs, d)
    assert {r["doc_id"] for r in first.collect()} == quality_ids
    seen, want = set(), set()
    squeeze = lambda t: "".join((t or "").split())
    for r in sorted(first.collect(), key=lambda r: (-len(r["text"] or ""), r["doc_id"])):
        if squeeze(r["text"]) not in seen:
            seen.add(squeeze(r["text"]))
            want.add(r["doc_id"])
    second = corpus_pipeline.drop_exact_copies(spark, first, d)
    assert {r["doc_id"] for r in second.collect()} == want
    third = corpus_pipeline.drop_near_copies(spark, second, d)
    rows = sorted(((r["doc_id"], r["text"] or "") for r in second.collect()))
    sets = [set(simhash.shingle_set(t.encode()).tolist()) for _, t in rows]
    root = list(range(len(rows)))
    for i, j in itertools.combinations(range(len(rows)), 2):
        if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
            a, b = root[i], root[j]
            root = [min(a, b) if x in (a, b) else x for x in root]
    assert {r["doc_id"] for r in third.collect()} == {rows[i][0] for i in set(root)}
    times = {r["doc_id"]: r["taken"] // r["size"] for r in mixing.mix(third).collect() if r["size"]}
    fourth = collections.Counter(r["doc_id"] for r in corpus_pipeline.mix_sources(spark, third, d).collect())
    assert {k: v for k, v in fourth.items() if k in times} == {k: v for k, v in times.items() if v}
    last = corpus_pipeline.run(spark, d)
    assert {r["doc_id"] for r in last.collect()} == set(fourth)
