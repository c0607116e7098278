"""Every registered query against its SQL in DuckDB, on the smallest tables."""

import math
import os

import duckdb
import pytest
from conftest import data_dir

from namelens import queries, queries_answers, queries_more, queries_streams  # noqa: F401

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{data_dir('sf0.001')}/{t}.parquet'")
    return con


def canonical(rows):
    def value(v):
        if v is None or (isinstance(v, float) and math.isnan(v)):
            return "null"
        return f"{float(v):.9g}" if isinstance(v, int | float) and not isinstance(v, bool) else str(v)

    return sorted(tuple(map(value, r)) for r in rows)


def same(spark, duck, run, sql):
    got = run(spark, data_dir("sf0.001"))
    columns = sorted(got.columns)
    want = duck.execute(f"SELECT {', '.join(columns)} FROM ({sql})")
    assert canonical(tuple(r[c] for c in columns) for r in got.collect()) == canonical(want.fetchall())


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query(spark, duck, name):
    same(spark, duck, queries.QUERIES[name], queries.ORACLE_SQL[name])


def test_prefilter_keeps_matches(spark):
    hits = queries.prefilter_hits(spark, data_dir("sf0.001"))
    names = {r["name"] for r in hits.where("mode = 'sound'").collect()}
    domains = {r["domain"] for r in queries.best_match(spark, data_dir("sf0.001")).collect()}
    assert domains <= {n for n in names} | {".".join(n.split(".")[-2:]) for n in names} | {".".join(n.split(".")[-3:]) for n in names}


def test_entry_without_corpus_operators(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).columns == ["domain", "brand_slug", "matched_term", "match_kind", "edit_distance"]
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert os.path.basename(entry.__file__) == "__spark_entry__.py"


def test_pages_of_a_small_file_are_spread_over_tasks(spark):
    assert queries.QUERIES["page_signals"](spark, data_dir("sf0.001")).rdd.getNumPartitions() >= 4
