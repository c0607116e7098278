"""The physical plans: columns and filters reach the scan, no nested loops, ranked windows keep few rows."""

import contextlib
import io
import re

import pytest
from conftest import data_dir

from namelens import queries


def plan(spark, name):
    text = io.StringIO()
    with contextlib.redirect_stdout(text):
        queries.QUERIES[name](spark, data_dir("sf0.001")).explain("formatted")
    return text.getvalue()


@pytest.mark.parametrize(("name", "columns"), [("registrable_domain", {"page_id", "url"}), ("html_parked", {"page_id", "html"}), ("non_ascii_profile", {"lang", "text"}), ("history_top20", {"event_id", "ts", "user_id"})])
def test_scans_read_what_is_needed(spark, name, columns):
    read = re.findall(r"ReadSchema: struct<([^>]*)>", plan(spark, name))
    assert {c.split(":")[0] for r in read for c in r.split(",")} == columns


@pytest.mark.parametrize("name", ["best_match", "substring_join", "fuzzy_join", "prune_stale", "feed_join", "upsert_state", "signal_score"])
def test_no_nested_loops(spark, name):
    assert not re.search("CartesianProduct|BroadcastNestedLoopJoin", plan(spark, name))


@pytest.mark.parametrize("name", ["latest_per_key", "history_top20", "best_match"])
def test_windows_are_limited_before_the_shuffle(spark, name):
    assert "WindowGroupLimit" in plan(spark, name)


@pytest.mark.parametrize("name", ["feed_page", "due_queue", "review_queue_nulls_first", "rotation_lru"])
def test_pages_are_top_k(spark, name):
    assert "TakeOrderedAndProject" in plan(spark, name)


def test_filters_are_pushed(spark):
    assert re.search(r"PushedFilters: \[.*l_returnflag", plan(spark, "review_queue_nulls_first"))
