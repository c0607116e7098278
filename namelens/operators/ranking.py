"""Latest rows, queues, rotation and round robin: orderings with explicit ties.

Defined results: null keys and groups are keys like any other; rows without a time are the
last; of rows equal in all that orders them Spark takes any; empty tables give no rows.
Columns of the input keep their values, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from namelens import constants as C


def latest_per_key(df: DataFrame, key: str, at: str, tie: str) -> DataFrame:
    """The row of each key with the latest ``at``; of equal ones that with the largest ``tie``."""
    return history(df, key, at, tie, 1)


def free(df: DataFrame, name: str) -> str:
    """The name, or a longer one that no column of df has."""
    while name in df.columns:
        name += "_"
    return name


def history(df: DataFrame, key: str, at: str, tie: str, n: int = 20) -> DataFrame:
    """The n latest rows of each key.  Spark keeps n rows a key and task before the shuffle."""
    place = free(df, "place")
    rows = df.withColumn(place, F.row_number().over(Window.partitionBy(key).orderBy(F.desc_nulls_last(at), F.desc(tie))))
    return rows.where(F.col(place) <= n).drop(place)


def earliest_in_batch(df: DataFrame, keys: list[str], at: str, ordinal: str) -> DataFrame:
    """One row a key: the first by ``ordinal`` if its ``at`` is null, else the earliest, else the first of these.

    Two minima that combine before the shuffle; rows of a key never meet in one task.
    """
    row = F.struct(*df.columns)
    found = df.groupBy(*keys).agg(F.min_by(row, ordinal).alias("first"), F.min(F.when(F.col(at).isNotNull(), F.struct(at, ordinal, row.alias("row")))).alias("early"))
    chosen = F.when(F.col(f"first.{at}").isNull(), F.col("first")).otherwise(F.col("early.row"))
    return found.select(chosen.alias("r")).select("r.*")


def page(df: DataFrame, order: list[Column], offset: int = 0, limit: int = C.PAGE_SIZE) -> DataFrame:
    """A page of an ordered table, with offset and limit held within their bounds."""
    return df.orderBy(*order).offset(clamp(offset, 0, C.MAX_OFFSET)).limit(clamp(limit, 1, C.MAX_PAGE_SIZE))


def page_with_total(df: DataFrame, order: list[Column], offset: int = 0, limit: int = C.PAGE_SIZE) -> DataFrame:
    """A page of the table, each row with ``total``, the exact number of rows of the whole table.

    The total is a scalar subquery, so that the page stays a top-k.
    """
    return page(df, order, offset, limit).select("*", df.agg(F.count("*")).scalar().alias(free(df, "total")))


def brand_listing(brands: DataFrame) -> DataFrame:
    """Active brands by category and name."""
    return brands.where("active").orderBy("category", "name")


def clamp(value: float, low: int, high: int) -> int:
    """The value rounded down and held between low and high; low for anything that isn't a number."""
    if value != value or value in (float("inf"), float("-inf")):
        return low
    return max(low, min(high, int(value // 1)))


def due(candidates: DataFrame, as_of: Column, n: int = 25) -> DataFrame:
    """Candidates to look at again: new ones first, then by the time that they are due."""
    rows = candidates.where((F.col("next_recheck_at") <= as_of) & (F.col("status") != "retired") & (F.col("publish_state") != "cleared"))
    return rows.orderBy("status", "next_recheck_at", "id").limit(n)


def review_queue(rows: DataFrame, n: int = 100) -> DataFrame:
    """Pending candidates by falling score; those without a score come first."""
    return rows.where("publish_state = 'pending_review'").orderBy(F.desc_nulls_first("score"), "id").limit(n)


def open_reports(reports: DataFrame, n: int = 50) -> DataFrame:
    return reports.where("status = 'open'").orderBy("created_at", "id").limit(n)


def least_recent(df: DataFrame, at: str, ordinal: str, n: int) -> DataFrame:
    """The n rows that were used longest ago; never used ones first, then in their order."""
    return df.orderBy(F.asc_nulls_first(at), F.asc(ordinal)).limit(n)


def round_robin(df: DataFrame, group: str, ordinal: str, n: int | None = None) -> DataFrame:
    """One row of each group in turn, groups in order of their first row; rows without a group are a group.

    Adds depth (the row's turn in its group) and group_ord, in place of columns of these names.
    With n no row deeper than n can be among the first n, so Spark keeps n rows a group and task
    before the shuffle; the place of a group is an aggregate that is joined.
    """
    rows = df.withColumn("depth", F.row_number().over(Window.partitionBy(group).orderBy(ordinal)))
    if n is not None:
        rows = rows.where(F.col("depth") <= n)
    of = free(df, "of")
    groups = df.groupBy(F.col(group).alias(of)).agg(F.min(ordinal).alias("group_ord"))
    rows = rows.drop("group_ord").join(groups, F.col(group).eqNullSafe(F.col(of))).drop(of).orderBy("depth", "group_ord")
    return rows if n is None else rows.limit(n)
