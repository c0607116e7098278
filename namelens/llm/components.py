"""Connected components of a link table, by alternating stars in DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from namelens.llm.common import checkpoint, few


def _large(links: DataFrame, n: int) -> DataFrame:
    """Each node's larger neighbours go to the smallest of its neighbours and itself."""
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    # written, here and below, so that both sides of the join are plainly shuffled and Spark can split a star's centre
    least = checkpoint(few(both.groupBy("a").agg(F.least("a", F.min("b")).alias("m")), 2 * n))
    return few(both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct(), n)


def _small(links: DataFrame, n: int) -> DataFrame:
    """Each node and its smaller neighbours go to the smallest of them.  Links have a > b."""
    least = checkpoint(few(links.groupBy("a").agg(F.min("b").alias("m")), n))
    moved = links.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return few(moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct(), 2 * n)


def connected_components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of links (a, b); root is the smallest node that it reaches.

    Links may repeat and may join a node to itself; links with a null end are left out;
    without any link there are no rows.  Each round keeps at most one row a link and is
    written to the checkpoint folder; the number of rounds grows as the logarithm of the
    longest chain.  Tables of a round have as many tasks as the links need.
    """
    links = checkpoint(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    seen = None
    while True:
        now = links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == seen or not now[0]:
            return links.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(links.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        seen = now
        links = few(links, now[0])
        links = checkpoint(_small(checkpoint(_large(links, now[0])), now[0]))
