"""Mixing sources to target weights: capped water-filling and seeded repetition.

Everything is DataFrame work.  Each source has a size (its words) and a weight.
Targets share a budget by weight; a source whose share is above ``max_epochs``
times its size is clamped there, and the excess goes to the others by weight,
until none is above.  A source of target t and size s then takes each document
floor(t / s) times, and a seeded part of its documents once more: the documents
in order of a seeded hash, as long as the middle of the next one lies within
the words that are still to be taken.

Defined results: a null text has size 0; a null source is a source of its own,
last in order; rows without words take 0 words; an empty table gives no rows;
rows equal in doc_id and text have one hash, so they are taken together.
Columns of the input other than those used pass through ``mixed_documents``
untouched, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from namelens.llm.common import NOT_SPACE, checkpoint, text_of

#: Sources up to which the table of targets is broadcast (about 100 bytes a source).
BROADCAST_SOURCES = 100_000
#: Rows that a source's bucket of the seeded hash should have if all rows were of that source.
BUCKET = 65_536


def bucket_digits(rows: int) -> int:
    """Hex digits of the seeded hash that make a bucket: 4096 buckets a source, and more as the table grows."""
    return next((d for d in range(3, 8) if rows <= BUCKET * 16**d), 8)


def _size():
    return F.regexp_count(text_of(), F.lit(NOT_SPACE)).cast("long")


def _order(seed: int):
    """The seeded hash that orders the documents of a source."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("doc_id").cast("string"), F.md5(text_of())))


def sized(docs: DataFrame, seed: int) -> DataFrame:
    return docs.select("doc_id", F.col("source").cast("string").alias("source"), _size().alias("size"), _order(seed).alias("h"))


def source_sizes(rows: DataFrame) -> DataFrame:
    """source, source_size and nth, its place by code point from 0, null last; sorted by ranges, not in one task."""
    ordered = checkpoint(
        rows.groupBy("source").agg(F.sum("size").alias("source_size"))
        .orderBy(F.col("source").isNull(), "source")
        .select("source", "source_size", F.monotonically_increasing_id().alias("at"))
    )
    part = F.shiftright("at", 33)
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = ordered.groupBy(part.alias("part")).agg(F.count("*").alias("n")).withColumn("first", F.coalesce(F.sum("n").over(before), F.lit(0)))
    nth = F.col("first") + F.col("at").bitwiseAND(F.lit((1 << 33) - 1))
    return ordered.withColumn("part", part).join(F.broadcast(parts), "part").select("source", "source_size", nth.alias("nth"))


def fill_targets(sizes: DataFrame, budget_ratio: float = 1.5, max_epochs: float = 2.0) -> DataFrame:
    """Add target to (source, source_size, weight) by capped water-filling.

    A round is one aggregate over the sources: it clamps all that are above at the
    present level.  The level rises with each round, so clamped sources stay so.
    """
    total = sizes.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0]
    budget, level = total * float(budget_ratio), 0.0
    cap = F.col("source_size") * F.lit(float(max_epochs))
    while True:
        over = cap < F.col("weight") * F.lit(level)
        fixed, weight = sizes.agg(F.coalesce(F.sum(F.when(over, cap)), F.lit(0.0)), F.coalesce(F.sum(F.when(~over, F.col("weight"))), F.lit(0))).first()
        if not weight:
            break
        above = (budget - fixed) / weight
        if above <= level:
            break
        level = above
    return sizes.withColumn("target", F.when(cap < F.col("weight") * F.lit(level), cap).otherwise(F.col("weight") * F.lit(level)))


def mixture(rows: DataFrame, cycle: tuple[int, ...] = (3, 1, 2), budget_ratio: float = 1.5, max_epochs: float = 2.0) -> DataFrame:
    """One row per source: source_size, target, whole (times all of it is taken), cut (hashes up to it are taken once more)."""
    sizes = source_sizes(rows)
    weights = F.element_at(F.array(*[F.lit(w) for w in cycle]), (F.col("nth") % len(cycle) + 1).cast("int"))
    targets = fill_targets(sizes.withColumn("weight", weights), budget_ratio, max_epochs).withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")).withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size"))
    digits = bucket_digits(rows.count())
    buckets = rows.groupBy("source", F.substring("h", 1, digits).alias("bucket")).agg(F.sum("size").alias("in_bucket"))
    along = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    edge = (
        buckets.withColumn("upto", F.sum("in_bucket").over(along))
        .join(F.broadcast(targets.select(F.col("source").alias("s"), "rest")) if _small(targets) else targets.select(F.col("source").alias("s"), "rest"), F.col("source").eqNullSafe(F.col("s")))
        .where((F.col("upto") >= F.col("rest")) & (F.col("rest") > 0))
        .groupBy("source").agg(F.min(F.struct("bucket", (F.col("upto") - F.col("in_bucket")).alias("before"), "rest")).alias("edge"))
        .select(F.col("source").alias("s"), "edge.*")
    )
    edge = checkpoint(edge)
    inside = rows.join(F.broadcast(edge) if _small(targets) else edge, F.col("source").eqNullSafe(F.col("s")) & (F.substring("h", 1, digits) == F.col("bucket")))
    by_hash = Window.partitionBy("s").orderBy("h", "size").rowsBetween(Window.unboundedPreceding, 0)
    taken = (
        inside.withColumn("upto", F.col("before") + F.sum("size").over(by_hash))
        .groupBy("s").agg(F.max(F.when(2 * F.col("upto") - F.col("size") <= 2 * F.col("rest"), F.col("h"))).alias("last"), F.first("bucket").alias("bucket"))
        .select("s", F.coalesce("last", "bucket").alias("cut"))
    )
    return checkpoint(targets.join(taken, F.col("source").eqNullSafe(F.col("s")), "left").drop("s"))


def _small(targets: DataFrame) -> bool:
    return targets.count() <= BROADCAST_SOURCES


def _with_plan(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """Rows with their source's plan; beyond the bound of the broadcast Spark shuffles and splits hot sources."""
    plan = plan.select(F.col("source").alias("plan_source"), "source_size", "target", "whole", "cut")
    joined = rows.join(F.broadcast(plan) if _small(plan) else plan, F.col("mix_source").eqNullSafe(F.col("plan_source")))
    times = F.col("whole") + F.when(F.col("mix_h") <= F.col("cut"), 1).otherwise(0)
    return joined.withColumn("mix_times", times)


def mix(docs: DataFrame, cycle: tuple[int, ...] = (3, 1, 2), budget_ratio: float = 1.5, max_epochs: float = 2.0, seed: int = 17) -> DataFrame:
    """doc_id, size, source_size, target, taken (words with repeats) for every row of docs."""
    rows = checkpoint(sized(docs, seed))
    plan = mixture(rows, cycle, budget_ratio, max_epochs)
    out = _with_plan(rows.withColumnsRenamed({"source": "mix_source", "h": "mix_h"}), plan)
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("mix_times")).alias("taken"))


def mixed_documents(docs: DataFrame, cycle: tuple[int, ...] = (3, 1, 2), budget_ratio: float = 1.5, max_epochs: float = 2.0, seed: int = 17) -> DataFrame:
    """The rows of docs, each as often as the mix takes it, with the columns of docs only.

    Texts are never shuffled: a row's times follow from its hash and its source's plan.
    """
    plan = mixture(checkpoint(sized(docs, seed)), cycle, budget_ratio, max_epochs)
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("mix_row"), F.col("source").cast("string").alias("mix_source"), _order(seed).alias("mix_h"))
    repeated = _with_plan(packed, plan).where("mix_times > 0").withColumn("mix_copy", F.explode(F.sequence(F.lit(1), F.col("mix_times").cast("int"))))
    return repeated.select("mix_row.*")


#: The same in DuckDB: one window a source, and the clamped sources as a prefix by size over weight.
ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         md5(concat_ws(':', '17', CAST(doc_id AS VARCHAR), md5(coalesce(text, '')))) AS h
  FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         CAST([3, 1, 2][1 + (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3] AS BIGINT) AS w
  FROM d GROUP BY source
), r AS (
  SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(2.0::DOUBLE * source_size) OVER (ORDER BY source_size * 2.0::DOUBLE / w, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(w) OVER (ORDER BY source_size * 2.0::DOUBLE / w, source IS NULL, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lvl
  FROM s
), l AS (
  SELECT coalesce(max(lvl) FILTER (WHERE w * lvl <= 2.0::DOUBLE * source_size), 1e300::DOUBLE) AS lvl FROM r
), t AS (
  SELECT source, source_size, least(2.0::DOUBLE * source_size, w * l.lvl) AS target FROM s, l
), u AS (
  SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS whole FROM t
), c AS (
  SELECT d.*, sum(size) OVER (PARTITION BY source ORDER BY h, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto FROM d
)
SELECT c.doc_id, c.size, u.source_size, u.target,
       CAST(c.size * (u.whole + CASE WHEN 2 * c.upto - c.size <= 2 * (u.target - u.whole * u.source_size) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM c JOIN u ON c.source IS NOT DISTINCT FROM u.source
"""
