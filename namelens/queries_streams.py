"""Registered queries of the streaming side: state by increments, timers, windows and sessions.

Each runs its stream over a given table to the end, and returns what the stream has written
to a folder that the cluster shares.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from namelens.queries import query, read
from namelens.streaming import ingest, timers
from namelens.streaming.snapshots import Snapshots, shared_folder


def _streamed(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table as a stream, whether it is a file or a folder of files."""
    return spark.readStream.schema(read(spark, sf_dir, name).schema).parquet(f"{sf_dir}/{name}.parquet*")


def _written(rows: DataFrame, mode: str = "append") -> DataFrame:
    """Run a stream to its end, and read what it gave."""
    spark = rows.sparkSession
    folder = shared_folder(spark, "stream")
    writer = rows.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/checkpoint").outputMode(mode)
    writer.trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(rows.schema).parquet(f"{folder}/out")


@query("SELECT o_custkey, count(*) AS n, CAST(sum(round(o_totalprice * 100)) AS BIGINT) AS cents, strftime(max(o_orderdate), '%Y-%m-%d') AS last_day FROM orders GROUP BY o_custkey")
def incremental_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders by customer, each year a batch of an incremental snapshot; the first batch runs twice, as after a failure."""
    orders = read(spark, sf_dir, "orders").select("o_custkey", F.year("o_orderdate").alias("year"), F.round(F.col("o_totalprice") * 100).cast("long").alias("cents"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("last_day"))
    state = Snapshots(spark, shared_folder(spark, "orders"), "o_custkey long, n long, cents long, last_day string", "o_custkey", 16)
    years = sorted(r[0] for r in orders.select("year").distinct().collect())
    for number, year in enumerate([*years[:1], *years]):
        delta = orders.where(F.col("year") == year).select("o_custkey", F.lit(1).cast("long").alias("n"), "cents", "last_day")
        state.apply(max(0, number - 1), delta.select("o_custkey"), lambda old, delta=delta: old.unionByName(delta).groupBy("o_custkey").agg(*[f(c).alias(c) for f, c in ((F.sum, "n"), (F.sum, "cents"), (F.max, "last_day"))]))
    return state.read()


_DUE_AT = "o_orderdate + INTERVAL 1 DAY * (o_orderkey % 900)"


@query(f"SELECT o_orderkey AS id, strftime({_DUE_AT}, '%Y-%m-%d') AS due_day FROM orders WHERE o_orderstatus <> 'F' AND {_DUE_AT} <= (SELECT max(o_orderdate) FROM orders)")
def due_timers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stream of orders as candidates; those with status F are retired, and the clock is that of the orders."""
    orders = _streamed(spark, sf_dir, "orders").withColumn("o_orderdate", F.col("o_orderdate").cast("timestamp")).withWatermark("o_orderdate", "0 seconds")
    due = F.col("o_orderdate") + F.make_dt_interval(days=(F.col("o_orderkey") % 900).cast("int"))
    rows = orders.select(
        F.concat(F.col("o_orderkey").cast("string"), F.lit(".com")).alias("domain"), F.col("o_orderkey").alias("id"), F.when(F.col("o_orderstatus") == "F", "retired").otherwise("verified").alias("status"),
        F.lit("hidden").alias("publish_state"), due.alias("next_recheck_at"), "o_orderdate",
    )
    with timers.stores(spark):
        found = _written(timers.due_rows(timers.schedules(rows, F.unix_millis("o_orderdate")), "EventTime"))
    return found.select(F.col("id").cast("long").alias("id"), F.date_format("due_at", "yyyy-MM-dd").alias("due_day"))


_SESSIONS = """SELECT user_id, min(ts) AS started, max(ts) AS last_at, count(*) AS n FROM (
SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM (
SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) <= INTERVAL 2 HOUR THEN 0 ELSE 1 END AS fresh FROM events)) GROUP BY user_id, s"""


@query(f"SELECT user_id, epoch_us(started) AS started, epoch_us(last_at) AS last_at, n FROM ({_SESSIONS})")
def user_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of a user that are less than two hours apart."""
    found = ingest.sessions(read(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp")), "user_id", "ts", "2 hours")
    return found.select("user_id", F.unix_micros("started").alias("started"), F.unix_micros("last_at").alias("last_at"), "n")


@query("SELECT strftime(w, '%Y-%m-%d %H') AS hour, count(*) AS n FROM (SELECT unnest([date_trunc('hour', ts), date_trunc('hour', ts) - INTERVAL 1 HOUR, date_trunc('hour', ts) - INTERVAL 2 HOUR]) AS w FROM events) GROUP BY 1")
def sliding_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events by windows of three hours, one beginning each hour."""
    rows = read(spark, sf_dir, "events").select(F.col("ts").cast("timestamp").alias("first_seen_at"))
    return ingest.counts_by_window(rows, "3 hours", slide="1 hour").select(F.date_format("window.start", "yyyy-MM-dd HH").alias("hour"), F.col("count").alias("n"))
