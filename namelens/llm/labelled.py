"""Labels: the held-out rule and the bounded sample that classifiers are fitted on."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from namelens.llm.common import text_of


def held_out():
    """Rows that no model learns from: crc32 of doc_id as text is divisible by 5."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, most: int) -> DataFrame:
    """doc_id, text, label (0 or 1) of about ``most`` labelled rows at most, none of them held out.

    Rows are taken by the hash of doc_id.  Of rows with one text one counts, so that
    copies don't weigh more.  The chosen ids, about ``most`` of them, are broadcast.
    """
    known = labels.select(F.col("doc_id"), F.col(label).cast("int").alias("label")).where(F.col("label").isin(0, 1) & F.col("doc_id").isNotNull()).where(~held_out())
    share = most / max(1, known.count())
    chosen = known.where(F.pmod(F.xxhash64(F.lit("sample"), "doc_id"), F.lit(1_000_000)) < int(min(1.0, share) * 1_000_000))
    chosen = chosen.groupBy("doc_id").agg(F.max("label").alias("label"))
    rows = docs.select("doc_id", text_of().alias("text")).join(F.broadcast(chosen), "doc_id")
    return rows.groupBy(F.xxhash64("text").alias("of_text")).agg(F.min(F.struct("doc_id", "label", "text")).alias("r")).select("r.*")
