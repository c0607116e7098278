"""Exact dedup: counting quotient filters a partition, merged by sorted remainders.

A 64-bit fingerprint splits into a range (the key of the shuffle), a quotient
and a remainder.  Each partition builds the counting quotient filter of every
range that it has: the occupied quotients, the length of each quotient's run,
the sorted remainders and their counts.  Filters of one range merge without
loss, since quotient and remainder give the fingerprint back: the sorted runs of
two filters are merged at a time, in the manner of a merge sort, and counts of
equal remainders are added.  Fingerprints with a count above one route their rows
to verification: rows are grouped by the SHA-256 of the whole normalised text, and
a group's texts are compared byte by byte, through their least and their largest
one, of which a partition sends one each; the other rows are kept at once.

Defined results: a null text counts as empty; empty texts are equal to each
other; a null doc_id is larger than any other; of rows equal in doc_id and
length of the text one is kept, that with the smallest SHA-256 of the text as it
came; of rows equal in that too exactly one; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from namelens.llm.common import SPACE, checkpoint, text_of

QUOTIENT_BITS = 16
#: Fingerprints that the filters of one range should have; the number of ranges follows from the rows.
RANGE = 1 << 20
#: Fingerprints that a partition gathers before it folds them into sorted counts.
FOLD = 1 << 20
FILTER = "span int, quotients binary, runs binary, remainders binary, counts binary"


def normalised():
    """The text without any character of the contract's white space."""
    return F.regexp_replace(text_of(), F.lit(SPACE + "+"), F.lit(""))


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, fp, sha (of the normalised text), n (code points of the text), plain (SHA-256 of it), row (a number of its own)."""
    rows = docs.select("doc_id", normalised().alias("t"), text_of().alias("text"))
    rows = rows.select("doc_id", F.xxhash64("t").alias("fp"), F.sha2("t", 256).alias("sha"), F.length("text").cast("long").alias("n"), F.sha2("text", 256).alias("plain"))
    return checkpoint(rows.withColumn("row", F.monotonically_increasing_id()))


def _folded(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, int)
    return keys[first], np.add.reduceat(counts[order], first) if len(first) else counts


def build_filters(range_bits: int):
    """A function for mapInArrow: fingerprints of a partition to one filter a range."""
    remainder_bits = 64 - range_bits - QUOTIENT_BITS

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts, fresh, n = np.zeros(0, np.uint64), np.zeros(0, np.int64), [], 0
        for batch in batches:
            fresh.append(batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64))
            n += len(fresh[-1])
            if n >= FOLD:
                more = np.concatenate(fresh)
                keys, counts = _folded(np.r_[keys, more], np.r_[counts, np.ones(len(more), np.int64)])
                fresh, n = [], 0
        if n:
            more = np.concatenate(fresh)
            keys, counts = _folded(np.r_[keys, more], np.r_[counts, np.ones(len(more), np.int64)])
        if not len(keys):
            return
        spans = keys >> np.uint64(64 - range_bits)
        quotients = ((keys >> np.uint64(remainder_bits)) & np.uint64((1 << QUOTIENT_BITS) - 1)).astype(np.uint16)
        remainders = keys & np.uint64((1 << remainder_bits) - 1)
        edges = np.r_[np.flatnonzero(np.r_[True, spans[1:] != spans[:-1]]), len(keys)]
        out: dict[str, list] = {"span": [], "quotients": [], "runs": [], "remainders": [], "counts": []}
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            occupied, runs = np.unique(quotients[a:b], return_counts=True)
            out["span"].append(int(spans[a]))
            out["quotients"].append(occupied.tobytes())
            out["runs"].append(runs.astype(np.uint32).tobytes())
            out["remainders"].append(remainders[a:b].tobytes())
            out["counts"].append(counts[a:b].tobytes())
        yield pa.RecordBatch.from_pydict({k: pa.array(v, pa.int32() if k == "span" else pa.binary()) for k, v in out.items()})

    return build


def _merged(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Two sorted runs of (keys, counts) as one; the places in the result follow by binary search, and nothing is sorted again."""
    at = np.arange(len(b[0])) + np.searchsorted(a[0], b[0], side="right")
    keys, counts = np.empty(len(a[0]) + len(b[0]), np.uint64), np.empty(len(a[0]) + len(b[0]), np.int64)
    rest = np.ones(len(keys), bool)
    rest[at] = False
    keys[at], counts[at] = b
    keys[rest], counts[rest] = a
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    return keys[first], np.add.reduceat(counts, first)


def merge_filters(range_bits: int):
    """A function for applyInArrow: all filters of a range to the fingerprints whose count is above one."""
    remainder_bits = 64 - range_bits - QUOTIENT_BITS

    def merge(key: tuple, filters: pa.Table) -> pa.Table:
        runs = []
        for quotients, lengths, remainders, n in zip(*(filters.column(c) for c in ("quotients", "runs", "remainders", "counts")), strict=True):
            quotient = np.repeat(np.frombuffer(quotients.as_py(), np.uint16), np.frombuffer(lengths.as_py(), np.uint32)).astype(np.uint64)
            runs.append(((quotient << np.uint64(remainder_bits)) | np.frombuffer(remainders.as_py(), np.uint64), np.frombuffer(n.as_py(), np.int64)))
        while len(runs) > 1:
            runs = [_merged(*runs[i : i + 2]) if i + 1 < len(runs) else runs[i] for i in range(0, len(runs), 2)]
        merged, total = runs[0]
        again = merged[total > 1] | (np.uint64(key[0].as_py()) << np.uint64(64 - range_bits))
        return pa.table({"fp": again.view(np.int64), "n_fp": total[total > 1]})

    return merge


def repeated_fingerprints(rows: DataFrame) -> DataFrame:
    """fp, n_fp: the fingerprints that more than one row has."""
    range_bits = min(24, max(6, (rows.count() // RANGE).bit_length()))
    filters = rows.select("fp").mapInArrow(build_filters(range_bits), FILTER)
    return filters.groupBy("span").applyInArrow(merge_filters(range_bits), "fp long, n_fp long")


def compare_bytes(docs: DataFrame, again: DataFrame) -> None:
    """Compare the texts of the routed fingerprints (fp) byte by byte in each group of one SHA-256; unequal ones are an error."""
    texts = docs.select(normalised().alias("t")).select("t", F.xxhash64("t").alias("fp"), F.sha2("t", 256).alias("sha")).join(again, "fp", "left_semi")
    unlike = texts.groupBy("sha").agg(F.min("t").alias("least"), F.max("t").alias("largest")).where("least <> largest")
    if not unlike.isEmpty():
        raise ArithmeticError("different texts have one SHA-256")


def groups_of(docs: DataFrame) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256, original_sha256 for every row of docs, dropped ones too."""
    rows = digests(docs)
    again = checkpoint(repeated_fingerprints(rows).select("fp"))
    compare_bytes(docs, again)
    routed = rows.join(again, "fp", "left_semi")
    best = F.struct((-F.col("n")).alias("n"), F.col("doc_id").isNull().alias("null"), "doc_id", "plain", "row")
    # written, so that the join below shuffles both sides plainly and Spark can split a hot text's rows
    verified = checkpoint(routed.groupBy("sha").agg(F.min(best).alias("keep"), F.count("*").alias("size")))
    out = rows.join(verified, "sha", "left")
    alone = F.col("keep").isNull()
    return out.select(
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("keep.doc_id")).alias("keep_id"),
        F.coalesce("size", F.lit(1)).cast("long").alias("group_size"),
        (alone | (F.col("keep.row") == F.col("row"))).alias("kept"),
        F.col("sha").alias("text_sha256"), F.col("plain").alias("original_sha256"),
    )


def drop_rows(docs: DataFrame, dropped: DataFrame, key) -> DataFrame:
    """docs without the rows whose (doc_id, key) is in dropped; the columns of docs only.

    key: the SHA-256 of the text as it came.  dropped: doc_id, key, repeated (true: rows of
    that doc_id and key are one row many times; of them the one stays whose other columns
    have the smallest hash).  Its rows may be as many as the documents', so Spark chooses
    the join by size.
    """
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("kept_row"), F.col("doc_id").alias("k_id"), key.alias("k_key"))
    match = lambda d: F.col("k_id").eqNullSafe(d["doc_id"]) & (F.col("k_key") == d["key"])
    gone = dropped.where("NOT repeated")
    packed = packed.join(gone, match(gone), "left_anti")
    again = dropped.where("repeated").select("doc_id", "key").distinct()
    if again.isEmpty():
        return packed.select("kept_row.*")
    once = packed.join(again, match(again), "left_semi").groupBy("k_id", "k_key").agg(F.min_by("kept_row", F.sha2(F.to_json("kept_row"), 256)).alias("kept_row"))
    return packed.join(again, match(again), "left_anti").select("kept_row.*").unionByName(once.select("kept_row.*"))


def deduplicated(docs: DataFrame) -> DataFrame:
    """The rows of docs that stay by groups_of, with the columns of docs."""
    found = checkpoint(groups_of(docs))
    gone = found.where("NOT kept").select("doc_id", F.col("original_sha256").alias("key"))
    # a row that goes may equal the row that stays in doc_id and text
    stays = found.where("kept AND group_size > 1").select(F.col("doc_id").alias("s_id"), F.col("original_sha256").alias("s_key"), F.lit(True).alias("stays"))
    dropped = gone.join(stays, F.col("doc_id").eqNullSafe(F.col("s_id")) & (F.col("key") == F.col("s_key")), "left").select("doc_id", "key", F.coalesce("stays", F.lit(False)).alias("repeated"))
    return drop_rows(docs, checkpoint(dropped.distinct()), F.sha2(text_of(), 256))


ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g')) AS sha, sha256(coalesce(text, '')) AS plain, row_number() OVER () AS r
  FROM documents
), k AS (
  SELECT *, row_number() OVER (PARTITION BY sha ORDER BY n DESC, doc_id NULLS LAST, plain, r) AS nth, count(*) OVER (PARTITION BY sha) AS size,
         first_value(doc_id) OVER (PARTITION BY sha ORDER BY n DESC, doc_id NULLS LAST, plain, r) AS keep_id
  FROM d
)
SELECT doc_id, keep_id, CAST(size AS BIGINT) AS group_size, nth = 1 AS kept, sha AS text_sha256, plain AS original_sha256 FROM k
"""
