"""Document fingerprints: one-permutation MinHash with optimal densification.

All of it is DataFrame functions.  Words are runs of anything but the contract's
white space, A-Z lowered; shingles are five words (the whole sequence if there
are fewer).  Each shingle is hashed once; the top bits of the hash are its bin and
the least hash of a bin is its value.  An empty bin borrows from a bin that its own
seeded permutation of the bins meets first, so every filled bin is equally likely.
The fingerprint is the low ``BITS`` bits of every bin, one hex digit each.  The
likeness of two fingerprints is the share of equal digits, corrected for those that
are equal by chance (one in 16).

Defined results: a null text counts as empty; a text without words has the
fingerprint of the single empty shingle; likeness to a next document that is missing
(a table of one row) is to the row itself; rows are in order of doc_id (null first),
then text; doc_id is an integer; an empty table gives no rows.  Rows of one doc_id, and those
without any, are neighbours and so are sorted in one task.
"""

from __future__ import annotations

import json
import math
import random

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from namelens.llm.common import SPACE, text_of

SHINGLE = 5
#: Bins (a power of two, one hex digit each) and the bits kept of each.
BINS, BITS = 256, 4
_SHIFT = 63 - 8
#: Bin j's permutation meets bin START[j] + t * odd at step t, modulo BINS; INVERSE[j] is the inverse of that odd number.
_random = random.Random(256)
START = [_random.randrange(BINS) for _ in range(BINS)]
_ODD = [2 * _random.randrange(BINS // 2) + 1 for _ in range(BINS)]
INVERSE = [pow(odd, -1, BINS) for odd in _ODD]
#: The bins of every permutation's first steps; in a text that fills most bins one of them nearly always is.
FIRST_STEPS = [[(START[j] + t * _ODD[j]) % BINS for j in range(BINS)] for t in range(8)]
#: Rows that a bucket of neighbouring documents should have, and buckets at most (their first ids are part of the plan).
BUCKET, BUCKETS = 1000, 65_536


def _words(text: Column) -> Column:
    lowered = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.filter(F.split(lowered, SPACE + "+"), lambda w: w != "")


def _shingle_hashes(h: str) -> Column:
    """Non-negative 63-bit hashes of all shingles, from the column h of the words' hashes."""
    n = F.size(h)
    at = F.sequence(F.lit(0), F.greatest(n - SHINGLE, F.lit(0)))
    long = F.transform(at, lambda i: F.shiftrightunsigned(F.xxhash64(*(F.get(F.col(h), i + k) for k in range(SHINGLE))), 1))
    return F.when(n >= SHINGLE, long).otherwise(F.array(F.shiftrightunsigned(F.xxhash64(F.col(h)), 1)))


def _bin(x: Column) -> Column:
    return F.shiftright(x, _SHIFT).cast("int")


def bin_values(df: DataFrame, text: str, out: str) -> DataFrame:
    """df with ``out``: the densified values of all bins of the text column."""
    last = (1 << _SHIFT) - 1
    # the largest value of every bin stands for an empty one, so each bin has a first value after the sort
    marks = F.transform(F.sequence(F.lit(0), F.lit(BINS - 1)), lambda b: F.shiftleft(b.cast("long"), _SHIFT) + F.lit(last))
    df = df.withColumn(out, F.transform(_words(F.col(text)), lambda w: F.xxhash64(w)))
    df = df.withColumn(out, _shingle_hashes(out))
    df = df.withColumn(out, F.sort_array(F.concat(F.col(out), marks)))
    df = df.withColumn(out, F.filter(F.col(out), lambda x, i: (i == 0) | (_bin(x) != _bin(F.get(F.col(out), i - 1)))))
    df = df.withColumn(out, F.transform(F.col(out), lambda x: F.when(x.bitwiseAND(F.lit(last)) != last, x)))
    value = F.col(out)

    def borrowed(j: Column) -> Column:
        """The value of the filled bin that the permutation of bin j meets first: by its first steps, else by the least step of all."""
        filled = F.filter(F.sequence(F.lit(0), F.lit(BINS - 1)), lambda b: F.get(value, b).isNotNull())
        steps = F.transform(filled, lambda b: F.pmod((b - F.get(F.lit(START), j)) * F.get(F.lit(INVERSE), j), F.lit(BINS)) * BINS + b)
        return F.coalesce(*[F.get(value, F.get(F.lit(bins), j)) for bins in FIRST_STEPS], F.get(value, F.pmod(F.array_min(steps), F.lit(BINS))))

    return df.withColumn(out, F.transform(value, lambda x, j: F.coalesce(x, borrowed(j))))


def fingerprint(values: Column) -> Column:
    """The packed low bits of all bins, a hex digit a bin."""
    return F.lower(F.array_join(F.transform(values, lambda x: F.hex(x.bitwiseAND(F.lit((1 << BITS) - 1)))), ""))


def likeness(a: Column, b: Column) -> Column:
    """The corrected share of equal digits of two fingerprints, from 0 to 1."""
    same = F.size(F.filter(F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: x == y), lambda s: s)) / F.lit(float(BINS))
    chance = 2.0**-BITS
    return F.greatest(F.lit(0.0), (same - chance) / (1 - chance))


def _buckets(docs: DataFrame) -> DataFrame:
    """docs with bucket, whole ranges of doc_id in order, and with each bucket's first rows twice.

    The second copy (edge is true) goes to the end of the bucket before, or of the last
    one, so that every row's next one is in its own bucket.  The ranges start at quantiles of
    the ids, so they hold about as many rows each wherever the ids lie.
    """
    n, low = docs.agg(F.count("doc_id"), F.min("doc_id")).first()
    buckets = min(BUCKETS, -(-n // BUCKET))
    bounds: list[int] = []
    if buckets > 1:
        found = docs.agg(F.percentile_approx("doc_id", [i / buckets for i in range(1, buckets)], 20 * buckets)).first()[0]
        bounds = sorted({b for b in found if b > low})  # ids that occur, so that no bucket is empty
    # the bucket of an id: the bounds up to it, counted in two steps of about the square root of them
    step = max(1, math.isqrt(len(bounds)))
    groups = [bounds[i : i + step] for i in range(0, len(bounds), step)]
    upto = lambda array: F.size(F.filter(array, lambda b: b <= F.col("doc_id")))
    heads, rest = (F.from_json(F.lit(json.dumps(x)), kind) for x, kind in (([g[0] for g in groups], "array<bigint>"), (groups, "array<array<bigint>>")))
    placed = docs.withColumn("group", F.coalesce(upto(heads), F.lit(0)))
    place = F.when(F.col("group") > 0, (F.col("group") - 1) * step + upto(F.get(rest, F.col("group") - 1))).otherwise(0)
    placed = placed.withColumn("bucket", F.when(F.col("doc_id").isNull(), 0).otherwise(place).cast("int")).drop("group")
    firsts = placed.groupBy("bucket").agg(F.min(F.struct(F.col("doc_id").isNotNull().alias("known"), "doc_id")).alias("first"))
    back = F.when(F.col("bucket") == 0, F.lit(len(bounds))).otherwise(F.col("bucket") - 1)
    known = placed.join(F.broadcast(firsts.select(F.col("bucket").alias("b"), "first.doc_id").withColumnRenamed("doc_id", "first_id")), F.col("bucket") == F.col("b")).drop("b")
    is_first = F.col("doc_id").eqNullSafe(F.col("first_id"))
    copies = F.when(is_first, F.array(F.struct(F.col("bucket").alias("bucket"), F.lit(False).alias("edge")), F.struct(back.alias("bucket"), F.lit(True).alias("edge")))).otherwise(F.array(F.struct(F.col("bucket").alias("bucket"), F.lit(False).alias("edge"))))
    return known.withColumn("place", F.explode(copies)).select("doc_id", "text", "place.bucket", "place.edge")


def fingerprints(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, fingerprint of every row of docs."""
    rows = docs.select("doc_id", text_of(text).alias("text"))
    return bin_values(rows, "text", "v").select("doc_id", fingerprint(F.col("v")).alias("fingerprint"))


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edited text, and their likeness.

    doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.
    Texts are shuffled once, to their bucket, with their fingerprint.
    """
    rows = _buckets(docs.select("doc_id", text_of().alias("text")))
    rows = bin_values(rows, "text", "v").withColumn("fingerprint", fingerprint(F.col("v"))).drop("v")
    along = Window.partitionBy("bucket").orderBy("edge", F.col("doc_id").asc_nulls_first(), "text")
    rows = rows.withColumn("next_text", F.coalesce(F.lead("text").over(along), F.col("text"))).withColumn("next_fingerprint", F.coalesce(F.lead("fingerprint").over(along), F.col("fingerprint")))
    edited = F.concat(F.expr("substring(text, 1, length(text) - int(floor(length(text) / 2)))"), F.expr("substring(next_text, 1, int(floor(length(text) / 2)))"))
    rows = rows.where("NOT edge").withColumn("edited", edited)
    rows = bin_values(rows, "edited", "v").withColumn("edited_fingerprint", fingerprint(F.col("v")))
    return rows.select(
        "doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"), likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"),
    )
