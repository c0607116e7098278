"""Hard-negative mining by a two-dimensional block matrix multiply (SUMMA-style).

Rows are sharded into blocks of ROWS rows, sorted by label, anchors into blocks of ANCHORS, and
both into chunks of DIMS dimensions.  A grid of (anchor blocks, row blocks) deals out the
panels; each chunk of a grid cell is multiplied on its own, and its partial tiles of scores
are shuffled by (anchor block, row block) and added there as int64.  A summed tile is
reduced to what can be among the first few of each anchor, and these rows are ranked in Spark.

This is done twice: tiles of equal labels give the positives, then tiles of unequal
labels give the negatives in each positive's window.  As blocks are sorted by label, few
tiles are in both.  Every anchor is compared with every row, in blocks: the anchors are a
stated set, and the work grows with their number times that of the rows.

Defined results: rows with a null label or vector, or a null or non-finite component, take no
part; a repeated row counts again, as an anchor too; a row without id is never an anchor and the last
of equal scores; missing components of shorter vectors count as zero; components beyond
±131,072 are held at that bound, so that a score of up to 8,192 dimensions fits in an int64; an empty table
gives no rows; other columns of the input are not used.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from namelens.llm.common import checkpoint

#: Rows and anchors of a block, dimensions of a chunk, row blocks of a grid cell (about).
ROWS, ANCHORS, DIMS, GROUP = 1024, 128, 32, 8
#: Positives of an anchor, negatives of a positive, and the window of their scores in percent of the positive's.
POSITIVES, NEGATIVES, LOW, HIGH = 5, 5, 80, 100
#: Components are multiplied by SCALE and rounded down; LIMIT bounds the result.
SCALE, LIMIT = 256, 1 << 25

_PANEL = "block long, chunk int, low int, high int, n int, head binary, panel binary"
_TILE = "a_block long, b_block long, a_n int, b_n int, a_head binary, b_head binary, tile binary"
_FOUND = "anchor long, slot int, id long, score long"
#: What a block says of each of its rows; slots are the scores of an anchor's positives.
_HEAD = np.dtype([("pos", np.int64), ("id", np.int64), ("has_id", np.bool_), ("label", np.int32), ("n_slots", np.int8), ("slots", np.int64, (POSITIVES,))])


def quantised(rows: DataFrame, label: Column, vector: str = "embedding") -> DataFrame:
    """pos (a number of the row), id, label, q (floor of SCALE times each component) of the rows that take part; written."""
    finite = F.forall(vector, lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False)))  # in Spark NaN is larger than all numbers
    bounded = lambda x: F.greatest(F.lit(-2.0 * LIMIT), F.least(F.lit(2.0 * LIMIT), x.cast("double") * SCALE))
    whole = F.transform(vector, lambda x: F.greatest(F.lit(-LIMIT), F.least(F.lit(LIMIT), F.floor(bounded(x)))).cast("int"))
    kept = rows.select(F.col("vec_id").cast("long").alias("id"), label.cast("int").alias("label"), F.col(vector)).where(F.col("label").isNotNull() & F.col(vector).isNotNull() & finite)
    return checkpoint(kept.select("id", "label", whole.alias("q")).withColumn("pos", F.monotonically_increasing_id()))


def _panels(table: pa.Table, width: int) -> Iterator[pa.RecordBatch]:
    """The panels of one block, its rows by id (null last), so that the first of equal scores has the least id."""
    ids = table.column("id").combine_chunks()
    order = np.lexsort((np.asarray(ids.fill_null(0)), np.asarray(ids.is_null())))
    table = table.take(pa.array(order)).combine_chunks()
    n, ids = table.num_rows, table.column("id").combine_chunks()
    head = np.zeros(n, _HEAD)
    head["pos"], head["label"] = table.column("pos").to_numpy(), table.column("label").to_numpy()
    head["id"], head["has_id"] = np.asarray(ids.fill_null(0)), ~np.asarray(ids.is_null())
    for i, slots in enumerate(table.column("slots").to_pylist()):
        head["n_slots"][i] = len(slots or ())
        head["slots"][i, : len(slots or ())] = slots or ()
    vectors = table.column("q").combine_chunks()
    dense = np.zeros((n, width), np.int32)
    dense[np.arange(width) < np.diff(np.asarray(vectors.offsets))[:, None]] = np.asarray(vectors.flatten())
    fixed = {"block": int(head["pos"].min()), "low": int(head["label"].min()), "high": int(head["label"].max()), "n": n}
    if not dense.size or max(-int(dense.min()), int(dense.max())) < 1 << 15:
        dense = dense.astype(np.int16)  # half the bytes to shuffle
    for chunk in range(width // DIMS):
        part = np.ascontiguousarray(dense[:, chunk * DIMS : (chunk + 1) * DIMS])
        row = fixed | {"chunk": chunk, "head": head.tobytes() if chunk == 0 else b"", "panel": part.tobytes()}
        kinds = {"block": pa.int64(), "chunk": pa.int32(), "low": pa.int32(), "high": pa.int32(), "n": pa.int32(), "head": pa.binary(), "panel": pa.binary()}
        yield pa.RecordBatch.from_arrays([pa.array([row[c]], kinds[c]) for c in kinds], list(kinds))


def blocks(rows: DataFrame, size: int, width: int) -> DataFrame:
    """Panels (_PANEL) of rows (pos, id, label, q, slots), in blocks of ``size`` rows sorted by label; written.

    A block is named by the least pos of its rows.  Rows are dealt by ranges of (label, pos), so a hot label is split.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            held = table if held is None else pa.concat_tables([held, table])
            while held.num_rows >= size:
                yield from _panels(held.slice(0, size), width)
                held = held.slice(size)
        if held is not None and held.num_rows:
            yield from _panels(held, width)

    dealt = rows.select("pos", "id", "label", "slots", "q").repartitionByRange(max(1, rows.count() // (4 * size)), "label", "pos").sortWithinPartitions("label", "pos")
    return checkpoint(dealt.mapInArrow(pack, _PANEL))


def _panel(row: dict) -> np.ndarray:
    return np.frombuffer(row["panel"], np.int16 if len(row["panel"]) == 2 * row["n"] * DIMS else np.int32).reshape(row["n"], DIMS)


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The int64 product of a panel of anchors and one of rows; by floating point where that is exact."""
    a, b = a.astype(np.int64), b.astype(np.int64)
    most = int(np.abs(a).max(initial=0)) * int(np.abs(b).max(initial=0)) * DIMS
    if most < 1 << 53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a @ b.T


def _multiplier(equal: bool):
    def multiply(anchors: pa.Table, rows: pa.Table) -> pa.Table:
        out: dict[str, list] = {c.split()[0]: [] for c in _TILE.split(", ")}
        held = [(r, _panel(r)) for r in rows.to_pylist()]
        for a in anchors.to_pylist():
            left = _panel(a)
            for b, right in held:
                overlap = a["low"] <= b["high"] and b["low"] <= a["high"]
                one = a["low"] == a["high"] == b["low"] == b["high"]
                if not (overlap if equal else not one):
                    continue
                tile = _product(left, right)
                if np.abs(tile).max(initial=0) < 1 << 31:  # half the bytes to shuffle; added as int64
                    tile = tile.astype(np.int32)
                for name, value in (("a_block", a["block"]), ("b_block", b["block"]), ("a_n", a["n"]), ("b_n", b["n"]), ("a_head", a["head"]), ("b_head", b["head"]), ("tile", tile.tobytes())):
                    out[name].append(value)
        kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
        return pa.table({c.split()[0]: pa.array(out[c.split()[0]], kinds[c.split()[1]]) for c in _TILE.split(", ")})

    return multiply


def _first(scores: np.ndarray, where: np.ndarray, k: int) -> np.ndarray:
    """The k places of ``where`` with the largest scores, the first of equal ones."""
    s = scores[where]
    if len(s) > k:
        good = s >= np.partition(s, len(s) - k)[len(s) - k]
        s, where = s[good], where[good]
    return where[np.argsort(-s, kind="stable")[:k]]


def _reducer(equal: bool):
    def reduce(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, a_head, b_head = None, b"", b""
        for batch in batches:
            for r in batch.to_pylist():
                flat = np.frombuffer(r["tile"], np.int64 if len(r["tile"]) == 8 * r["a_n"] * r["b_n"] else np.int32).reshape(r["a_n"], r["b_n"])
                total = flat.astype(np.int64) if total is None else total + flat
                a_head, b_head = a_head or r["a_head"], b_head or r["b_head"]
        anchors, rows = np.frombuffer(a_head, _HEAD), np.frombuffer(b_head, _HEAD)
        out: list[tuple] = []
        for a, scores in zip(anchors, total, strict=True):
            if equal:
                picked = [(0, _first(scores, np.flatnonzero((rows["label"] == a["label"]) & (rows["pos"] != a["pos"])), POSITIVES))]
            else:
                wanted = [(i, int(p)) for i, p in enumerate(a["slots"][: a["n_slots"]])]
                bounds = [(i, -(-LOW * p // 100), HIGH * p // 100) for i, p in wanted if p >= 0]
                if not bounds:
                    continue
                near = np.flatnonzero((scores >= min(b[1] for b in bounds)) & (scores <= max(b[2] for b in bounds)) & (rows["label"] != a["label"]))
                picked = [(i, _first(scores, near[(scores[near] >= low) & (scores[near] <= high)], NEGATIVES)) for i, low, high in bounds]
            out += [(int(a["pos"]), slot, int(rows["id"][j]) if rows["has_id"][j] else None, int(scores[j])) for slot, found in picked for j in found]
        if out:
            columns = zip(*out, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int64(), pa.int64()), strict=True)], ["anchor", "slot", "id", "score"])

    return reduce


def _ranked(found: DataFrame, k: int) -> DataFrame:
    """The first k of each anchor and slot, with their rank; Spark keeps k of a task before the shuffle."""
    order = Window.partitionBy("anchor", "slot").orderBy(F.desc("score"), F.asc_nulls_last("id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _searched(anchors: DataFrame, panels: DataFrame, width: int, equal: bool) -> DataFrame:
    """What the summed tiles give: of rows with equal labels, or of the others within the anchors' slots (_FOUND)."""
    left = blocks(anchors, ANCHORS, width)
    across = max(1, left.where("chunk = 0").count())
    down = max(1, panels.where("chunk = 0").count() // GROUP)
    cell = lambda n, seed: F.pmod(F.xxhash64(F.lit(seed), "block"), F.lit(n)).cast("int")
    left = left.withColumns({"g": cell(across, 1), "s": F.explode(F.sequence(F.lit(0), F.lit(down - 1)))})
    right = panels.withColumns({"s": cell(down, 2), "g": F.explode(F.sequence(F.lit(0), F.lit(across - 1)))})
    tiles = left.groupBy("g", "s", "chunk").cogroup(right.groupBy("g", "s", "chunk")).applyInArrow(_multiplier(equal), _TILE)
    return tiles.groupBy("a_block", "b_block").applyInArrow(_reducer(equal), _FOUND)


def mine(rows: DataFrame, anchor: Column) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score of ``quantised`` rows.

    anchor: which rows are anchors.  Rows are numbered in the written table, so that a row is
    never its own positive whatever its id.
    """
    none = F.array().cast("array<long>")
    width = -(-max(1, rows.agg(F.max(F.size("q"))).first()[0] or 1) // DIMS) * DIMS
    panels = blocks(rows.withColumn("slots", none), ROWS, width)
    chosen = rows.where(anchor & F.col("id").isNotNull())
    positives = _ranked(_searched(chosen.withColumn("slots", none), panels, width, True), POSITIVES)
    positives = checkpoint(positives.select("anchor", (F.col("rank") - 1).alias("slot"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score")))
    slots = positives.groupBy(F.col("anchor").alias("pos")).agg(F.array_sort(F.collect_list(F.struct("slot", "positive_score"))).alias("p")).select("pos", F.col("p.positive_score").alias("slots"))
    negatives = _ranked(_searched(chosen.join(slots, "pos"), panels, width, False), NEGATIVES)
    named = negatives.join(positives, ["anchor", "slot"]).join(chosen.select(F.col("pos").alias("anchor"), F.col("id").alias("anchor_id")), "anchor")
    return named.select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def hard_negatives(embeddings: DataFrame) -> DataFrame:
    """The mined rows of a table (vec_id, embedding, label); anchors are ids divisible by 100, and each seventh label is moved on."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label").cast("long") + 1) % 10).otherwise(F.col("label"))
    return mine(quantised(embeddings, label), F.col("id") % 100 == 0)


ORACLE_SQL = f"""
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor({SCALE} * CAST(x AS DOUBLE))) AS q FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), pairs AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same, CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id
), positives AS (
  SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM pairs WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= {POSITIVES}
)
SELECT anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, other_id AS negative_id, positive_score, score AS negative_score
FROM positives JOIN pairs USING (anchor_id)
WHERE NOT same AND {LOW} * positive_score <= 100 * score AND 100 * score <= {HIGH} * positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other_id) QUALIFY row_number() OVER w <= {NEGATIVES}
"""
