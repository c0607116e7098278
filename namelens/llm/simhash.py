"""SimHash near-dedup: vantage-point trees over 64-bit fingerprints.

Fingerprints of whole texts are built in Arrow batches.  Distinct fingerprints
are then searched for pairs that differ in at most ``RADIUS`` bits, through two
levels of vantage-point trees:

* Trees of shards, in Spark.  What prunes here is a rule on blocks of bits: the bits
  are cut into five blocks; three changed bits leave two blocks as they are, so each of
  the ten pairs of blocks has a tree of its own, over the Hamming distance on those two
  blocks alone.  In one of the ten trees a linked pair has distance zero, so by the
  triangle bound it has the same distance from every vantage point: all rings but one are
  pruned, and a fingerprint goes to one shard a tree; no shard overlaps another.
* Inside a shard a tree over the full distance: the median distance from a
  vantage point parts the fingerprints, and pairs across the boundary are sought
  only among those within ``RADIUS`` of it.

The number of ring levels follows the number of fingerprints, so shards stay
near ``SHARD`` fingerprints.  A larger shard (fingerprints that crowd together)
is cut into chunks, and each pair of chunks is a task of its own.  A task gives
a spanning forest of the links that it finds, not all pairs.

Defined results: a null text counts as empty; a text without words has
fingerprint zero and links like any other; a component without any doc_id has
a null component_id; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from namelens.llm.common import checkpoint, few, text_of
from namelens.llm.components import connected_components
from namelens.llm.exactdedup import drop_rows

RADIUS = 3
SHINGLE = 3
#: Words and likeness of the stage that drops near copies.
NEAR_SHINGLE, NEAR_SIMILARITY = 5, 0.8
#: Bands of that stage, and the least hashes a band: of pairs with likeness 0.8 all but (1 - 0.8 ** 5) ** 20 = 0.04 % share a band.
BANDS, BAND_HASHES = 20, 5
#: One-bit MinHashes of a sketch, and how many may differ in a pair that is verified: 3.9 standard deviations above 205, the mean at likeness 0.8.
SKETCH, DIFFER = 2048, 258
#: Fingerprints that a shard should have, and those above which it is cut into chunks.
SHARD, CHUNK = 512, 32_768
#: Fingerprints that are compared pair by pair at the bottom of a tree in a shard.
LEAF = 192
#: Rows of a block of comparisons, of four times as many columns; all of a block may be links.
BLOCK = 192


def _hashes(words: list[bytes], k: int) -> np.ndarray:
    """XXH64 (seed 42) of the shingles of k words, repeats included; of the whole sequence if it is shorter."""
    shingles = [b" ".join(words)] if len(words) <= k else map(b" ".join, zip(*(words[i:] for i in range(k)), strict=False))
    digest = xxhash.xxh64_intdigest
    return np.array([digest(s, 42) for s in shingles], np.uint64)


def fingerprint(text: bytes, k: int = SHINGLE) -> int:
    """The 64-bit SimHash: a bit is set if over half of the shingles' hashes have it."""
    words = text.lower().split()  # of bytes: A-Z only, and the white space of the contract
    if not words:
        return 0
    hashes = _hashes(words, k)
    ones = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0])


_ODD = np.random.default_rng(128).integers(1, 1 << 63, BANDS * BAND_HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SKETCH_ODD = np.random.default_rng(2048).integers(1, 1 << 63, SKETCH, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def least_hashes(hashes: np.ndarray, odd: np.ndarray) -> np.ndarray:
    """The least of the hashes, which are random themselves, under each multiplier."""
    least = np.full(len(odd), np.iinfo(np.uint64).max, np.uint64)
    step = max(1, 200_000 // len(odd))
    for at in range(0, len(hashes), step):
        np.minimum(least, (hashes[at : at + step, None] * odd).min(axis=0), out=least)
    return least


def shingle_set(text: bytes) -> np.ndarray:
    """The distinct hashes of the five-word shingles, sorted."""
    return np.unique(_hashes(text.lower().split(), NEAR_SHINGLE))


def bands(hashes: np.ndarray) -> np.ndarray:
    """A key for each of BANDS bands, of BAND_HASHES least hashes under multipliers of their own."""
    return np.array([xxhash.xxh64_intdigest(row.tobytes(), band) for band, row in enumerate(least_hashes(hashes, _ODD).reshape(BANDS, -1))], np.uint64)


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column("text").cast(pa.large_binary())
        found = np.fromiter((fingerprint(t.as_py()) for t in texts), np.uint64, len(texts))
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(found.view(np.int64))], names=[*batch.schema.names[:-1], "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fp of every row of docs."""
    kind = dict(docs.dtypes)["doc_id"]
    return checkpoint(docs.select("doc_id", text_of().alias("text")).mapInArrow(_fingerprints, f"doc_id {kind}, fp long"))


def _marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found, sizes, keys = np.zeros(batch.num_rows, np.uint64), np.zeros(batch.num_rows, np.int64), []
        for i, t in enumerate(batch.column("text")):
            text = t.as_py().encode()
            found[i] = fingerprint(text)
            hashes = shingle_set(text)
            sizes[i] = len(hashes)
            keys.append(bands(hashes).view(np.int64))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("key"), pa.array(found.view(np.int64)), pa.array(sizes), pa.array(keys, pa.list_(pa.int64()))], names=["doc_id", "key", "fp", "size", "bands"])


def _shingle_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = [shingle_set(t.as_py().encode()).view(np.int64) for t in batch.column("text")]
        yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(sets, pa.list_(pa.int64()))], names=["id", "shingles"])


def _vantage_points(n: int) -> list[int]:
    return [int(v) for v in np.random.default_rng(64).integers(0, 1 << 63, n, dtype=np.int64)]


def _blocks() -> tuple[list[int], int]:
    """(masks of the bits of every tree's two blocks, bits of each): RADIUS changed bits leave one tree's bits as they are."""
    n = RADIUS + 2
    edges = [64 * i // n for i in range(n + 1)]
    blocks = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(edges[:-1], edges[1:], strict=True)]
    masks = [sum(c) for c in combinations(blocks, 2)]
    return [m - ((m >> 63) << 64) for m in masks], 2 * (64 // n)


def shards(fps: DataFrame, n: int) -> DataFrame:
    """tree, ring (the distances from the tree's vantage points), part, fp: a row a tree for each of the n
    distinct fingerprints, more for chunks of a large shard."""
    masks, bits = _blocks()
    levels = min(8, max(1, math.ceil(math.log(max(2, n / SHARD), 9))), bits // 2)
    points = _vantage_points(levels)
    keys = []
    for tree, mask in enumerate(masks):
        ring = F.lit(0).cast("long")
        for v in points:
            ring = ring * 32 + F.bit_count(F.col("fp").bitwiseXOR(F.lit(v)).bitwiseAND(F.lit(mask)))
        keys.append(F.struct(F.lit(tree).alias("tree"), ring.alias("ring")))
    rows = fps.select("fp", F.explode(F.array(*keys)).alias("k")).select("k.tree", "k.ring", "fp")
    if n <= CHUNK:
        return rows.select("tree", "ring", F.lit(0).alias("part"), "fp")
    large = checkpoint(rows.groupBy("tree", "ring").count().where(F.col("count") > CHUNK).select("tree", "ring", F.ceil(F.col("count") / CHUNK).cast("int").alias("chunks")))
    if large.isEmpty():
        return rows.select("tree", "ring", F.lit(0).alias("part"), "fp")
    # chunk pairs (i, j) with i <= j; a row of chunk c is in those that name c
    cut = rows.join(large, ["tree", "ring"], "left").withColumn("chunks", F.coalesce("chunks", F.lit(1)))
    cut = cut.withColumn("c", F.pmod(F.xxhash64("fp"), F.col("chunks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    return cut.select("tree", "ring", (F.least("c", "other") * F.col("chunks") + F.greatest("c", "other")).alias("part"), "fp")


class _Forest:
    """Components of the items of one shard; keeps one link for each merge."""

    def __init__(self, n: int, radius: int = RADIUS) -> None:
        self.root, self.links, self.radius = np.arange(n), [], radius

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        x, y = self.root[a], self.root[b]
        new = x != y
        if not new.any():
            return
        up: dict[int, int] = {}

        def top(v: int) -> int:
            while v in up:
                v = up[v]
            return v

        for p, q in np.unique(np.stack([x[new], y[new]], 1), axis=0).tolist():
            p, q = top(p), top(q)
            if p != q:
                up[max(p, q)] = min(p, q)
                self.links.append((p, q))
        moved = np.arange(len(self.root))
        for v in up:
            moved[v] = top(v)
        self.root = moved[self.root]


def _compare(fps: np.ndarray, a: np.ndarray, b: np.ndarray, forest: _Forest) -> None:
    for at in range(0, len(a), BLOCK):
        for on in range(0, len(b), 4 * BLOCK):
            roots = forest.root[a[at : at + BLOCK]], forest.root[b[on : on + 4 * BLOCK]]
            if min(map(np.min, roots)) == max(map(np.max, roots)):
                continue  # one component already
            i, j = np.nonzero(np.bitwise_count(fps[a[at : at + BLOCK], None] ^ fps[b[None, on : on + 4 * BLOCK]]) <= forest.radius)
            if len(i):
                forest.add(a[at + i], b[on + j])


def _across(fps: np.ndarray, a: np.ndarray, b: np.ndarray, forest: _Forest, depth: int = 0) -> None:
    """Links between two sets, pruned by the triangle bound."""
    if not len(a) or not len(b):
        return
    if len(a) * len(b) <= LEAF * LEAF or depth > 24:
        return _compare(fps, a, b, forest)
    v = fps[a[len(a) // 2]]
    da, db = np.bitwise_count(fps[a] ^ v).astype(int), np.bitwise_count(fps[b] ^ v).astype(int)
    m = int(np.median(da))
    for near in (da <= m, da > m):
        if not near.any():
            continue
        lo, hi = da[near].min() - forest.radius, da[near].max() + forest.radius
        close = (db >= lo) & (db <= hi)
        if near.all() and close.all():
            return _compare(fps, a, b, forest)
        _across(fps, a[near], b[close], forest, depth + 1)


def _within(fps: np.ndarray, a: np.ndarray, forest: _Forest, depth: int = 0) -> None:
    """Links inside a set: both sides of the vantage point's median, and what lies along the boundary."""
    if len(a) <= LEAF or depth > 48:
        if len(a) > 1:
            _compare(fps, a, a, forest)
        return
    d = np.bitwise_count(fps[a] ^ fps[a[len(a) // 2]]).astype(int)
    m = int(np.median(d))
    near = d <= m
    if near.all():
        near = d < m
    if not near.any():
        return _compare(fps, a, a, forest)
    edge = d[near].max()
    _within(fps, a[near], forest, depth + 1)
    _within(fps, a[~near], forest, depth + 1)
    _across(fps, a[near & (d > edge - forest.radius)], a[~near & (d <= edge + forest.radius)], forest)


def shard_links(fps: np.ndarray, radius: int = RADIUS) -> np.ndarray:
    """Pairs of places (a, b) of a spanning forest of all links among the fingerprints of a shard."""
    forest = _Forest(len(fps), radius)
    _within(fps, np.arange(len(fps)), forest)
    return np.array(forest.links, int).reshape(-1, 2)


def _linked(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    fps = np.concatenate([p.column("fp").to_numpy() for p in parts]).view(np.uint64)
    if len(fps) > 1 and len(found := shard_links(fps)):
        ids = fps.view(np.int64)
        yield pa.RecordBatch.from_pydict({"a": ids[found[:, 0]], "b": ids[found[:, 1]]})


def _link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (tree, ring, part, fp) come sorted by shard; one shard is held at a time."""
    key, held = None, []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.stack([batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(3)], 1)
        edges = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), len(keys)]
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            if held and tuple(keys[a]) != key:
                yield from _linked(held)
                held = []
            key = tuple(keys[a])
            held.append(batch.slice(a, b - a))
    if held:
        yield from _linked(held)


def links(fps: DataFrame, n: int) -> DataFrame:
    """(a, b): links that connect all of the n distinct fingerprints (fp) that a chain of close pairs connects."""
    keys = ["tree", "ring", "part"]
    return shards(fps, n).repartition(*keys).sortWithinPartitions(*keys).mapInArrow(_link, "a long, b long")


def _least(links_: DataFrame, nodes: DataFrame) -> DataFrame:
    """id, least: for every node (id, least) the smallest least of its component."""
    roots = connected_components(links_).withColumnRenamed("node", "id")
    linked = checkpoint(roots.join(nodes.select("id", "least"), "id"))
    best = linked.groupBy("root").agg(F.min("least").alias("best"))
    moved = linked.join(best, "root").select("id", "best")
    # written, so that a join with it shuffles both sides plainly and Spark can split a hot node's rows
    return checkpoint(nodes.join(moved, "id", "left").select("id", F.coalesce("best", "least").alias("least")))


def components(rows: DataFrame) -> DataFrame:
    """rows (doc_id, fp) with component_id, the smallest doc_id that is reachable."""
    fps = checkpoint(rows.groupBy("fp").agg(F.min("doc_id").alias("least")))
    found = _least(links(fps.select("fp"), fps.count()), fps.withColumnRenamed("fp", "id"))
    return rows.join(found.select(F.col("id").alias("fp"), F.col("least").alias("component_id")), "fp")


def clusters(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id for every row of docs."""
    found = components(fingerprints(docs))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _comparable(pairs: DataFrame) -> DataFrame:
    """The pairs (a, m, b, n) of nodes with their numbers of shingles, each once and in order, whose sizes allow NEAR_SIMILARITY."""
    pairs = pairs.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.least("m", "n").alias("m"), F.greatest("m", "n").alias("n"))
    return pairs.where(F.col("m") >= NEAR_SIMILARITY * F.col("n")).distinct()


def _alike(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sets of shingles have a likeness of NEAR_SIMILARITY or more."""
    both = pairs.join(sets.select(F.col("id").alias("a"), F.col("shingles").alias("x")), "a").join(sets.select(F.col("id").alias("b"), F.col("shingles").alias("y")), "b")
    common = F.size(F.array_intersect("x", "y"))
    return checkpoint(both.where(common / (F.col("m") + F.col("n") - common) >= NEAR_SIMILARITY).select("a", "b"))


def sketch(hashes: np.ndarray) -> np.ndarray:
    """SKETCH bits, 64 a number: bit 17 of the least hash under each multiplier."""
    return np.packbits((least_hashes(hashes, _SKETCH_ODD) >> np.uint64(17)) & np.uint64(1) == 1).view(np.int64)


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        marks = [sketch(np.asarray(s.values.to_numpy(zero_copy_only=False)).view(np.uint64)) for s in batch.column("shingles")]
        parts = np.stack(marks) if marks else np.zeros((0, SKETCH // 64), np.int64)
        yield pa.RecordBatch.from_arrays([batch.column("id"), *(pa.array(parts[:, i]) for i in range(SKETCH // 64))], names=["id", *(f"s{i}" for i in range(SKETCH // 64))])


def _candidates(nodes: DataFrame, n: int) -> tuple[DataFrame, DataFrame]:
    """(members, first) of the n nodes (id, fp, size, bands).

    members: band, id, size, weight of every band that several nodes share.  first: the pairs to look at first, which
    are the links of the trees, and in each band its nodes with the one that has the most neighbours in all bands (of
    near copies of one text this tends to be the text itself).
    """
    posted = nodes.select("id", "size", F.explode("bands").alias("band"))
    shared = posted.groupBy("band").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("id")).alias("x"), F.bit_xor(F.xxhash64("id", F.lit(1))).alias("y"), F.min("id").alias("least")).where("n > 1")
    # bands with the same nodes count once
    groups = checkpoint(few(shared.groupBy("n", "x", "y", "least").agg(F.min("band").alias("band")).select("band", "n"), n * BANDS))
    members = checkpoint(few(posted.join(groups, "band"), n * BANDS))
    weights = checkpoint(few(members.groupBy("id").agg(F.sum("n").alias("weight")), n))
    members = checkpoint(few(members.drop("n").join(weights, "id"), n * BANDS))
    centres = checkpoint(few(members.groupBy("band").agg(F.max(F.struct("weight", "id", "size")).alias("c")), n * BANDS))
    star = members.join(centres, "band").select(F.col("c.id").alias("a"), F.col("c.size").alias("m"), F.col("id").alias("b"), F.col("size").alias("n"))
    # one node stands for all of a fingerprint; the others are linked to it
    stands = checkpoint(few(nodes.groupBy("fp").agg(F.min(F.struct("id", "size")).alias("s"), F.count("*").alias("many")).select("fp", "s.id", "s.size", "many"), n))
    end = lambda fp, i, n: stands.select(F.col("fp").alias(fp), F.col("id").alias(i), F.col("size").alias(n))
    close = links(stands.select("fp"), stands.count()).withColumnsRenamed({"a": "x", "b": "y"}).join(end("x", "a", "m"), "x").join(end("y", "b", "n"), "y").select("a", "m", "b", "n")
    same = stands.where("many > 1").select("fp", F.col("id").alias("a"), F.col("size").alias("m"))
    same = nodes.select("fp", F.col("id").alias("b"), F.col("size").alias("n")).join(same, "fp").select("a", "m", "b", "n")
    return members, checkpoint(few(_comparable(star.unionByName(close).unionByName(same)), n * BANDS))


def _near_roots(nodes: DataFrame, n: int, texts: DataFrame) -> DataFrame:
    """id, root of each of the n nodes (id, key, fp, size, bands): nodes that chains of near copies connect have one root; texts has key, text.

    Candidates are the links of the trees and all pairs that share a band.  Every link is verified on the whole
    sets of shingles, which only nodes with a candidate get.  What the first pairs (see _candidates) leave in several
    components of one band is compared by sketches in the join, and verified where these are alike; a pair of likeness
    0.8 fails there with a probability of 0.005 %.
    """
    members, first = _candidates(nodes, n)
    named = members.select("id").unionByName(first.select(F.col("a").alias("id"))).unionByName(first.select(F.col("b").alias("id"))).distinct()
    named = checkpoint(few(named.join(nodes.select("id", "key"), "id"), n))
    # copies go before the shuffle, which also serves the join: a node has a key of its own
    whole = texts.groupBy("key").agg(F.first("text").alias("text")).join(named, "key").select("id", "text")
    sets = checkpoint(whole.mapInArrow(_shingle_sets, "id long, shingles array<long>"))
    roots = connected_components(_alike(first, sets)).withColumnRenamed("node", "id")
    roots = checkpoint(few(nodes.select("id").join(roots, "id", "left").select("id", F.coalesce("root", "id").alias("root")), n))

    rooted = checkpoint(few(members.select("band", "id", "size").join(roots, "id"), n * BANDS))
    several = rooted.groupBy("band").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi").select("band")
    apart = checkpoint(few(rooted.join(several, "band", "left_semi"), n * BANDS))
    parts = [f"s{i}" for i in range(SKETCH // 64)]
    marks = sets.join(apart.select("id").distinct(), "id", "left_semi").mapInArrow(_sketches, "id long, " + ", ".join(f"{p} long" for p in parts))
    held = apart.groupBy("id").agg(F.collect_list("band").alias("bands"))  # BANDS at most
    apart = checkpoint(apart.join(checkpoint(marks.join(held, "id")), "id"))
    left, right = (apart.select("band", *[F.col(c).alias(f"{c}_{side}") for c in ("id", "size", "root", "bands", *parts)]) for side in "ab")
    differ = sum((F.bit_count(F.col(f"{p}_a").bitwiseXOR(F.col(f"{p}_b"))) for p in parts[1:]), F.bit_count(F.col("s0_a").bitwiseXOR(F.col("s0_b"))))
    fits = (F.least("size_a", "size_b") >= NEAR_SIMILARITY * F.greatest("size_a", "size_b")) & (differ <= DIFFER)
    # a pair counts in one of the bands that it shares
    once = left["band"] == F.array_min(F.array_intersect("bands_a", "bands_b"))
    rest = left.join(right, (left["band"] == right["band"]) & (F.col("id_a") < F.col("id_b")) & (F.col("root_a") != F.col("root_b")) & fits & once)
    rest = rest.select(F.col("id_a").alias("a"), F.least("size_a", "size_b").alias("m"), F.col("id_b").alias("b"), F.greatest("size_a", "size_b").alias("n"))
    more = _alike(rest, sets)
    if more.isEmpty():
        return roots
    end = lambda i, r: roots.select(F.col("id").alias(i), F.col("root").alias(r))
    above = connected_components(more.join(end("a", "x"), "a").join(end("b", "y"), "b").select(F.col("x").alias("a"), F.col("y").alias("b")))
    above = checkpoint(few(above.select(F.col("node").alias("root"), F.col("root").alias("top")), n))
    return checkpoint(few(roots.join(above, "root", "left").select("id", F.coalesce("top", "root").alias("root")), n))


def near_deduplicated(docs: DataFrame) -> DataFrame:
    """The rows of docs without near copies: of each group the row with the smallest doc_id stays.

    Texts are near copies if the likeness (Jaccard) of their sets of five-word shingles is
    NEAR_SIMILARITY or more; candidates are found by fingerprints that differ in RADIUS bits at
    most and by bands, and verified (see _near_roots); groups are the components of these links.  Rows with one
    SHA-256 of their text are one node, which has a number of its own.  Of rows that share the
    smallest doc_id the one with the smallest SHA-256 stays; if a group has no doc_id at all, that
    holds for all its rows; of rows equal in doc_id and text one stays.
    """
    key = F.sha2(text_of(), 256)
    kind = dict(docs.dtypes)["doc_id"]
    rows = checkpoint(docs.select("doc_id", key.alias("key"), text_of().alias("text")).mapInArrow(_marks, f"doc_id {kind}, key string, fp long, size long, bands array<long>"))
    order = F.struct(F.col("doc_id").isNull().alias("null"), "doc_id", "key")
    nodes = rows.groupBy("key").agg(F.min(order).alias("least"), F.first("fp").alias("fp"), F.first("size").alias("size"), F.first("bands").alias("bands"))
    nodes = checkpoint(nodes.withColumn("id", F.monotonically_increasing_id()))
    n = nodes.count()
    nodes = few(nodes, n * BANDS)
    rooted = _near_roots(nodes, n, docs.select(key.alias("key"), text_of().alias("text"))).join(nodes.select("id", "key", "least"), "id")
    rooted = checkpoint(few(rooted, n))
    best = checkpoint(few(rooted.groupBy("root").agg(F.min("least").alias("least")), n))
    kept = checkpoint(few(rooted.select("root", "key").join(best, "root").select("key", "least"), n))
    judged = rows.select("doc_id", "key").join(kept, "key")
    stays = F.col("doc_id").eqNullSafe(F.col("least.doc_id")) & (F.col("key") == F.col("least.key"))
    gone = judged.where(~stays).select("doc_id", "key", F.lit(False).alias("repeated"))
    # a row that stays is listed only where others are its equals
    equals = judged.where(stays).groupBy("doc_id", "key").count().where("count > 1").select("doc_id", "key", F.lit(True).alias("repeated"))
    return drop_rows(docs, checkpoint(gone.unionByName(equals)), key)
