"""Best-fit packing under conflicts: documents to bins of a fixed number of words.

Documents are dealt to shards of about ``SHARD`` rows by a hash; only doc_id,
source, cluster and size are shuffled.  In a shard rows go by falling size to
the bin with the least residual that holds them and has no conflict with them:
a bin carries one bitmap of the sources and one of the duplicate clusters that
it has, and the successor search over the residuals goes on until a compatible
bin is found, else a new bin opens.  Texts above the capacity are cut: full
pieces have a bin of their own, and the rest is packed like any other row.
Pieces partition the words of their document; no word is lost.

A cluster is the group of rows with one text, unless a column is named.

Defined results: a null text has no words, and a row without words takes a
place of size 0; null sources conflict with each other like any source; rows
of one doc_id are packed each on its own; an empty table gives no rows.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from namelens.llm.common import NOT_SPACE, checkpoint, text_of

CAPACITY = 2048
SHARD = 2048
PACKED = "bin_id long, place int, doc_id long, piece int, first_word long, n_words long, source string, bin_words long"


class _Bins:
    """Open bins of a shard, ordered by (residual, bin)."""

    def __init__(self, capacity: int) -> None:
        self.capacity, self.order = capacity, []
        self.sources: list[int] = []
        self.clusters: list[int] = []
        self.n = 0

    def open(self, residual: int, source: int, cluster: int) -> int:
        self.sources.append(source)
        self.clusters.append(cluster)
        self.n += 1
        insort(self.order, (residual, self.n - 1))
        return self.n - 1

    def place(self, size: int, source: int, cluster: int) -> int:
        at = bisect_left(self.order, (size, -1))
        while at < len(self.order):
            residual, found = self.order[at]
            if not (self.sources[found] & source or self.clusters[found] & cluster):
                del self.order[at]
                insort(self.order, (residual - size, found))
                self.sources[found] |= source
                self.clusters[found] |= cluster
                return found
            at += 1
        return self.open(self.capacity - size, source, cluster)


def _bits(values: list, keep: bool) -> list[int]:
    """A bit for each value that occurs more than once; a single one can't conflict."""
    if not keep:
        return [0] * len(values)
    count: dict = {}
    for v in values:
        count[v] = count.get(v, 0) + 1
    bit = {v: 1 << i for i, v in enumerate(v for v, n in count.items() if n > 1)}
    return [bit.get(v, 0) for v in values]


def pack_shard(rows: list[tuple], capacity: int, separate_sources: bool = True) -> list[tuple[int, int, int, int]]:
    """rows: (doc_id, source, cluster, size).  Gives (row, piece, size, bin) for every piece."""
    sources, clusters = _bits([r[1] for r in rows], separate_sources), _bits([r[2] for r in rows], True)
    pieces = []
    for i, r in enumerate(rows):
        full, rest = divmod(r[3], capacity)
        pieces += [(i, p, capacity) for p in range(full)]
        if rest or not full:
            pieces.append((i, full, rest))
    pieces.sort(key=lambda p: (-p[2], rows[p[0]][0] is None, rows[p[0]][0] or 0, p[1], p[0]))
    bins, out = _Bins(capacity), []
    for i, p, size in pieces:
        out.append((i, p, size, bins.place(size, sources[i], clusters[i]) if size < capacity else bins.open(0, sources[i], clusters[i])))
    return out


def _packer(capacity: int, separate_sources: bool):
    def pack(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by([(c, "ascending") for c in ("doc_id", "size", "source", "cluster")])
        rows = list(zip(*(table.column(c).to_pylist() for c in ("doc_id", "source", "cluster", "size")), strict=True))
        placed = sorted(pack_shard(rows, capacity, separate_sources), key=lambda x: x[3])
        words: dict[int, int] = {}
        for _, _, size, b in placed:
            words[b] = words.get(b, 0) + size
        out, before, place = {c.split()[0]: [] for c in PACKED.split(", ")}, -1, 0
        for i, p, size, b in placed:
            place, before = (place + 1 if b == before else 0), b
            for c, v in zip(out, ((key[0].as_py() << 32) | b, place, rows[i][0], p, p * capacity, size, rows[i][1], words[b]), strict=True):
                out[c].append(v)
        kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string()}
        return pa.table({c.split()[0]: pa.array(out[c.split()[0]], kinds[c.split()[1]]) for c in PACKED.split(", ")})

    return pack


def packed(docs: DataFrame, capacity: int = CAPACITY, cluster: Column | None = None, separate_sources: bool = True) -> DataFrame:
    """A row for each piece of a document: bin_id, place in the bin, doc_id, piece, first_word, n_words, source, bin_words."""
    rows = checkpoint(
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"),
            (F.xxhash64(text_of()) if cluster is None else cluster).alias("cluster"),
            F.regexp_count(text_of(), F.lit(NOT_SPACE)).cast("long").alias("size"), F.monotonically_increasing_id().alias("number"),
        )
    )
    n = max(1, -(-rows.count() // SHARD))
    # rows is written, so that a row's number stays the same in a retry; it keeps repeated rows apart
    dealt = rows.withColumn("shard", F.pmod(F.xxhash64("doc_id", "cluster", "number"), F.lit(n)).cast("long"))
    return dealt.groupBy("shard").applyInArrow(_packer(capacity, separate_sources), PACKED)
