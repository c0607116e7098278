"""Helpers that several corpus operators share: tables, checkpoints, Arrow text."""

from __future__ import annotations

import math
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space of the contracts: space and U+0009 to U+000D.
SPACE = "[\\x20\\x09-\\x0D]"
NOT_SPACE = "[^\\x20\\x09-\\x0D]+"
#: Text bytes that one NumPy step works on; bounds a task's memory.
STEP_BYTES = 500_000
#: Rows of a few numbers that one task takes.
TASK_ROWS = 50_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(name: str = "text") -> Column:
    """The text column; null counts as empty."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage in the folder of spark.checkpoint.dir, which all executors share.

    Only a local session without that setting, as in tests, gets a folder of its own;
    on a cluster, where executors couldn't share it, that is an error.
    """
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        shared = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not shared and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(shared or tempfile.mkdtemp(prefix="checkpoints"))
    return df.checkpoint()


def few(df: DataFrame, rows: int) -> DataFrame:
    """df, which has about so many rows of a few numbers, in tasks of TASK_ROWS.

    Where Spark doesn't merge small partitions itself, a small table would have as many tasks and files as a large one.
    """
    return df.coalesce(max(1, math.ceil(rows / TASK_ROWS)))


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column without nulls: text i is bytes[offsets[i]:offsets[i + 1]]."""
    column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    held = column.buffers()[2]
    data = np.frombuffer(held, np.uint8) if held is not None and held.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def cuts(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """(start, length) of slices with about STEP_BYTES of text, one row at least."""
    _, offsets = text_buffer(texts)
    start = 0
    while start < len(texts):
        end = int(np.searchsorted(offsets, offsets[start] + STEP_BYTES, side="right")) - 1
        end = min(max(end, start + 1), len(texts))
        yield start, end - start
        start = end


def steps(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """A batch by the cuts of its column text."""
    for start, length in cuts(batch.column("text")):
        yield batch.slice(start, length)


_P = np.uint64(0x9E3779B97F4A7C15)
_P_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_BYTES = np.random.default_rng(20240501).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: After lower-casing: digits, a-z and every byte of a non-ASCII character.
WORD = np.zeros(256, bool)
WORD[48:58] = WORD[97:123] = WORD[128:] = True
#: Anything but the white space of the contracts.
SOLID = np.ones(256, bool)
SOLID[[32, *range(9, 14)]] = False


def mix64(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def word_spans(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, text number) of every maximal run of bytes in the class, never across texts."""
    solid = inside[data]
    filled = offsets[1:] > offsets[:-1]
    before = np.zeros(len(data), bool)
    before[1:] = solid[:-1]
    before[offsets[:-1][filled]] = False
    after = np.zeros(len(data), bool)
    after[:-1] = solid[1:]
    after[offsets[1:][filled] - 1] = False
    start = np.flatnonzero(solid & ~before)
    end = np.flatnonzero(solid & ~after) + 1
    return start, end, np.searchsorted(offsets, start, side="right") - 1


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans: a polynomial from prefix sums, then mixed."""
    if not len(start):
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        power = np.full(len(data), _P)
        power[:1] = 1
        np.cumprod(power, out=power)
        total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_BYTES[data] * power, out=total[1:])
        undo = np.full(len(data), _P_INVERSE)
        undo[:1] = 1
        np.cumprod(undo, out=undo)
        return mix64((total[end] - total[start]) * undo[start] + (end - start).astype(np.uint64))
