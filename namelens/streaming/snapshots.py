"""An incremental snapshot of a keyed table: a batch rewrites only the buckets that it touches.

Rows are dealt into a fixed number of buckets by the hash of their key.  A batch writes new
files for the buckets of its keys, ``data/batch=n/bucket=b``, and then a manifest,
``manifest/batch=n``, that says for every bucket which batch wrote it last.  The manifest
is what makes a batch count: one that fails before leaves files that nothing reads, and
runs again from the manifest before its own number, so it writes the same state.

Choose as many buckets as the state has times 100 MB or so; a batch of k keys then reads and
writes k buckets at most.  The manifest has a row a bucket, and is all that the driver holds.

Defined results: rows with a null key are a bucket's rows like any other; an empty batch writes a
manifest and no data; the folder can be any that Spark reads.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS = 256


def field_names(schema: str) -> list[str]:
    """The top-level names of a DDL schema."""
    depth, names, start = 0, [], True
    for part in re.split(r"([<>,])", schema):
        if start and depth == 0 and part.strip() and part not in "<>,":
            names.append(part.split()[0])
            start = False
        depth += {"<": 1, ">": -1}.get(part, 0)
        start = start or (part == "," and depth == 0)
    return names


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder that the driver and all executors share, under spark.checkpoint.dir; a local session without it gets its own."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        top = tempfile.mkdtemp(prefix="shared")
    return f"{top.rstrip('/')}/{name}-{uuid.uuid4().hex}"


class Snapshots:
    """Snapshots of a table of a schema (DDL), keyed by a column, in a folder."""

    def __init__(self, spark: SparkSession, folder: str, schema: str, key: str, buckets: int = BUCKETS) -> None:
        self.spark, self.folder, self.schema, self.key, self.buckets = spark, folder.rstrip("/"), schema, key, buckets
        self.columns = field_names(schema)

    def _path(self, *parts: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path("/".join((self.folder, *parts)))
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def batches(self) -> list[int]:
        """Numbers of the batches that count, in order."""
        files, path = self._path("manifest")
        if not files.exists(path):
            return []
        found = [re.fullmatch(r"batch=(\d+)", s.getPath().getName()) for s in files.listStatus(path)]
        done = lambda n: files.exists(self._path("manifest", f"batch={n}", "_SUCCESS")[1])
        return sorted(int(m[1]) for m in found if m and done(int(m[1])))

    def manifest(self, before: int | None = None) -> dict[int, int]:
        """bucket: batch that wrote it last, as of the newest batch or of the newest one before a number."""
        held = [n for n in self.batches() if before is None or n < before]
        if not held:
            return {}
        rows = self.spark.read.schema("bucket int, batch long").parquet(f"{self.folder}/manifest/batch={held[-1]}").collect()
        return {r["bucket"]: r["batch"] for r in rows}

    def bucket(self, column: str | None = None):
        return F.pmod(F.xxhash64(F.col(column or self.key)), F.lit(self.buckets)).cast("int")

    def read(self, before: int | None = None, only: set[int] | None = None) -> DataFrame:
        """The table as of the newest batch, or of the newest before a number; of some buckets only, if they are given."""
        paths = [f"{self.folder}/data/batch={n}/bucket={b}" for b, n in sorted(self.manifest(before).items()) if only is None or b in only]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def apply(self, number: int, keys: DataFrame, merge: Callable[[DataFrame], DataFrame]) -> set[int]:
        """Run batch ``number``; the buckets that it wrote.

        keys: a column of the keys that the batch touches (repeats do no harm).  merge: from the
        old rows of these keys' buckets to all their new rows; rows of other keys have to stay
        as they are, and no row may come with a key of another bucket.
        """
        touched = {r[0] for r in keys.select(self.bucket(keys.columns[0])).distinct().collect()}
        old = self.manifest(before=number)
        if touched:
            rows = merge(self.read(number, touched)).select(*self.columns).withColumn("bucket", self.bucket())
            # one file a bucket
            rows.repartition(len(touched), "bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.folder}/data/batch={number}")
            files, _ = self._path("data")
            written = {b for b in touched if files.exists(self._path("data", f"batch={number}", f"bucket={b}")[1])}
        else:
            written = set()
        new = {b: n for b, n in old.items() if b not in touched} | dict.fromkeys(written, number)  # a bucket that has lost all its rows is no more
        self.spark.createDataFrame(sorted(new.items()), "bucket int, batch long").coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/manifest/batch={number}")
        return touched

    def vacuum(self, keep: int = 2) -> list[int]:
        """Drop data and manifests that the newest ``keep`` batches don't need; the batches whose files are gone.

        Batches before them can't be run again then, which a stream's checkpoint never asks for.
        """
        held = self.batches()
        kept, gone = held[-keep:], held[:-keep] if keep < len(held) else []
        needed = {(b, n) for number in kept for b, n in self.manifest(before=number + 1).items()}
        files, _ = self._path("data")
        dropped = []
        for n in gone:
            _, folder = self._path("data", f"batch={n}")
            if files.exists(folder):
                of = [(s.getPath(), re.fullmatch(r"bucket=(\d+)", s.getPath().getName())) for s in files.listStatus(folder)]
                stale = [p for p, m in of if m and (int(m[1]), n) not in needed]
                for p in stale:
                    files.delete(p, True)
                if len(stale) == sum(1 for _, m in of if m):
                    files.delete(folder, True)
                    dropped.append(n)
            else:
                dropped.append(n)
            files.delete(self._path("manifest", f"batch={n}")[1], True)
        return dropped
