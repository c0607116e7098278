"""Python data sources over recorded certificate logs: ``recorded_logs`` (entries) and ``recorded_names``.

A recorded log is a folder of JSON-lines files named after their first index, ``00000000.jsonl``,
with leaf_input on each line, and may have a tree head, ``head.json`` (tree_size,
timestamp); without one its head is where its files end.  Option ``path`` is the folder of the
logs, in any file system that Arrow opens.  A file is a partition of its own, so that a
large log is read by many tasks.

Batch: option ``start``.  A start beyond the head of every log is an error.  With ``recorded`` conditions on log_url,
idx and name are pushed into the source: logs and files outside them aren't opened,
and leaves whose names don't meet them don't leave the reader.

Stream: an offset has for each log its next index, head, entries skipped, entries admitted, and why
it stops there: caught-up, limit, budget or error (with the error).  These stand in the sources' offsets of the
query's progress; see ``scan_report``.  Options:

* start: the first index; without it a log begins shortly before its head, see certificates.start_at
* max_lag: a log further behind jumps ahead, and what it skips is counted
* per_trigger: entries of a log per trigger (limit)
* entries: entries of all logs per trigger, shared among them; what a log doesn't need goes to the others (budget)
* seconds, rate: wall-clock seconds per trigger, turned into entries by the rate of the triggers before
  (first ``rate`` entries a second), and shared likewise (budget)

A log that can't be listed, or whose head lies beyond its files, stays where it is with an error, and the others go on.
"""

from __future__ import annotations

import json
import time
from collections.abc import Iterable, Iterator

import pandas as pd
import pyarrow.fs as fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual, StringContains,
    StringEndsWith, StringStartsWith,
)
from pyspark.sql.types import StructType

from namelens.sources.certificates import dns_names, parse_leaf, start_at

SCHEMA = "log_url string, idx long, leaf_input string"
NAMES = "log_url string, idx long, timestamp_ms long, name string"
PUSHDOWN = "spark.sql.python.filterPushdown.enabled"
PER_TRIGGER, RATE = 400_000, 10_000.0
#: Of the triggers before, the newest one's share in the rate.
NEWEST = 0.5


def recorded(spark: SparkSession, path: str, kind: str = "recorded_names", **options: object) -> DataFrame:
    """A batch of a recording whose conditions are pushed into the source.

    Spark asks for a setting of the session before it pushes into Python sources; this turns it on.
    """
    spark.conf.set(PUSHDOWN, "true")
    for source in (RecordedLogs, RecordedNames):
        spark.dataSource.register(source)
    return spark.read.format(kind).option("path", path).option("pushdown", "true").options(**{k: str(v) for k, v in options.items()}).load()


class LogRange(InputPartition):
    def __init__(self, log: str, file: int, start: int, end: int) -> None:
        self.log, self.file, self.start, self.end = log, file, start, end


class Recording:
    """The folder of recorded logs."""

    def __init__(self, path: str) -> None:
        self.path = path

    def _at(self, *parts: str) -> tuple[fs.FileSystem, str]:
        system, top = fs.FileSystem.from_uri(self.path) if "://" in self.path or self.path.startswith("file:") else (fs.LocalFileSystem(), self.path)
        return system, "/".join((top.rstrip("/"), *parts))

    def logs(self) -> list[str]:
        system, top = self._at()
        return sorted(f.base_name for f in system.get_file_info(fs.FileSelector(top)) if f.type == fs.FileType.Directory)

    def firsts(self, log: str) -> list[int]:
        """First indexes of a log's files."""
        system, top = self._at(log)
        return sorted(int(f.base_name.split(".")[0]) for f in system.get_file_info(fs.FileSelector(top)) if f.base_name.endswith(".jsonl"))

    def lines(self, log: str, first: int) -> Iterator[tuple[int, str]]:
        """(index, line) of a file."""
        system, name = self._at(log, f"{first:08d}.jsonl")
        with system.open_input_stream(name) as raw:
            i, rest = first, b""
            while block := raw.read(1 << 20):
                *whole, rest = (rest + block).split(b"\n")
                for line in whole:
                    if line.strip():
                        yield i, line.decode()
                        i += 1
            if rest.strip():
                yield i, rest.decode()

    def recorded(self, log: str) -> int:
        """Entries that the files hold."""
        firsts = self.firsts(log)
        return firsts[-1] + sum(1 for _ in self.lines(log, firsts[-1])) if firsts else 0

    def head(self, log: str) -> tuple[int, int | None]:
        """(entries, time in ms) of a log's head; of the files, without a time, if none is recorded."""
        system, name = self._at(log, "head.json")
        if system.get_file_info(name).type != fs.FileType.File:
            return self.recorded(log), None
        with system.open_input_stream(name) as raw:
            head = json.loads(raw.read())
        return int(head["tree_size"]), head.get("timestamp")

    def parts(self, log: str, start: int, end: int) -> list[LogRange]:
        """A part for each file with entries of the range."""
        firsts = self.firsts(log)
        edges = zip(firsts, [*firsts[1:], max(end, *firsts)] if firsts else [], strict=True)
        return [LogRange(log, first, start, end) for first, after in edges if first < end and after > start]

    def entries(self, part: LogRange) -> Iterator[tuple[str, int, str | None]]:
        for i, line in self.lines(part.log, part.file):
            if i >= part.end:
                break
            if i >= part.start:
                yield part.log, i, json.loads(line).get("leaf_input")


def names_of(leaf: str | None) -> tuple[int, list[str]] | None:
    """(time, names in normal form) of a leaf; null if it can't be read."""
    found = parse_leaf(leaf) if leaf else None
    return (found[0], [n.lower().removeprefix("*.").removesuffix(".") for n in dns_names(found[2])]) if found else None


class _Reader(DataSourceReader):
    def __init__(self, options: dict, names: bool = False) -> None:
        self.held, self.first, self.names = Recording(options["path"]), int(options.get("start", 0)), names
        self.logs: set[str] | None = None
        self.low, self.high, self.ids = 0, None, None
        self.conditions: list[Filter] = []

    def partitions(self) -> list[LogRange]:
        heads = {log: self.held.head(log)[0] for log in self.held.logs() if self.logs is None or log in self.logs}
        if heads and self.first and all(self.first >= head for head in heads.values()):
            raise ValueError(f"no log has entries from {self.first} on")
        low = max(self.low, self.first, min(self.ids, default=0) if self.ids is not None else 0)
        ends = [x for x in (self.high, max(self.ids, default=-1) + 1 if self.ids is not None else None) if x is not None]
        parts = [p for log, head in heads.items() for p in self.held.parts(log, low, min([head, *ends]))]
        return parts or [LogRange("", 0, 0, 0)]

    def _good(self, name: str) -> bool:
        test = {EqualTo: lambda v: name == v, In: lambda v: name in v, StringStartsWith: name.startswith, StringEndsWith: name.endswith, StringContains: lambda v: v in name}
        return all(test[type(f)](f.value) for f in self.conditions)

    def read(self, partition: LogRange) -> Iterator[tuple]:
        if partition.start >= partition.end:
            return
        for log, i, leaf in self.held.entries(partition):
            if self.ids is not None and i not in self.ids:
                continue
            if not self.names:
                yield log, i, leaf
            elif found := names_of(leaf):
                for name in found[1]:
                    if name and self._good(name):
                        yield log, i, found[0], name


class _PushedReader(_Reader):
    """A reader that sees to conditions; Spark takes it only with its setting for that."""

    def _take(self, f: Filter) -> bool:
        """Whether the source sees to a condition from now on."""
        column, value = getattr(f, "attribute", None), getattr(f, "value", None)
        if column == ("log_url",) and isinstance(f, EqualTo | In):
            values = set(value) if isinstance(f, In) else {value}
            self.logs = values if self.logs is None else self.logs & values
        elif column == ("idx",) and isinstance(f, EqualTo | In):
            values = set(value) if isinstance(f, In) else {value}
            self.ids = values if self.ids is None else self.ids & values
        elif column == ("idx",) and isinstance(f, GreaterThan | GreaterThanOrEqual):
            self.low = max(self.low, value + isinstance(f, GreaterThan))
        elif column == ("idx",) and isinstance(f, LessThan | LessThanOrEqual):
            end = value + isinstance(f, LessThanOrEqual)
            self.high = end if self.high is None else min(self.high, end)
        elif column == ("name",) and isinstance(f, EqualTo | In | StringStartsWith | StringEndsWith | StringContains):
            self.conditions.append(f)
        else:
            return isinstance(f, IsNotNull) and column in (("log_url",), ("idx",), ("name",))  # they never are
        return True

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:  # noqa: N802
        return [f for f in filters if not self._take(f)]


def shares(wanted: dict[str, int], budget: int, first: list[str]) -> dict[str, int]:
    """The budget dealt to logs: each gets what it wants up to an equal share, and what is left goes to the others; single entries to those that come first."""
    given, open_ = dict.fromkeys(wanted, 0), {log: n for log, n in wanted.items() if n > 0}
    while open_ and budget >= len(open_):
        share = budget // len(open_)
        for log in list(open_):
            n = min(share, open_[log])
            given[log] += n
            budget -= n
            open_[log] -= n
            if not open_[log]:
                del open_[log]
    for log in [x for x in first if x in open_][:budget]:
        given[log] += 1
    return given


class _StreamReader(DataSourceStreamReader):
    """Admits a range of each log per trigger; see the module for the offsets."""

    clock = staticmethod(time.monotonic)

    def __init__(self, options: dict, names: bool = False) -> None:
        self.held, self.names, self.start_index = Recording(options["path"]), names, int(options["start"]) if "start" in options else None
        self.per_trigger, self.max_lag = int(options.get("per_trigger", PER_TRIGGER)), int(options.get("max_lag", 0))
        self.budget = int(options["entries"]) if "entries" in options else None
        self.seconds, self.rate = float(options["seconds"]) if "seconds" in options else None, float(options.get("rate", RATE))
        self.now: dict[str, dict] = {}
        self.began: tuple[float, int] | None = None
        self.turn = 0

    def _fresh(self, log: str) -> dict:
        try:
            head = self.held.head(log)[0]
        except Exception as e:  # noqa: BLE001
            return self._failed(0, e)
        at = start_at(0, head)[0] if self.start_index is None else self.start_index
        return {"next": at, "head": head, "from": at, "skipped": 0, "entries": 0, "stopped": "caught-up" if at >= head else "limit", "error": None, "turn": 0}

    @staticmethod
    def _failed(at: int, error: object, turn: int = 0) -> dict:
        return {"next": at, "head": None, "from": at, "skipped": 0, "entries": 0, "stopped": "error", "error": str(error)[:200] or type(error).__name__, "turn": turn}

    def initialOffset(self) -> dict:  # noqa: N802
        return {log: self._fresh(log) for log in self.held.logs()}

    def latestOffset(self) -> dict:  # noqa: N802
        self._measure()
        self.turn += 1
        before = {log: self.now.get(log) or self._fresh(log) for log in self.held.logs()}
        plans, failed = {}, {}
        for log, was in before.items():
            try:
                head = self.held.head(log)[0]
                at, skipped = was["next"], 0
                if at > head:  # the log has been cut or replaced
                    at = start_at(at, head)[0]
                if self.max_lag and head - at > self.max_lag:
                    at, skipped = head - self.max_lag, head - self.max_lag - at
                if at < head and (held := self.held.recorded(log)) < head:
                    raise ValueError(f"no entries recorded from {held} on, the head is {head}")
                plans[log] = (at, head, skipped)
            except Exception as e:  # noqa: BLE001  of one log: the others go on, and it is tried again
                failed[log] = self._failed(was["next"], e, was["turn"])
        wanted = {log: min(self.per_trigger, head - at) for log, (at, head, _) in plans.items()}
        caps = [x for x in (self.budget, int(self.rate * self.seconds) if self.seconds is not None else None) if x is not None]
        given = shares(wanted, max(1, min(caps)), sorted(wanted, key=lambda x: (before[x]["turn"], x))) if caps else wanted
        out = {}
        for log, was in before.items():
            if log in failed:
                new = failed[log]
            else:
                at, head, skipped = plans[log]
                end = at + given[log]
                stopped = "caught-up" if end >= head else "limit" if given[log] >= self.per_trigger else "budget"
                new = {"next": end, "head": head, "from": at, "skipped": skipped, "entries": end - at, "stopped": stopped, "error": None, "turn": self.turn if end > at else was["turn"]}
            # a log that stays where it was keeps its offset, so that it alone is no new batch
            same = was["next"] == new["next"] and not new["skipped"] and was["stopped"] == new["stopped"] and was["error"] == new["error"]
            out[log] = was if same else new
        if out != self.now:
            self.began = (self.clock(), sum(o["entries"] for log, o in out.items() if o is not before[log]))
        self.now = out
        return out

    def _measure(self) -> None:
        """The rate of the trigger that is over."""
        if self.began and self.began[1]:
            took = max(1e-3, self.clock() - self.began[0])
            self.rate = (1 - NEWEST) * self.rate + NEWEST * self.began[1] / took
        self.began = None

    def partitions(self, start: dict, end: dict) -> list[LogRange]:
        if not self.now:  # after a restart triggers go on from there
            self.now, self.turn = dict(end), max((o["turn"] for o in end.values()), default=0)
        parts = []
        for log, o in end.items():
            if o["stopped"] != "error" and o != start.get(log) and o["from"] < o["next"]:
                parts += self.held.parts(log, o["from"], o["next"])
        return parts or [LogRange("", 0, 0, 0)]

    def read(self, partition: LogRange) -> Iterator[tuple]:
        return _Reader.read(self._batch(), partition)

    def _batch(self) -> _Reader:
        return _Reader({"path": self.held.path}, self.names)

    def commit(self, end: dict) -> None:
        pass


class RecordedLogs(DataSource):
    named = False

    @classmethod
    def name(cls) -> str:
        return "recorded_logs"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        kind = _PushedReader if self.options.get("pushdown", "false").lower() == "true" else _Reader
        return kind(self.options, self.named)

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:  # noqa: N802
        return _StreamReader(self.options, self.named)


class RecordedNames(RecordedLogs):
    """Names of recorded logs, decoded where they are read: one row a name of an entry, in normal form."""

    named = True

    @classmethod
    def name(cls) -> str:
        return "recorded_names"

    def schema(self) -> str:
        return NAMES


def sightings(names: DataFrame) -> DataFrame:
    """Sightings of rows of ``recorded_names``: each name of a log once, at its first entry; see certificates.sightings."""
    first = names.groupBy("log_url", "name").agg(F.min(F.struct("idx", "timestamp_ms")).alias("f"))
    none = F.lit(None)
    return first.select(F.col("f.idx").alias("ord"), "name", none.cast("string").alias("issuer"), none.cast("timestamp").alias("not_before"), F.timestamp_millis("f.timestamp_ms").alias("logged_at"), F.lit("ct").alias("source"))


REPORT = "batch long, log_url string, from_index long, next_index long, head long, entries long, skipped long, stopped string, error string"


def scan_report(spark: SparkSession, progress: list) -> DataFrame:
    """A row (REPORT) for each log of each trigger of a stream's progress (query.recentProgress)."""
    rows = []
    for p in progress:
        p = json.loads(p.json)  # noqa: PLW2901  the fields of Python hold text of other forms
        for source in p["sources"]:
            end, start = (json.loads(x) if isinstance(x, str) else x or {} for x in (source["endOffset"], source["startOffset"]))
            for log, o in end.items():
                fresh = o != start.get(log)
                rows.append((p["batchId"], log, o["from"] if fresh else o["next"], o["next"], o["head"], o["entries"] if fresh else 0, o["skipped"] if fresh else 0, o["stopped"], o["error"]))
    return spark.createDataFrame(rows, REPORT)


def heads(spark: SparkSession, path: str) -> DataFrame:
    """log_url, tree_size, timestamp_ms of the recorded tree heads."""
    rows = spark.read.schema("tree_size long, timestamp long").json(f"{path}/*/head.json")
    return rows.select(F.element_at(F.split(F.input_file_name(), "/"), -2).alias("log_url"), "tree_size", F.col("timestamp").alias("timestamp_ms"))


def record(entries: DataFrame, path: str, each: int = 10_000) -> DataFrame:
    """Record entries (log_url, idx, leaf_input) as files of ``each`` indexes, one task a file; the files with their entries.

    A file that is written again is replaced, so a task may run twice.  A gap within a file is an error.
    """

    def write(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("idx")
        first = int(key[1]) * each
        if list(part["idx"]) != list(range(first, first + len(part))):
            raise ValueError(f"entries of {key[0]} from {first} on have gaps or repeats")
        system, name = Recording(path)._at(key[0], f"{first:08d}.jsonl")
        system.create_dir(name.rpartition("/")[0], recursive=True)
        with system.open_output_stream(name) as out:
            for leaf in part["leaf_input"]:
                out.write(json.dumps({"leaf_input": leaf}).encode() + b"\n")
        return pd.DataFrame({"log_url": [key[0]], "first": [first], "entries": [len(part)]})

    grouped = entries.groupBy("log_url", F.floor(F.col("idx") / each).alias("file"))
    return grouped.applyInPandas(write, "log_url string, first long, entries long")
