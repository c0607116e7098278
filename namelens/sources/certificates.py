"""Certificate log entries: decoding of leaves, names of certificates, and the list of logs."""

from __future__ import annotations

import base64
import binascii
import re
import struct
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from namelens.functions import domains

#: Names that one certificate gives at most; a longer list is a broken length field.
MAX_NAMES = 5000
#: Entries before the head where a log without a valid cursor starts.
BACKFILL = 2000
LEAF = T.StructType([T.StructField("timestamp_ms", T.LongType()), T.StructField("entry_type", T.IntegerType()), T.StructField("names", T.ArrayType(T.StringType()))])
LOG_LIST = "struct<operators:array<struct<name:string,logs:array<struct<url:string,description:string,state:map<string,string>>>>>>"
_SAN = bytes.fromhex("551d11")
_PLAUSIBLE = re.compile(rb"[a-zA-Z0-9.*_-]{4,253}\Z")


def _element(der: bytes, at: int) -> tuple[int, int, int] | None:
    """(tag, start of the value, its length) of the DER element at a place; null if its length can't be."""
    if at + 1 >= len(der):
        return None
    first = der[at + 1]
    if first < 0x80:
        return der[at], at + 2, first
    count = first & 0x7F
    if not 1 <= count <= 4 or at + 2 + count > len(der):
        return None
    return der[at], at + 2 + count, int.from_bytes(der[at + 2 : at + 2 + count], "big")


def dns_names(der: bytes) -> list[str]:
    """The DNS names of a certificate's alternative names, found by the extension's identifier; broken ones give none."""
    names: list[str] = []
    at = der.find(_SAN)
    while at >= 0 and len(names) < MAX_NAMES:
        found = _element(der, at + len(_SAN))
        if found and found[0] == 0x01:  # the mark of a critical extension
            found = _element(der, found[1] + found[2])
        inner = _element(der, found[1]) if found and found[0] == 0x04 else None
        if inner and inner[0] == 0x30:
            place, end = inner[1], min(inner[1] + inner[2], len(der))
            while place < end and len(names) < MAX_NAMES:
                item = _element(der, place)
                if item is None or item[1] + item[2] > len(der):
                    break
                value = der[item[1] : item[1] + item[2]]
                if item[0] == 0x82 and b"." in value and _PLAUSIBLE.match(value):
                    names.append(value.decode("ascii"))
                place = item[1] + item[2]
        at = der.find(_SAN, at + len(_SAN))
    return names


def parse_leaf(text: str) -> tuple[int, int, bytes] | None:
    """(time in ms, entry type, certificate) of a base64 leaf; null if anything about it is off."""
    try:
        leaf = base64.b64decode(text)
    except (binascii.Error, ValueError):
        return None
    if len(leaf) < 15:
        return None
    at_ms, kind = struct.unpack_from(">QH", leaf, 2)
    at = {0: 12, 1: 44}.get(kind)  # a precertificate has the hash of its issuer's key first
    if at is None or at + 3 > len(leaf):
        return None
    size = int.from_bytes(leaf[at : at + 3], "big")
    return (at_ms, kind, leaf[at + 3 : at + 3 + size]) if 0 < size <= len(leaf) - at - 3 else None


@F.pandas_udf(LEAF)
def decode_leaf(leaves: pd.Series) -> pd.DataFrame:
    rows = []
    for text in leaves:
        leaf = parse_leaf(text) if text is not None else None
        rows.append((leaf[0], leaf[1], dns_names(leaf[2])) if leaf else (None, None, None))
    out = pd.DataFrame(rows, columns=["timestamp_ms", "entry_type", "names"])
    return out.astype({"timestamp_ms": "Int64", "entry_type": "Int32"})


def sightings(entries: DataFrame, keep: Callable[[Column], Column] | None = None) -> DataFrame:
    """Sightings (ord, name, issuer, not_before, logged_at, source) of log entries (log_url, idx, leaf_input).

    Unreadable leaves give none; each name of a log counts once, at its first entry.  keep: a
    condition on the name; it is tested before names are shuffled.
    """
    rows = entries.select("log_url", "idx", decode_leaf("leaf_input").alias("leaf")).where("leaf.timestamp_ms IS NOT NULL")
    names = rows.select("log_url", "idx", "leaf.timestamp_ms", F.explode("leaf.names").alias("raw")).withColumn("name", domains.normalize(F.col("raw"))).where("name <> ''")
    if keep is not None:
        names = names.where(keep(F.col("name")))
    first = names.groupBy("log_url", "name").agg(F.min(F.struct("idx", "timestamp_ms")).alias("f"))
    none = F.lit(None)
    return first.select(F.col("f.idx").alias("ord"), "name", none.cast("string").alias("issuer"), none.cast("timestamp").alias("not_before"), F.timestamp_millis("f.timestamp_ms").alias("logged_at"), F.lit("ct").alias("source"))


def scan_totals(entries: DataFrame) -> DataFrame:
    """By log: entries read, names found, leaves that couldn't be read."""
    rows = entries.select("log_url", decode_leaf("leaf_input").alias("leaf"))
    return rows.groupBy("log_url").agg(F.count("*").alias("entries"), F.sum(F.coalesce(F.size("leaf.names"), F.lit(0)).cast("long")).alias("names"), F.count_if(F.col("leaf.timestamp_ms").isNull()).alias("unparsed"))


def usable_logs(lists: DataFrame, column: str = "json") -> DataFrame:
    """ord, url (with a final slash), description, operator of the usable logs of a list's JSON."""
    parsed = lists.select(F.from_json(column, LOG_LIST).alias("l")).select(F.posexplode("l.operators").alias("o", "operator")).select("o", F.coalesce("operator.name", F.lit("unknown")).alias("operator"), F.posexplode("operator.logs").alias("i", "log"))
    rows = parsed.where(F.col("log.url").isNotNull() & (F.try_element_at(F.map_keys("log.state"), F.lit(1)) == "usable"))
    url = F.when(F.endswith("log.url", F.lit("/")), F.col("log.url")).otherwise(F.concat("log.url", F.lit("/")))
    return rows.select((F.col("o") * 100_000 + F.col("i")).alias("ord"), url.alias("url"), F.coalesce("log.description", "log.url").alias("description"), "operator")


def start_at(cursor: int, head: int, max_lag: int = 0) -> tuple[int, int]:
    """The same as start_index, for a source's own cursors."""
    at = cursor if 0 < cursor <= head else max(0, head - BACKFILL)
    ahead = max(0, head - max_lag) if 0 < max_lag < head - at else at
    return ahead, ahead - at


def start_index(cursor: Column, head: Column, max_lag: Column | int = 0) -> tuple[Column, Column]:
    """(first index to read, entries skipped): a log without a valid cursor starts shortly before its head,

    and one that is further behind than ``max_lag`` (0: no bound) jumps ahead.
    """
    recent = F.greatest(F.lit(0), head - BACKFILL)
    at = F.when((cursor > 0) & (cursor <= head), cursor).otherwise(recent)
    lag = F.lit(max_lag) if isinstance(max_lag, int) else max_lag
    ahead = F.when((lag > 0) & (head - at > lag), F.greatest(F.lit(0), head - lag)).otherwise(at)
    return ahead, ahead - at
