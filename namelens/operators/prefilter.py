"""A cheap test of names at the source, before they are matched.

``compat`` tests names as they come, for terms inside them and terms one deletion
away; some names that the matcher would accept don't pass.  ``sound`` folds names
first and allows two deletions, so that no such name is lost.

Nothing loops over names times terms: a name gives keys (runs of five characters, whole
parts, deletions of parts), a term gives keys of the same kinds, and what meets under a
key is verified.  Names are scanned twice, once for the keys and once for the rows whose
name has passed; only the names that passed are shuffled.

Defined results: a null name never passes; rows with one name pass together; without a
usable term or a name nothing passes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from namelens import constants as C
from namelens.functions import domains, edit, folding

#: Keys of terms up to which their table is broadcast (about 40 bytes each).
BROADCAST_KEYS = 400_000


def usable_terms(terms: list[str]) -> list[str]:
    squeezed = ("".join(c for c in t.lower() if c.isascii() and c.isalnum()) for t in terms)
    return sorted({t for t in squeezed if len(t) >= C.TERM_LENGTH})


def _key(kind: str, key: Column, probe: Column) -> Column:
    return F.struct(F.lit(kind).alias("kind"), key.alias("key"), probe.alias("probe"))


def _term_keys(terms: DataFrame, most: int) -> DataFrame:
    """kind, key, term: the start of a long term, a short term, deletions of one that may be misspelt."""
    length, term = F.length("term"), F.col("term")
    none = F.array().cast("array<struct<kind:string,key:string,probe:string>>")
    keys = F.concat(
        F.when(length >= C.SUBSTRING_LENGTH, F.array(_key("inside", F.substring("term", 1, C.SUBSTRING_LENGTH), term))).otherwise(F.array(_key("part", term, term))),
        F.when(length >= C.FUZZY_LENGTH, F.transform(edit.neighbourhood(term, most), lambda k: _key("near", k, term))).otherwise(none),
    )
    return terms.select(F.explode(keys).alias("k")).select("k.kind", "k.key", F.col("k.probe").alias("term"))


def _name_keys(form: Column, low: int, high: int, most: int) -> Column:
    """The keys of a form of a name, with what is verified under each."""
    flat, n = domains.flatten(form), C.SUBSTRING_LENGTH
    parts = F.array_distinct(F.concat(F.array(flat), F.split(F.lower(form), "[^a-z0-9]+")))
    starts = F.when(F.length(flat) >= n, F.sequence(F.lit(1), F.length(flat) - n + 1)).otherwise(F.array().cast("array<int>"))
    inside = F.transform(F.array_distinct(F.transform(starts, lambda i: F.substring(flat, i, F.lit(n)))), lambda s: _key("inside", s, flat))
    near = F.transform(F.filter(parts, lambda p: F.length(p).between(low, high)), lambda p: F.transform(edit.neighbourhood(p, most), lambda k: _key("near", k, p)))
    return F.concat(inside, F.transform(parts, lambda p: _key("part", p, p)), F.flatten(near))


def interesting(names: DataFrame, terms: list[str], mode: str = "compat") -> DataFrame:
    """The rows of ``names`` (name) that may match one of the terms; undecodable international names pass."""
    terms = usable_terms(terms)
    if mode not in ("compat", "sound"):
        raise ValueError(f"mode is compat or sound, not {mode}")
    if not terms:
        return names.limit(0)
    lower = F.lower("name")
    encoded = domains.is_punycode(lower)
    folded = folding.fold(lower if mode == "sound" else F.when(encoded, lower))
    rows = names.select("name", F.array_distinct(F.array_compact(F.array(lower, folded["folded"]))).alias("forms"), (encoded & folding.to_unicode(lower).isNull()).alias("odd"))
    most = 1 if mode == "compat" else C.MAX_DISTANCE
    fuzzy = [len(t) for t in terms if len(t) >= C.FUZZY_LENGTH]
    low, high = (min(fuzzy) - most, max(fuzzy) + most) if fuzzy else (1, 0)
    keys = _term_keys(names.sparkSession.createDataFrame([(t,) for t in terms], "term string"), most)
    keys = F.broadcast(keys) if keys.count() <= BROADCAST_KEYS else keys
    odd = F.when(F.col("odd"), F.array(_key("odd", F.lit(""), F.lit("")))).otherwise(F.array().cast("array<struct<kind:string,key:string,probe:string>>"))
    probes = rows.select("name", F.explode(F.concat(odd, F.flatten(F.transform("forms", lambda f: _name_keys(f, low, high, most))))).alias("k")).select("name", "k.*")
    met = probes.join(keys, ["kind", "key"], "left").where((F.col("kind") == "odd") | F.when(F.col("kind") == "inside", F.contains("probe", "term")).otherwise(F.col("term").isNotNull()))
    return names.join(met.select("name").distinct(), "name", "left_semi").select(*names.columns)


def scan(entries: DataFrame, terms: list[str], mode: str = "compat") -> DataFrame:
    """Sightings of log entries, only those whose name is interesting; see certificates.sightings."""
    from namelens.sources.certificates import sightings

    return interesting(sightings(entries), terms, mode)
