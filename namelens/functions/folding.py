"""Folding of look-alike characters and decoding of international names.

Spark has no Unicode normalisation, so text beyond ASCII goes through a pandas UDF in Arrow
batches; ASCII text, nearly all of it, is folded by ``translate``.  What becomes of a character
depends on it alone once compatibility forms are unified, so a text is folded by two calls in
C, whatever its length: ``normalize``, and ``translate`` by a table that is filled in with each
character when it is first met.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from namelens import constants as C
from namelens.functions import domains

_CHANGE = T.StructType([T.StructField(n, T.StringType()) for n in ("from", "to", "codepoint")])
FOLD = T.StructType([
    T.StructField("folded", T.StringType()), T.StructField("suspicious", T.BooleanType()), T.StructField("substitutions", T.ArrayType(_CHANGE)),
    T.StructField("mixed_script", T.BooleanType()), T.StructField("scripts", T.ArrayType(T.StringType())),
])

_TO_ASCII = {c: to for to, every in C.LOOKALIKES.items() for c in every} | C.DIGIT_SWAPS | {chr(zero + d): str(d) for zero in C.DIGIT_ZEROS for d in range(10)}


class _Character:
    """What becomes of one character, and what that tells."""

    __slots__ = ("beyond", "change", "script", "to")

    def __init__(self, cp: int) -> None:
        c = chr(cp)
        letters = "".join(x for x in unicodedata.normalize("NFD", c) if not 0x0300 <= ord(x) <= 0x036F) or c
        listed = _TO_ASCII.get(letters) or _TO_ASCII.get(c)
        self.to = listed or letters.lower()
        folds = letters != c or (listed is not None and listed != c)
        self.change = {"from": c, "to": self.to, "codepoint": f"U+{cp:04X}"} if folds else None
        self.beyond = cp > 0x7F and (folds or letters not in _TO_ASCII)
        self.script = next((name for name, ranges in C.SCRIPTS.items() if any(a <= cp <= b for a, b in ranges)), None)


class _Characters(dict):
    def __missing__(self, cp: int) -> _Character:
        self[cp] = found = _Character(cp)
        return found


class _Table(dict):
    """The texts that characters become, for str.translate."""

    def __missing__(self, cp: int) -> str:
        self[cp] = to = _CHARACTERS[cp].to
        return to


_CHARACTERS, _TABLE = _Characters(), _Table()


def folded_text(text: str) -> str:
    """The ASCII skeleton of a text."""
    return unicodedata.normalize("NFKC", text).translate(_TABLE)


def fold_text(label: str) -> dict:
    """The ASCII skeleton of a label and what was changed for it.

    Compatibility forms are unified first, so full-width and mathematical letters
    never count as changed.
    """
    text = unicodedata.normalize("NFKC", label)
    kinds = {c: _CHARACTERS[ord(c)] for c in dict.fromkeys(text)}  # in order of their first places
    scripts = [s for s in dict.fromkeys(k.script for k in kinds.values()) if s not in (None, "Digit")]
    changes = {c: k.change for c, k in kinds.items() if k.change}
    mixed = len(scripts) > 1
    return {
        "folded": text.translate(_TABLE), "suspicious": mixed or any(k.beyond for k in kinds.values()), "substitutions": [changes[c] for c in text if c in changes] if changes else [],
        "mixed_script": mixed, "scripts": scripts,
    }


def decode_text(domain: str) -> str | None:
    """The Unicode form of a domain with international labels; null if there is none or one can't be decoded."""
    labels = domain.split(".")
    if not any(x.startswith("xn--") for x in labels):
        return None
    try:
        return ".".join(x[4:].encode("ascii").decode("punycode") if x.startswith("xn--") else x for x in labels)
    except (UnicodeError, ValueError, OverflowError):
        return None


@F.pandas_udf(FOLD)
def _fold(labels: pd.Series) -> pd.DataFrame:
    columns = ["folded", "suspicious", "substitutions", "mixed_script", "scripts"]
    rows = [fold_text(decode_text(x) or x) if x is not None else dict.fromkeys(columns) for x in labels]
    return pd.DataFrame(rows, columns=columns)


@F.pandas_udf(T.StringType())
def _folded(labels: pd.Series) -> pd.Series:
    return pd.Series([folded_text(decode_text(x) or x) if x is not None else None for x in labels], dtype=object)


def _is_odd(label: Column) -> Column:
    """Whether a label is beyond ASCII or encoded, and so leaves the JVM."""
    return domains.has_non_ascii(label) | label.rlike(r"(?:^|\.)xn--")


def _to_letters(text: Column) -> Column:
    return F.translate(text, "".join(C.DIGIT_SWAPS), "".join(C.DIGIT_SWAPS.values()))


def folded(label: Column) -> Column:
    """The ASCII skeleton of a label, decoded first if it is an international one, or of a text."""
    odd = _is_odd(label)
    # marked, here and below, so that Spark neither repeats it nor moves it into a filter
    return F.when(odd, _folded.asNondeterministic()(F.when(odd, label))).otherwise(_to_letters(F.lower(label)))


def fold(label: Column) -> Column:
    """A struct of FOLD for a label, decoded first if it is an international one."""
    swapped = F.filter(F.split(label, ""), lambda c: c.isin(*C.DIGIT_SWAPS))
    plain = F.struct(
        _to_letters(F.lower(label)).alias("folded"), F.lit(False).alias("suspicious"),
        F.transform(swapped, lambda c: F.struct(c.alias("from"), _to_letters(c).alias("to"), F.concat(F.lit("U+00"), F.hex(F.ascii(c))).alias("codepoint"))).alias("substitutions"),
        F.lit(False).alias("mixed_script"), F.when(label.rlike("[A-Za-z]"), domains.lits(["Latin"])).otherwise(F.array().cast("array<string>")).alias("scripts"),
    )
    odd = _is_odd(label)
    return F.when(odd, _fold.asNondeterministic()(F.when(odd, label))).otherwise(F.when(label.isNotNull(), plain.cast(FOLD)))


@F.pandas_udf(T.StringType())
def _decode(domains_: pd.Series) -> pd.Series:
    return domains_.map(lambda x: decode_text(x) if x is not None else None)


def to_unicode(domain: Column) -> Column:
    encoded = domains.is_punycode(domain)
    return F.when(encoded, _decode.asNondeterministic()(F.when(encoded, domain)))


def described(substitutions: Column) -> Column:
    """The changed characters beyond ASCII, as one line."""
    beyond = F.filter(substitutions, lambda s: domains.has_non_ascii(s["from"]))
    return F.array_join(F.transform(beyond, lambda s: F.concat(s["from"], F.lit(" ("), s["codepoint"], F.lit(') posing as "'), s["to"], F.lit('"'))), "; ")
