"""Edit distances with a bound, and the deletion neighbourhoods that find candidates by equality."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from namelens import constants as C


def levenshtein(a: Column, b: Column, most: int = C.MAX_DISTANCE) -> Column:
    """Edit distance; most + 1 if it is larger."""
    found = F.levenshtein(a, b, most)
    return F.when(found < 0, most + 1).otherwise(found)


def alignment_distance(a: str, b: str, most: int | None = None) -> int:
    """Optimal string alignment: edits and swaps of neighbours, no part edited twice; most + 1 if it is larger."""
    if most is not None and abs(len(a) - len(b)) > most:
        return most + 1
    two, one = None, list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        now = [i]
        for j, y in enumerate(b, 1):
            best = min(one[j] + 1, now[-1] + 1, one[j - 1] + (x != y))
            if two is not None and j > 1 and x == b[j - 2] and a[i - 2] == y:
                best = min(best, two[j - 2] + 1)
            now.append(best)
        if most is not None and min(now) > most and (two is None or min(one) > most):
            return most + 1
        two, one = one, now
    return one[-1] if most is None else min(one[-1], most + 1)


@F.pandas_udf(T.IntegerType())
def osa_within_two(a: pd.Series, b: pd.Series) -> pd.Series:
    """Optimal string alignment distance, 3 if it is above 2; meant for pairs that a deletion join has found."""
    return pd.Series([None if x is None or y is None else alignment_distance(x, y, 2) for x, y in zip(a, b, strict=True)], dtype="Int32")


@F.pandas_udf(T.DoubleType())
def similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    """1 less the distance over the longer length; 1 for two empty strings."""
    return pd.Series([None if x is None or y is None else 1.0 - alignment_distance(x, y) / max(len(x), len(y), 1) for x, y in zip(a, b, strict=True)])


def deletions(x: Column) -> Column:
    """All strings with one character less."""
    return F.transform(F.when(F.length(x) > 0, F.sequence(F.lit(1), F.length(x))).otherwise(F.array().cast("array<int>")), lambda i: F.concat(F.substring(x, F.lit(1), i - 1), F.substring(x, i + 1, F.length(x))))


def neighbourhood(x: Column, most: int = 2) -> Column:
    """The string and all with up to ``most`` (1 or 2) characters less, each once."""
    one = deletions(x)
    every = F.concat(F.array(x), one)
    if most > 1:
        every = F.concat(every, F.flatten(F.transform(one, deletions)))
    return F.array_distinct(every)


def close_pairs(left: DataFrame, right: DataFrame, text: str, most: int = C.MAX_DISTANCE) -> DataFrame:
    """Pairs of rows whose texts are within ``most`` (1 or 2) edits, swaps not counted as one: the columns of left with the
    suffix _a, those of right with _b, and distance.  They meet under a deletion of both and are then measured."""
    keyed = lambda df, end: df.select(*[F.col(c).alias(c + end) for c in df.columns]).withColumn("key", F.explode(neighbourhood(F.col(text + end), most)))
    a, b = f"{text}_a", f"{text}_b"
    met = keyed(left, "_a").join(keyed(right, "_b"), "key").where(F.abs(F.length(a) - F.length(b)) <= most).drop("key").distinct()
    return met.withColumn("distance", levenshtein(F.col(a), F.col(b), most)).where(F.col("distance") <= most)
