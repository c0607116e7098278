"""The watchlist as a table: brands with derived match terms."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from namelens.functions import domains

BRAND = "ord int, name string, slug string, category string, official_domains array<string>, aliases array<string>, extra array<string>, excluded array<string>, active boolean"


def with_terms(brands: DataFrame) -> DataFrame:
    """Brands (BRAND) with id and match_terms."""
    none = F.array().cast("array<string>")
    derived = domains.match_terms(F.col("name"), F.col("official_domains"), F.coalesce("aliases", none))
    return brands.select("*", F.sha2("slug", 256).alias("id"), domains.final_terms(derived, F.coalesce("extra", none), F.coalesce("excluded", none)).alias("match_terms"))


def brands_of(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    """A small watchlist from literal rows: (slug, official domains, match terms)."""
    data = [(i, slug, slug, list(own), list(terms), True) for i, (slug, own, terms) in enumerate(rows)]
    return spark.createDataFrame(data, "ord int, id string, slug string, official_domains array<string>, match_terms array<string>, active boolean")


def scanner_terms(brands: DataFrame) -> DataFrame:
    """Distinct terms of all brands, longest first."""
    return brands.select(F.explode("match_terms").alias("term")).distinct().orderBy(F.length("term").desc(), "term")


def poll_round(brands: DataFrame, n: int, per_brand: int = 2) -> DataFrame:
    """The n active brands that were polled longest ago, with the terms to search for."""
    from namelens.operators.ranking import least_recent

    return least_recent(brands.where("active"), "last_polled_at", "ord", n).withColumn("terms", domains.poll_terms(F.col("match_terms"), per_brand))
