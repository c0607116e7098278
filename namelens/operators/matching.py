"""Names against a watchlist: exact, substring and edit-distance joins, and the best match of a domain.

No nested loop over names and terms.  Exact matches are an equi-join on tokens,
substring matches one on the first five characters of a term, and fuzzy matches one
on deletion neighbourhoods; what the join finds is then verified.  The watchlist side
is broadcast up to ``BROADCAST_TERMS`` terms and shuffled beyond that.

Defined results: null and empty names match nothing; repeated names give one domain; of equal matches
the one that stands first in the watchlist is best; without names or terms there are no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from namelens import constants as C
from namelens.functions import domains, edit, folding

#: Terms up to which the watchlist is broadcast; a term has about 200 deletion keys of 30 bytes.
BROADCAST_TERMS = 2_000
_SEED = C.SUBSTRING_LENGTH


def explode_terms(brands: DataFrame) -> DataFrame:
    """brand_id, brand_slug, brand_ord, official_domains (lower case), term, term_ord of active brands.

    brands: id, slug, official_domains, match_terms, active and ord, its place in the list.
    """
    rows = brands.where("active").select(
        F.col("id").alias("brand_id"), F.col("slug").alias("brand_slug"), F.col("ord").alias("brand_ord"),
        F.transform("official_domains", lambda d: F.lower(d)).alias("official_domains"), F.posexplode("match_terms").alias("term_ord", "raw"),
    )
    return rows.withColumn("term", F.trim(F.lower("raw"))).where("term <> ''").drop("raw")


def screened(names: DataFrame, allowlist: DataFrame | None = None) -> DataFrame:
    """The distinct registrable domains of ``names`` (name) that are to be matched, with their folded label.

    domain, unicode_domain, fold, tokens, flat, keywords.  Names without a registrable
    domain, on shared platforms or in ``allowlist`` (domain) are left out.
    """
    rows = names.select(domains.registrable_domain(F.col("name")).alias("domain")).where("domain IS NOT NULL").distinct()
    rows = rows.where(~domains.is_ignorable(F.col("domain")))
    if allowlist is not None:
        known = allowlist.select(F.trim(F.lower("domain")).alias("domain")).distinct()
        rows = rows.join(known, "domain", "left_anti")
    rows = rows.withColumn("ascii_label", domains.registrable_label(F.col("domain"))).where("ascii_label <> ''")
    rows = rows.withColumn("fold", folding.fold(F.col("ascii_label")))
    return rows.select(
        "domain", folding.to_unicode(F.col("domain")).alias("unicode_domain"), "fold", domains.tokenize(F.col("fold.folded")).alias("tokens"),
        domains.flatten(F.col("fold.folded")).alias("flat"), domains.keyword_hits(domains.tokenize(F.col("fold.folded"))).alias("keywords"),
    )


def _sized(terms: DataFrame) -> tuple[DataFrame, bool]:
    terms = terms.select("term").distinct()
    return terms, terms.count() <= BROADCAST_TERMS


def _join(left: DataFrame, right: DataFrame, on: str | list[str], small: bool) -> DataFrame:
    return left.join(F.broadcast(right) if small else right, on)


def exact_pairs(labels: DataFrame, terms: DataFrame) -> DataFrame:
    """(domain, term): the term is a token of the label, or the whole label without separators."""
    terms, small = _sized(terms)
    probes = labels.select("domain", F.explode(F.array_distinct(F.concat(F.array("flat"), "tokens"))).alias("term"))
    return _join(probes, terms, "term", small).select("domain", "term")


def substring_pairs(labels: DataFrame, terms: DataFrame) -> DataFrame:
    """(domain, term): the label without separators contains the term; terms of five characters or more only."""
    terms, small = _sized(terms.where((F.length("term") >= _SEED) & ~F.col("term").isin(*C.TOKEN_ONLY_TERMS)))
    starts = F.when(F.length("flat") >= _SEED, F.sequence(F.lit(1), F.length("flat") - _SEED + 1)).otherwise(F.array().cast("array<int>"))
    seeds = labels.select("domain", "flat", F.explode(F.array_distinct(F.transform(starts, lambda i: F.substring("flat", i, F.lit(_SEED))))).alias("seed"))
    return _join(seeds, terms.withColumn("seed", F.substring("term", 1, _SEED)), "seed", small).where(F.contains("flat", "term")).select("domain", "term")


def fuzzy_pairs(labels: DataFrame, terms: DataFrame) -> DataFrame:
    """(domain, term, distance): the least distance, 1 or 2, of the term to a probe; terms of six characters or more only."""
    terms, small = _sized(terms.where(F.length("term") >= C.FUZZY_LENGTH))
    keys = terms.select("term", F.explode(edit.neighbourhood(F.col("term"))).alias("key"))
    lengths = terms.agg(F.min(F.length("term")), F.max(F.length("term"))).first()
    low, high = (lengths[0] or 0) - C.MAX_DISTANCE, (lengths[1] or 0) + C.MAX_DISTANCE
    probes = labels.select("domain", F.explode(F.array_distinct(F.concat(F.array("flat"), "tokens"))).alias("probe"))
    probes = probes.where(F.length("probe").between(low, high) & ~F.col("probe").isin(*C.STOP_PROBES))
    near = probes.select("domain", "probe", F.explode(edit.neighbourhood(F.col("probe"))).alias("key"))
    found = _join(near, keys, "key", small).where(F.abs(F.length("probe") - F.length("term")) <= C.MAX_DISTANCE).select("domain", "probe", "term").distinct()
    measured = found.withColumn("distance", edit.osa_within_two(F.col("probe"), F.col("term"))).where(F.col("distance").between(1, C.MAX_DISTANCE))
    return measured.groupBy("domain", "term").agg(F.min("distance").alias("distance"))


def candidate_pairs(labels: DataFrame, terms: DataFrame) -> DataFrame:
    """(domain, term, kind, distance): of several kinds the first of exact, substring, fuzzy.

    One pass over the labels and one join: a label gives keys of all three kinds, and so
    does a term; what meets under a key is verified by its kind.
    """
    terms, small = _sized(terms)
    length = F.length("term")
    key = lambda kind, k: F.struct(F.lit(kind).alias("kind"), k.alias("key"))
    none = F.array().cast("array<struct<kind:string,key:string>>")
    term_keys = terms.select("term", F.explode(F.concat(
        F.array(key("exact_token", F.col("term"))),
        F.when((length >= _SEED) & ~F.col("term").isin(*C.TOKEN_ONLY_TERMS), F.array(key("substring", F.substring("term", 1, _SEED)))).otherwise(none),
        F.when(length >= C.FUZZY_LENGTH, F.transform(edit.neighbourhood(F.col("term")), lambda k: key("edit_distance", k))).otherwise(none),
    )).alias("k")).select("term", "k.kind", "k.key")
    longest = terms.agg(F.max(length)).first()[0] or 0

    probe = lambda kind, k, p: F.struct(F.lit(kind).alias("kind"), k.alias("key"), p.alias("probe"))
    parts = F.array_distinct(F.concat(F.array("flat"), "tokens"))
    starts = F.when(F.length("flat") >= _SEED, F.sequence(F.lit(1), F.length("flat") - _SEED + 1)).otherwise(F.array().cast("array<int>"))
    seeds = F.array_distinct(F.transform(starts, lambda i: F.substring("flat", i, F.lit(_SEED))))
    close = F.filter(parts, lambda p: F.length(p).between(C.FUZZY_LENGTH - C.MAX_DISTANCE, longest + C.MAX_DISTANCE) & ~p.isin(*C.STOP_PROBES))
    probes = labels.select("domain", F.explode(F.concat(
        F.transform(parts, lambda p: probe("exact_token", p, p)),
        F.transform(seeds, lambda s: probe("substring", s, F.col("flat"))),
        F.flatten(F.transform(close, lambda p: F.transform(edit.neighbourhood(p), lambda k: probe("edit_distance", k, p)))),
    )).alias("k")).select("domain", "k.kind", "k.key", "k.probe")
    met = _join(probes, term_keys, ["kind", "key"], small)
    fits = F.when(F.col("kind") == "substring", F.contains("probe", "term")).when(F.col("kind") == "edit_distance", F.abs(F.length("probe") - length) <= C.MAX_DISTANCE).otherwise(F.lit(True))
    met = met.where(fits).select("domain", "term", "kind", "probe").distinct()
    fuzzy = F.col("kind") == "edit_distance"
    distance = F.when(fuzzy, edit.osa_within_two(F.when(fuzzy, F.col("probe")), F.when(fuzzy, F.col("term")))).otherwise(F.lit(0))
    order = F.when(F.col("kind") == "exact_token", 1).when(F.col("kind") == "substring", 2).otherwise(3)
    hits = met.withColumn("distance", distance).where(~fuzzy | F.col("distance").between(1, C.MAX_DISTANCE))
    best = hits.groupBy("domain", "term").agg(F.min(F.struct(order.alias("n"), "distance", "kind")).alias("hit"))
    return best.select("domain", "term", "hit.kind", "hit.distance")


def upgraded(kind: Column, fold: Column, keywords: Column) -> Column:
    """Look-alike characters make any kind a homoglyph; keywords make a substring a keyword_combo."""
    beyond = F.exists(fold["substitutions"], lambda s: domains.has_non_ascii(s["from"]))
    return F.when(fold["suspicious"] & beyond, "homoglyph").when((F.size(keywords) > 0) & (kind == "substring"), "keyword_combo").otherwise(kind)


def rank(kind: Column) -> Column:
    return F.element_at(F.create_map(*[x for k, v in C.KIND_RANK.items() for x in (F.lit(k), F.lit(v))]), kind)


def best_first() -> list[Column]:
    """Order of a domain's matches: stronger kind, smaller distance, longer term, then place in the watchlist."""
    return [F.desc("rank"), F.asc("edit_distance"), F.length("matched_term").desc(), F.asc("brand_ord"), F.asc("term_ord")]


def all_matches(names: DataFrame, brands: DataFrame, allowlist: DataFrame | None = None) -> DataFrame:
    """Every (domain, brand, term) that matches; a brand's own domains never do."""
    labels = screened(names, allowlist)
    terms = explode_terms(brands)
    pairs = candidate_pairs(labels, terms)
    joined = pairs.join(labels, "domain").join(terms, "term").where(~F.coalesce(F.array_contains("official_domains", F.col("domain")), F.lit(False)))
    kind = upgraded(F.col("kind"), F.col("fold"), F.col("keywords"))
    return joined.select(
        "domain", "unicode_domain", "brand_id", "brand_slug", F.col("term").alias("matched_term"), kind.alias("match_kind"), F.col("distance").alias("edit_distance"),
        F.col("fold.suspicious").alias("homoglyph_flag"),
        F.when(F.col("fold.suspicious"), F.struct("fold.substitutions", "fold.mixed_script", "fold.scripts")).alias("homoglyph_detail"),
        "keywords", rank(kind).alias("rank"), "brand_ord", "term_ord",
    )


def best_matches(names: DataFrame, brands: DataFrame, allowlist: DataFrame | None = None) -> DataFrame:
    """The one match of each domain that has any."""
    first = F.row_number().over(Window.partitionBy("domain").orderBy(*best_first()))
    return all_matches(names, brands, allowlist).withColumn("n", first).where("n = 1").drop("n", "rank", "brand_ord", "term_ord")
