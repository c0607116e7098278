"""Risk scores: signals with their points, labels and details, the total, gates, tiers and states.

One projection of built-in expressions.  Input columns are named as in the
candidates and verifications tables (``INPUT``); a null counts as not seen.  Those of
``TOLD`` are only spoken of in labels and details, and may be missing.

Defined results: a null condition shows no signal; a missing value leaves its place in a label empty and
gives no detail; repeated rows are scored alike; an empty table gives no rows; other columns stay.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from namelens import constants as C
from namelens.functions import domains
from namelens.operators.ranking import free

INPUT = (
    "domain", "match_kind", "edit_distance", "mixed_script", "resolves", "has_mx", "domain_age_days", "domain_created_at", "cert_issued_at", "cert_issuer",
    "has_password_field", "brand_terms_on_page", "form_posts_offsite", "looks_parked", "asn_reputation_score",
)
TOLD = {
    "matched_term": "string", "brand_name": "string", "homoglyph_detail": "struct<substitutions:array<struct<from:string,to:string,codepoint:string>>,scripts:array<string>>",
    "a_records": "array<string>", "asn": "string", "asn_org": "string",
}
SIGNAL = "struct<key:string,label:string,points:int,category:string,detail:string>"


def days_between(later: Column, earlier: Column) -> Column:
    """Whole days, rounded down; negative if it is earlier."""
    return F.floor((F.unix_millis(later) - F.unix_millis(earlier)) / F.lit(86_400_000)).cast("long")


def is_free_issuer(issuer: Column) -> Column:
    return F.lower(issuer).rlike("|".join(map(re.escape, C.FREE_ISSUERS)))


def _shown() -> list[tuple[str, Column]]:
    """(key, condition) of every signal, in fixed order."""
    kind, age = F.col("match_kind"), F.col("domain_age_days")
    gap = days_between(F.col("cert_issued_at"), F.col("domain_created_at"))
    brand = F.size(F.coalesce("brand_terms_on_page", F.array().cast("array<string>"))) > 0
    every = [
        ("name.homoglyphNonAscii", kind == "homoglyph"),
        ("name.exactToken", kind.isin("exact_token", "keyword_combo")),
        ("name.editDistance1", (kind == "edit_distance") & (F.col("edit_distance") == 1)),
        ("name.editDistance2", (kind == "edit_distance") & (F.col("edit_distance") != 1)),
        ("name.substring", kind == "substring"),
        ("name.phishingKeyword", domains.has_keyword(F.col("domain"))),
        ("name.mixedScript", F.col("mixed_script") & (kind != "homoglyph")),
        ("infrastructure.resolves", F.col("resolves")),
        ("infrastructure.hasMx", F.col("has_mx")),
        ("registration.ageUnder3Days", age < 3),
        ("registration.ageUnder7Days", (age >= 3) & (age < 7)),
        ("registration.ageUnder30Days", (age >= 7) & (age < 30)),
        ("registration.ageUnder90Days", (age >= 30) & (age < 90)),
        ("registration.ageOver1Year", age > 365),
        ("content.passwordField", F.col("has_password_field")),
        ("content.brandOnPage", brand),
        ("content.passwordAndBrand", F.col("has_password_field") & brand),
        ("content.formPostsOffsite", F.col("form_posts_offsite")),
        ("content.looksParked", F.col("looks_parked")),
        ("certificate.certSameDayAsRegistration", gap <= 0),
        ("certificate.certWithin3Days", (gap > 0) & (gap <= 3)),
        ("certificate.freeDvIssuer", is_free_issuer(F.col("cert_issuer"))),
        ("hosting.knownAbusedAsn", F.col("asn_reputation_score") > 50),
    ]
    return [(key, shown) for key, shown in every if C.WEIGHTS[key]]


def _category(key: str) -> str:
    return "mitigating" if key in C.MITIGATING else key.partition(".")[0]


def filled(pattern: str, *values: Column) -> Column:
    """The pattern with its places filled in; a missing value leaves its place empty."""
    pieces = pattern.split("{}")
    parts = [x for piece, value in zip(pieces, (*values, None), strict=True) for x in ((F.lit(piece),) if value is None else (F.lit(piece), F.coalesce(value.cast("string"), F.lit(""))))]
    return F.concat(*parts)


def _plural(n: Column) -> Column:
    return F.when(n == 1, "").otherwise("s")


def looks_like(substitutions: Column) -> Column:
    """The changed characters beyond ASCII and what they look like, as one line; null if nothing was changed."""
    beyond = F.filter(substitutions, lambda s: domains.has_non_ascii(s["from"]))
    line = F.array_join(F.transform(beyond, lambda s: F.concat(s["from"], F.lit(" ("), s["codepoint"], F.lit(') looks like "'), s["to"], F.lit('"'))), "; ")
    return F.when(F.size(substitutions) > 0, line)


def _spoken(told: dict[str, Column]) -> tuple[dict[str, Column], dict[str, Column]]:
    """(labels, details) by key."""
    age, gap = F.col("domain_age_days"), days_between(F.col("cert_issued_at"), F.col("domain_created_at"))
    term, fold = told["matched_term"], told["homoglyph_detail"]
    labels = {key: F.lit(text) for key, text in C.LABELS.items() if "{}" not in text}
    labels |= {
        "name.exactToken": F.when(F.col("match_kind") == "keyword_combo", filled(C.LABELS["name.exactToken/keyword_combo"], term)).otherwise(filled(C.LABELS["name.exactToken"], term)),
        "name.editDistance1": filled(C.LABELS["name.editDistance1"], F.col("edit_distance"), term), "name.editDistance2": filled(C.LABELS["name.editDistance2"], F.col("edit_distance"), term),
        "name.substring": filled(C.LABELS["name.substring"], term), "content.brandOnPage": filled(C.LABELS["content.brandOnPage"], told["brand_name"]),
        "certificate.certWithin3Days": filled(C.LABELS["certificate.certWithin3Days"], gap, _plural(gap)),
        "registration.ageOver1Year": filled(C.LABELS["registration.ageOver1Year"], F.floor(age / 365), F.when(age >= 730, "s").otherwise("")),
    }
    labels |= {key: filled(C.LABELS["registration.young"], age, _plural(age)) for key in C.WEIGHTS if key.startswith("registration.ageUnder")}
    details = {
        "name.homoglyphNonAscii": looks_like(fold["substitutions"]), "name.phishingKeyword": F.array_join(domains.keyword_hits(domains.tokenize(F.col("domain"))), ", "),
        "name.mixedScript": F.array_join(fold["scripts"], " + "), "infrastructure.resolves": F.array_join(F.slice(told["a_records"], 1, 3), ", "),
        "content.brandOnPage": F.array_join("brand_terms_on_page", ", "), "certificate.freeDvIssuer": F.col("cert_issuer"), "hosting.knownAbusedAsn": F.coalesce(told["asn_org"], told["asn"]),
    }
    return labels, details


def category_points() -> dict[str, Column]:
    """By category: the points that a row's signals add in it, without those that are taken away; plain sums, no list of signals."""
    sums = {_category(key): F.lit(0) for key in C.WEIGHTS}
    for key, shown in _shown():
        if C.WEIGHTS[key] > 0:
            sums[_category(key)] += F.when(shown, C.WEIGHTS[key]).otherwise(0)
    return sums


def points_taken() -> Column:
    """The points that a row's mitigating signals take away, as a number below zero; zero if it shows none."""
    return sum((F.when(shown, C.WEIGHTS[key]).otherwise(0) for key, shown in _shown() if C.WEIGHTS[key] < 0), F.lit(0))


def _those(pairs: list[tuple[Column, Column]], kind: str) -> Column:
    """The values whose condition holds, in order.  Spark compiles it, where it would interpret a filter over all of them."""
    return F.concat(*[F.when(holds, F.array(value)).otherwise(F.array()).cast(f"array<{kind}>") for holds, value in pairs])


def signals(rows: DataFrame) -> Column:
    """The signals (SIGNAL) that a row shows, in fixed order; those without points are left out."""
    told = {name: F.col(name) if name in rows.columns else F.lit(None).cast(kind) for name, kind in TOLD.items()}
    if "homoglyph_detail" in rows.columns:  # callers may hold less of it
        held = rows.schema["homoglyph_detail"].dataType.fieldNames()
        wanted = {"substitutions": "array<struct<from:string,to:string,codepoint:string>>", "scripts": "array<string>"}
        told["homoglyph_detail"] = F.struct(*[(told["homoglyph_detail"][n] if n in held else F.lit(None)).cast(kind).alias(n) for n, kind in wanted.items()])
    labels, details = _spoken(told)
    none = F.lit(None).cast("string")
    one = lambda key: F.struct(F.lit(key).alias("key"), labels[key].alias("label"), F.lit(C.WEIGHTS[key]).alias("points"), F.lit(_category(key)).alias("category"), details.get(key, none).alias("detail"))
    return _those([(shown, one(key)) for key, shown in _shown()], SIGNAL)


def tier(score: Column) -> Column:
    return F.when(score >= C.TIER_HIGH, "high").when(score >= C.TIER_MEDIUM, "medium").otherwise("low")


def gated(score: Column, resolves: Column, found_categories: Column, keys: Column) -> tuple[Column, Column]:
    """(tier, note): a high tier falls to medium unless three conditions hold; no gate raises a tier."""
    high = tier(score) == "high"
    dead = ~F.coalesce(resolves, F.lit(False))
    kinds = F.size(found_categories)
    weak = ~F.arrays_overlap(keys, domains.lits(C.STRONG_SIGNALS))
    few = filled(C.GATE_NOTES["few"], kinds, _plural(kinds), F.array_join(found_categories, ", "), F.lit(C.MIN_CATEGORIES))
    note = F.when(high & dead, C.GATE_NOTES["dead"]).when(high & (kinds < C.MIN_CATEGORIES), few).when(high & weak, C.GATE_NOTES["weak"])
    return F.when(note.isNotNull(), "medium").otherwise(tier(score)), note


def publish_state(tier_: Column, state: Column) -> Column:
    """The state that follows from the tier; a cleared candidate stays cleared."""
    return F.when(state == "cleared", "cleared").when(tier_ == "high", "published").when(tier_ == "medium", "pending_review").otherwise("hidden")


def scored(rows: DataFrame, notes: bool = False) -> DataFrame:
    """rows with signals, score, categories, tier and gate_note; with notes the gate's note is a signal as well, its text the label.

    The score follows from sums of points, so that signals with their labels are made only where they are asked for.
    They are left out of whole-stage code by the lambda in the detail of keywords; all in one method, they would be too long
    for the JVM to compile.
    """
    sums = category_points() | {"mitigating": points_taken()}
    held, found = {category: free(rows, f"points_{category}") for category in sums}, free(rows, "found")
    strong = _those([(shown, F.lit(key)) for key, shown in _shown() if key in C.STRONG_SIGNALS and C.WEIGHTS[key] > 0], "string")
    listed = signals(rows)
    out = rows.withColumns({held[category]: points for category, points in sums.items()})
    out = out.withColumns({
        "score": F.greatest(F.lit(0), F.least(F.lit(100), sum((F.col(name) for name in held.values()), F.lit(0)))),
        "categories": _those([(F.col(name) > 0, F.lit(category)) for category, name in held.items()], "string"),
    })
    tier_, note = gated(F.col("score"), F.col("resolves"), F.col("categories"), strong)
    out = out.withColumns({"tier": tier_, "gate_note": note, found: listed})
    # the list is named twice, so that Spark makes it in a step of its own and not, interpreted, under a lambda of whoever reads it
    spoken = F.when(F.size(found) > 0, F.col(found)).otherwise(F.array().cast(f"array<{SIGNAL}>"))
    if notes:
        gate = F.struct(F.lit("gate.note").alias("key"), F.col("gate_note").alias("label"), F.lit(0).alias("points"), F.lit("mitigating").alias("category"), F.lit(None).cast("string").alias("detail")).cast(SIGNAL)
        spoken = F.when(F.col("gate_note").isNotNull(), F.concat(found, F.array(gate))).otherwise(F.col(found))
    return out.withColumn("signals", spoken).drop(*held.values(), found)
