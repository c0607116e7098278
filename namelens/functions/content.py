"""What a fetched page shows: credential fields, brand mentions, title, offsite forms, parking.

Coarse signals by built-in string functions; a page that can't be read gives no
signal.  A null page counts as an empty one, which looks parked.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from namelens import constants as C
from namelens.functions.domains import let, lits

def _page(html: Column) -> Column:
    return F.coalesce(html, F.lit(""))


def has_password_field(html: Column) -> Column:
    return _page(html).rlike(C.PASSWORD) | _page(html).rlike(C.PASSWORDISH)


def brand_terms_on_page(html: Column, terms: Column) -> Column:
    """Terms of three characters or more that the page contains anywhere, in any case; in their own spelling."""
    return let(F.lower(_page(html)), lambda page: F.array_distinct(F.filter(terms, lambda t: (F.length(t) >= C.TERM_LENGTH) & F.contains(page, F.lower(t)))))


def title(html: Column) -> Column:
    """The first title: entities decoded, white space squeezed, 200 characters; null without one."""
    found = F.regexp_extract(_page(html), C.TITLE, 1)
    for entity, char in C.ENTITIES:
        found = F.replace(found, F.lit(entity), F.lit(char))
    return F.when(_page(html).rlike(C.TITLE), F.substring(F.trim(F.regexp_replace(found, r"\s+", " ")), 1, 200))


def offsite_hosts(html: Column, domain: Column) -> Column:
    """Hosts of absolute form targets that are neither the domain nor below it."""
    actions = F.filter(F.regexp_extract_all(_page(html), F.lit(C.FORM_ACTION), 1), lambda a: a.rlike("(?i)^https?://"))
    hosts = F.transform(actions, lambda a: F.lower(F.try_parse_url(a, F.lit("HOST"))))
    return F.filter(hosts, lambda h: h.isNotNull() & (h != domain) & ~F.endswith(h, F.concat(F.lit("."), domain)))


def form_posts_offsite(html: Column, domain: Column) -> Column:
    return F.size(offsite_hosts(html, domain)) > 0


def looks_parked(html: Column) -> Column:
    """A parking mark, or less than 1500 characters without a password field and a form."""
    marked = let(F.lower(_page(html)), lambda page: F.exists(lits(C.PARKING_MARKERS), lambda m: F.contains(page, m)))
    return marked | ((F.length(_page(html)) < 1500) & ~has_password_field(html) & ~_page(html).rlike("(?i)<form"))


def credential_words(html: Column) -> Column:
    return let(F.lower(_page(html)), lambda page: F.size(F.filter(lits(C.CREDENTIAL_MARKERS), lambda w: F.contains(page, w))))


def content_score(password: Column, brands: Column, offsite: Column, words: Column, parked: Column) -> Column:
    """The page's own score, 0 to 100; a parked page has 10 at most."""
    yes = lambda c, n: F.when(c, n).otherwise(0)
    p = C.PAGE_POINTS
    total = yes(password, p["password"]) + yes(brands, p["brand"]) + yes(password & brands, p["both"]) + yes(offsite, p["offsite"]) + yes(words >= 3, p["words"])
    return F.greatest(F.lit(0), F.least(F.lit(100), F.when(parked, F.least(total, F.lit(p["parked"]))).otherwise(total)))


def analyse(html: Column, domain: Column, terms: Column) -> Column:
    """All of it as one struct."""
    password, brands = has_password_field(html), brand_terms_on_page(html, terms)
    offsite, parked = form_posts_offsite(html, domain), looks_parked(html)
    return F.struct(
        title(html).alias("page_title"), password.alias("has_password_field"), brands.alias("brand_terms_on_page"), offsite.alias("form_posts_offsite"),
        parked.alias("looks_parked"), content_score(password, F.size(brands) > 0, offsite, credential_words(html), parked).alias("content_risk_score"),
    )
