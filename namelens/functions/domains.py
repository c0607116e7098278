"""Domain-name functions as Columns: normal form, registrable domain, tokens, keywords.

All are built-in expressions and stay in the JVM.  A null name gives null
everywhere, and an empty array where an array is returned.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from namelens import constants as C


def lits(values) -> Column:
    return F.array(*[F.lit(v) for v in values])


def let(value: Column, body) -> Column:
    """body(value), with the value computed once and named; keeps expressions small that use a value often."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def normalize(name: Column) -> Column:
    """Trimmed, lower case, without one leading wildcard label and one trailing dot."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(name)), r"^\*\.", ""), r"\.$", "")


def _last(labels: Column, n: int) -> Column:
    """The last n labels, or all of them."""
    return F.array_join(F.slice(labels, F.greatest(F.size(labels) - n + 1, F.lit(1)), n), ".")


def _is_suffix(labels: Column, n: int, suffixes=C.MULTI_LABEL_SUFFIXES) -> Column:
    return (F.size(labels) >= n) & _last(labels, n).isin(*suffixes)


def registrable_domain(name: Column) -> Column:
    """The public suffix and one label more; null for addresses, single labels and labels that are too long."""

    def of_labels(labels: Column) -> Column:
        odd = (F.size(labels) < 2) | F.exists(labels, lambda x: F.length(x) > C.MAX_LABEL)
        found = F.when((F.size(labels) >= 4) & _is_suffix(labels, 3), _last(labels, 4)).when((F.size(labels) >= 3) & _is_suffix(labels, 2), _last(labels, 3))
        return F.when(~odd, found.otherwise(_last(labels, 2)))

    def of_host(host: Column) -> Column:
        odd = (host == "") | host.rlike("[ /:]") | host.rlike(r"^[0-9]{1,3}(\.[0-9]{1,3}){3}$")
        return F.when(~odd, let(F.filter(F.split(host, r"\."), lambda x: x != ""), of_labels))

    return let(normalize(name), of_host)


def public_suffix(domain: Column) -> Column:
    def of_labels(labels: Column) -> Column:
        return F.when(_is_suffix(labels, 3), _last(labels, 3)).when(_is_suffix(labels, 2), _last(labels, 2)).otherwise(_last(labels, 1))

    return let(F.split(domain, r"\."), of_labels)


def registrable_label(domain: Column) -> Column:
    """The registrable domain without its suffix; '' if there is none.

    A bare suffix loses its last character, since one is always taken off with it.
    """

    def cut(found: Column) -> Column:
        n = F.length(found) - F.length(public_suffix(found)) - 1
        return F.when(found.isNull(), F.lit("")).otherwise(let(n, lambda k: F.substring(found, F.lit(1), F.when(k >= 0, k).otherwise(F.length(found) + k))))

    return let(registrable_domain(domain), cut)


def is_ignorable(host: Column) -> Column:
    """True for shared platforms and all names below them."""
    return let(normalize(host), lambda h: F.exists(lits(C.IGNORED_SUFFIXES), lambda s: (h == s) | F.endswith(h, F.concat(F.lit("."), s))))


def tokenize(label: Column) -> Column:
    return F.filter(F.split(F.lower(label), "[^a-z0-9]+"), lambda t: t != "")


def flatten(label: Column) -> Column:
    return F.regexp_replace(F.lower(label), "[^a-z0-9]", "")


def is_punycode(domain: Column) -> Column:
    return F.exists(F.split(domain, r"\."), lambda x: F.startswith(x, F.lit("xn--")))


def has_non_ascii(x: Column) -> Column:
    return x.rlike(r"[^\x00-\x7F]")


def keyword_hits(tokens: Column, keywords=C.KEYWORDS) -> Column:
    """Keywords that a token, or its singular, is; distinct and in order of their first token."""
    known = lambda t: t.isin(*keywords)  # noqa: E731  a hash lookup
    without = lambda t, n: F.substring(t, F.lit(1), F.length(t) - n)

    def canonical(t: Column) -> Column:
        plural = F.when(known(without(t, 1)), without(t, 1)).when(F.endswith(t, F.lit("es")) & known(without(t, 2)), without(t, 2))
        return F.when(known(t), t).when(F.endswith(t, F.lit("s")), plural)

    return F.array_distinct(F.filter(F.transform(tokens, canonical), lambda k: k.isNotNull()))


def has_keyword(label: Column, keywords=C.KEYWORDS) -> Column:
    """True where ``keyword_hits`` of the label's tokens finds any; one pattern, no list of tokens."""
    return F.lower(label).rlike(rf"(?<![a-z0-9])(?:{'|'.join(map(re.escape, keywords))})(?:e?s)?(?![a-z0-9])")


def seed_label(domain: Column) -> Column:
    """The label before the suffix of a brand's own domain, by the shorter list of suffixes; '' if there is none."""

    def of_labels(labels: Column) -> Column:
        width = F.when(_is_suffix(labels, 3, C.SEED_SUFFIXES), 3).when(_is_suffix(labels, 2, C.SEED_SUFFIXES), 2).otherwise(1)
        return F.coalesce(let(F.size(labels) - width - 1, lambda at: F.when(at >= 0, F.get(labels, at))), F.lit(""))

    return let(F.filter(F.split(F.regexp_replace(F.lower(domain), r"\.$", ""), r"\."), lambda x: x != ""), of_labels)


def longest_first(terms: Column) -> Column:
    """Terms by falling length; equally long ones keep their order."""
    placed = F.transform(terms, lambda t, i: F.struct((-F.length(t)).alias("n"), i.alias("i"), t.alias("t")))
    return F.transform(F.array_sort(placed), lambda x: x["t"])


def match_terms(name: Column, official_domains: Column, aliases: Column) -> Column:
    """The terms that a brand is searched by: its name, the labels of its domains and its aliases, squeezed."""
    squeezed = F.transform(F.concat(F.array(name), F.transform(official_domains, seed_label), aliases), lambda t: F.regexp_replace(F.lower(t), "[^a-z0-9]", ""))
    return longest_first(F.array_distinct(F.filter(squeezed, lambda t: F.length(t) >= C.TERM_LENGTH)))


def final_terms(derived: Column, extra: Column, excluded: Column) -> Column:
    """Derived and extra terms, lower case, without the excluded and the short ones."""
    every = F.transform(F.concat(derived, extra), lambda t: F.lower(t))
    return longest_first(F.filter(F.array_distinct(every), lambda t: (F.length(t) >= C.TERM_LENGTH) & ~F.array_contains(excluded, t)))


def poll_terms(terms: Column, n: int = 2) -> Column:
    """The n longest terms of four characters or more."""
    return F.slice(longest_first(F.filter(terms, lambda t: F.length(t) >= 4)), 1, n)


def is_private_address(ip: Column) -> Column:
    """Loopback, private, link-local and reserved addresses; anything malformed counts as private."""

    def six(v: Column) -> Column:
        return (v == "::1") | v.rlike(r"^(?:fc|fd|fe80|::ffff:(?:127|10|192\.168)\.)")

    def four(parts: Column) -> Column:
        a, b = F.get(parts, F.lit(0)), F.get(parts, F.lit(1))
        known = (
            a.isin(0, 10, 127) | ((a == 169) & (b == 254)) | ((a == 172) & b.between(16, 31)) | ((a == 192) & (b == 168))
            | ((a == 100) & b.between(64, 127)) | (a >= 224)
        )
        return (F.size(parts) != 4) | F.exists(parts, lambda p: p.isNull()) | F.coalesce(known, F.lit(True))

    parts = F.transform(F.split(ip, r"\."), lambda p: F.when(p == "", F.lit(0)).otherwise(p.try_cast("int")))
    return F.when(ip.contains(":"), six(F.lower(ip))).otherwise(F.coalesce(let(parts, four), F.lit(True)))


def first_address(addresses: Column) -> Column:
    """The first IPv4 address, else the first one, else null."""
    return F.coalesce(F.get(F.filter(addresses, lambda x: ~x.contains(":")), F.lit(0)), F.get(addresses, F.lit(0)))


def host_of(url: Column) -> Column:
    """The host of a URL in lower case, without user and port; '' if there is none."""
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
