"""HTML extraction: consensus host paths.

Every page is read into blocks of text, each under a generalised path of tags and
classes (digits become 0).  A page's containers get a score: the words in blocks
of prose below them, less the words in links.  The best container's path is the
page's vote, with its score as weight; Spark adds the votes of a host, and the
host's path with the most weight wins.  Each page is then read again, and its text
is taken below the host's path, or below its own best container if it has no
element of that path.

Defined results: null and empty html give an empty text; a null or malformed url
belongs to the host ''; pages of a host without any scored container have an empty
vote and fall back to the whole body; repeated rows give repeated rows.
"""

from __future__ import annotations

import html as entities
import re
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from namelens.llm.common import checkpoint

#: Hosts up to which the table of winning paths is broadcast (about 100 bytes a host).
BROADCAST_HOSTS = 200_000
#: Copies of the winners' table that a hot host's pages are dealt over, beyond that bound.
SALT = 32

_NAME = re.compile(r"[a-zA-Z][^\s/><]*+")
#: The rest of a tag, its quoted values whole; nothing in it is tried twice.
_REST = re.compile(r"""(?:[^>"']++|"[^"]*+"|'[^']*+')*+>""")
_RAW_END = {tag: re.compile(rf"</{tag}\s*+>", re.I) for tag in ("script", "style")}
#: Tags with an unbalanced quote that a page may have before quotes count no more, so that scanning stays linear.
UNBALANCED = 16
_CLASS = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_DIGITS = re.compile(r"\d+")
_SPACE = re.compile(r"\s+")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Tags that start a block of their own.
BLOCK = frozenset("address article aside blockquote body br caption dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html label legend li main nav ol p pre section summary table tbody td tfoot th thead title tr ul".split())
#: Tags whose content is never main text.
SKIP = frozenset("head title nav footer aside form button iframe object audio video canvas menu dialog header noscript template svg textarea select".split())
#: An element with a class, id or role that is, starts or ends with one of these words isn't main text, an article or main excepted;
#: one that only starts or ends with a word of _DOUBTFUL ('share-price') isn't unless it holds prose.
_WORDS = r"(?:ad|ads|advert\w*|sponsor\w*|promo\w*|banner|menu|nav|navbar|navigation|breadcrumb\w*|sidebar|side|footer|header|masthead|cookie\w*|consent|notice|newsletter|subscribe|signup|login|share|social|related|recommend\w*|comment\w*|disqus|replies|reply|respond|responses|reactions|popup|modal|widget|pagination|pager|copyright|legal|search|complementary)"
_BOILERPLATE = re.compile(rf"(?:^|\s){_WORDS}(?=$|[\s_-])(?!\S*[_-](?:open|closed|legal)(?:$|\s))|(?:^|\s)(?!(?:has|no|not|with|without)[_-])\S+[_-](?!legal\b){_WORDS}(?:$|\s)", re.I)
_DOUBTFUL = r"(?:ads?|promo\w*|banner|side|header|notice|login|share|social|reply|respond|responses|reactions|legal|search)"
_DOUBT = re.compile(rf"^(?:{_DOUBTFUL}[_-]\S+|\S+[_-]{_DOUBTFUL})$", re.I)
#: Words of prose, in blocks of more than PROSE words, and the most words in links, of a hundred, with which a doubtful element is kept.
KEPT_PROSE, KEPT_LINKS = 30, 25
#: Words beyond which a block is prose.
PROSE = 8
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Tags that can be a container.
CONTAINER = frozenset("article main section div td body".split())
#: A new one ends an open one of the same tag.
_CLOSED_BY_SELF = frozenset("p li dt dd tr td th option".split())
#: Tags that a path keeps, the innermost ones.
DEPTH = 12


def scan(html: str) -> Iterator[tuple[int, int, str | None, bool, str]]:
    """(start, end, tag, whether it closes, attributes) of the markup of a page in order; the tag is null for comments, scripts, styles and declarations.

    The page is walked once: a tag's end is looked for from its start, and where no further ``>`` follows all is text.
    """
    at, unbalanced, last = 0, 0, html.rfind(">")
    while 0 <= (start := html.find("<", at)):
        if html.startswith("<!--", start):
            end = html.find("-->", start + 4)
            at = len(html) if end < 0 else end + 3
            yield start, at, None, False, ""
            continue
        if start > last:
            break
        closes = html.startswith("/", start + 1)
        name = _NAME.match(html, start + 1 + closes)
        if not name:
            at = start + 1
            if html[at : at + 1] in ("!", "?"):
                at = html.find(">", at) + 1
                yield start, at, None, False, ""
            continue
        tag = name[0].lower()
        rest = _REST.match(html, name.end()) if unbalanced < UNBALANCED else None
        if rest:
            at = rest.end()
        else:
            unbalanced += 1
            at = html.find(">", name.end()) + 1
        if tag in _RAW_END and not closes:
            end = _RAW_END[tag].search(html, at)
            at = end.end() if end else len(html)
            yield start, at, None, False, ""
        else:
            yield start, at, tag, closes, html[name.end() : at - 1]


class Page:
    """Blocks of a page in order: (path of element numbers, text, words in links)."""

    def __init__(self, html: str, by_class: bool = True) -> None:
        self.by_class = by_class
        self.paths: list[str] = [""]
        self.tags: list[str] = [""]
        self.skipped: list[bool] = [False]
        self.parent: list[int] = [0]
        self.doubt: list[int] = [0]  # the innermost doubtful element around each
        self.blocks: list[tuple[int, str, int]] = []
        stack, text, linked, in_link, at = [0], [], 0, 0, 0
        open_: dict[str, int] = defaultdict(int)  # elements of a tag on the stack

        def flush(owner: int) -> None:
            nonlocal linked
            if text:
                words = _SPACE.sub(" ", entities.unescape("".join(text))).strip()
                if words:
                    self.blocks.append((owner, words, linked))
                text.clear()
            linked = 0

        def put(raw: str) -> None:
            nonlocal linked
            if raw and not self.skipped[stack[-1]]:
                text.append(raw)
                if in_link:
                    linked += len(raw.split())

        for start, end, tag, closes, attributes in scan(html):
            put(html[at:start])
            at = end
            if tag is None:
                continue
            if closes:
                if tag == "a":
                    in_link = max(0, in_link - 1)
                elif tag in BLOCK or tag in SKIP:
                    flush(stack[-1])
                    if open_[tag]:
                        in_link = 0
                        closed = ""
                        while closed != tag:
                            closed = self.tags[stack.pop()]
                            open_[closed] -= 1
                continue
            if tag == "a":
                in_link += 1
            elif tag in BLOCK or tag in SKIP:
                owner = stack[-1]
                flush(owner)
                if tag in _CLOSED_BY_SELF and self.tags[owner] == tag:
                    stack.pop()
                    open_[tag] -= 1
                if tag in VOID or (tag == "svg" and attributes.endswith("/")):
                    continue
                self._open(tag, attributes, stack, open_["article"] + open_["main"] > 0)
                open_[tag] += 1
        put(html[at:])
        flush(stack[-1])
        if any(self.doubt):
            self._settle()

    def _open(self, tag: str, attributes: str, stack: list[int], in_article: bool) -> None:
        up = stack[-1]
        named = " ".join(x for found in _CLASS.findall(attributes) for x in found if x) if "=" in attributes else ""
        # a heading of the article may sit in its own header element
        skip = tag in SKIP and not (tag == "header" and in_article)
        self.tags.append(tag)
        above = self.paths[up] if self.paths[up].count("/") < DEPTH else self.paths[up][self.paths[up].index("/", 1) :]
        self.paths.append(f"{above}/{tag}" + ("." + _DIGITS.sub("0", ".".join(named.lower().split())) if named else ""))
        found = self.by_class and named and tag not in ("body", "article", "main") and _BOILERPLATE.search(named)
        # each word that speaks against the element may be doubtful
        against = [x for x in named.split() if _BOILERPLATE.search(x)] if found else []
        doubtful = bool(against) and all(_DOUBT.match(x) for x in against)
        self.skipped.append(self.skipped[up] or skip or bool(found and not doubtful))
        self.doubt.append(len(self.parent) if doubtful else self.doubt[up])
        self.parent.append(up)
        stack.append(len(self.tags) - 1)

    def _settle(self) -> None:
        """Leave out the blocks of doubtful elements that are poor in prose or rich in links."""
        sums: dict[int, list[int]] = {e: [0, 0, 0] for e in set(self.doubt) if e}  # words, those of prose, those in links
        outer = {e: self.doubt[self.parent[e]] for e in sums}
        for owner, words, linked in self.blocks:
            if e := self.doubt[owner]:
                n = words.count(" ") + 1
                sums[e] = [a + b for a, b in zip(sums[e], (n, n * (n > PROSE), linked), strict=True)]
        for e in sorted(sums, reverse=True):  # inner ones come after outer ones
            if outer[e]:
                sums[outer[e]] = [a + b for a, b in zip(sums[outer[e]], sums[e], strict=True)]
        gone: dict[int, bool] = {0: False}
        for e in sorted(sums):
            words, prose, linked = sums[e]
            gone[e] = gone[outer[e]] or prose < KEPT_PROSE or 2 * prose < words or 100 * linked > KEPT_LINKS * words
        self.blocks = [b for b in self.blocks if not gone[self.doubt[b[0]]]]

    def best(self) -> tuple[str, float]:
        """(path, score) of the container with the most prose; deeper ones win where they hold nearly all of it."""
        score: dict[int, float] = defaultdict(float)
        for owner, words, linked in self.blocks:
            n = words.count(" ") + 1
            weight = n - 3.0 * linked + (2.0 if n > PROSE else 0.0) + 0.5 * words.count(",")
            e, share = owner, 1.0
            while e and share > 1e-3:
                if self.tags[e] in CONTAINER:
                    score[e] += weight * share * (1.5 if self.tags[e] in ("article", "main") else 1.0)
                    share *= 0.8
                e = self.parent[e]
        if not score:
            return "", 0.0
        top = max(score, key=lambda e: (score[e], e))
        return self.paths[self._climb(top)], max(0.0, score[top])

    def _climb(self, e: int) -> int:
        """The outermost container above e to which most words of each step's further blocks are prose, headings or own paragraphs."""
        above: list[int] = []
        while e and (not above or above[-1]):
            above.append(self.parent[above[-1] if above else e])
        # of every element the nearest one among those above e, and what each of these has outside the one below it
        step = {at: i for i, at in enumerate(above)}
        nearest = [0] * len(self.tags)
        sums = [[0, 0, 0] for _ in above]
        for x in range(len(self.tags)):
            nearest[x] = -1 if x == e else step.get(x, nearest[self.parent[x]])
        for owner, text, linked in self.blocks:
            if nearest[owner] >= 0:
                n, at = text.count(" ") + 1, above[nearest[owner]]
                good = n > PROSE or self.tags[owner] in _HEADINGS or (self.tags[owner] == "p" and self.parent[owner] == at)
                sums[nearest[owner]] = [a + b for a, b in zip(sums[nearest[owner]], (n, n * good, linked), strict=True)]
        words = good = links = 0
        for at, found in zip(above[:-1], sums, strict=False):
            words, good, links = words + found[0], good + found[1], links + found[2]
            if self.tags[at] not in CONTAINER:
                continue
            if words and (2 * good < words or 5 * links > words):
                break
            if words:
                e = at
                words = good = links = 0
        return e

    def prose(self) -> bool:
        return any(words.count(" ") >= PROSE for _, words, _ in self.blocks)

    def text(self, path: str) -> str:
        """All blocks below the elements of the path, in page order; of the best container if there is none."""
        if path not in self.paths:
            path = self.best()[0]
        inside = [False] * len(self.tags)
        for e in range(1, len(self.tags)):
            inside[e] = inside[self.parent[e]] or self.paths[e] == path
        return " ".join(words for owner, words, _ in self.blocks if inside[owner] or not path)


def read(html: str) -> Page:
    """The page; without the rule on classes if that leaves no prose and there is some."""
    page = Page(html)
    if not page.prose() and (whole := Page(html, by_class=False)).prose():
        return whole
    return page


def _votes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        votes: dict[tuple[str, str], float] = defaultdict(float)
        for host, html in zip(batch.column("host").to_pylist(), batch.column("html"), strict=True):
            path, score = read(html.as_py()).best()
            if score > 0:
                votes[host, path] += score
        yield pa.RecordBatch.from_pydict({"host": pa.array([k[0] for k in votes], pa.string()), "path": pa.array([k[1] for k in votes], pa.string()), "score": pa.array(list(votes.values()), pa.float64())})


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [read(html.as_py()).text(path.as_py() or "") for html, path in zip(batch.column("html"), batch.column("path"), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(found, pa.string())], names=["page_id", "url", "text"])


def _host():
    return F.coalesce(F.lower(F.regexp_extract(F.col("url").cast("string"), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


def host_paths(pages: DataFrame) -> DataFrame:
    """host, path: the path with the most weight among the host's pages (the first in order if there are two)."""
    rows = pages.select(_host().alias("host"), F.coalesce("html", F.lit("")).alias("html"))
    votes = rows.mapInArrow(_votes, "host string, path string, score double").groupBy("host", "path").agg(F.round(F.sum("score"), 3).alias("score"))
    return checkpoint(votes.groupBy("host").agg(F.min(F.struct((-F.col("score")).alias("s"), "path")).alias("w")).select("host", "w.path"))


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for every row of pages."""
    winners = host_paths(pages)
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"), _host().alias("host"))
    if winners.count() <= BROADCAST_HOSTS:
        joined = rows.join(F.broadcast(winners), "host", "left")
    else:
        salted = winners.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
        joined = rows.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALT)).cast("int")).join(salted, ["host", "salt"], "left")
    kinds = {f.name: f.dataType.simpleString() for f in pages.schema.fields}
    texts = joined.select("page_id", "url", "html", "path").mapInArrow(_texts, f"page_id {kinds['page_id']}, url {kinds['url']}, text string")
    return texts.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
