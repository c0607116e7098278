"""Personal data: a semi-Markov conditional random field over whole-span candidates.

Base spans come from fixed patterns.  Beside them, regions of a text that could hold
a card, phone, address, mailbox or secret give candidate segments: runs of neighbouring
digit groups, mailboxes that spell out their signs, and long tokens of letters and
digits.  Features of a whole segment (digit count, checksum, grouping, separators, kinds
of characters, entropy, signs around it, words before it) score every kind, and a
dynamic program over segments of bounded length chooses boundaries and kinds of a
region together.  Its spans are added where they touch no base span.

The field is fitted by gradient steps on its conditional likelihood: on the base spans of
a bounded sample, on secrets that a word like token names, and on variants of both (other
separators, no plus sign, signs spelled out, other quotes and names, digits that fail the
checksum, letters only).  The sample is about ``TRAIN`` rows by hash, and all their excerpts around
digits, signs and long tokens, equal ones once.  The weights, a few hundred numbers, go to the
workers with the function.

Defined results: a null text counts as empty and has no spans; without any example in the
sample the field adds nothing; repeated rows give repeated rows; a token may have any length.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from namelens.llm.common import text_of

#: The kinds of base spans, and the one that only the field finds.
KINDS = ("email", "ip", "card", "phone")
ALL_KINDS = (*KINDS, "secret")
#: Rows whose excerpts the field is fitted on, about.
TRAIN = 1_500
#: Digit groups and code points that a segment has at most.
GROUPS, LONGEST = 8, 48
#: Characters that a token has at least to be a candidate for a secret.
SHORTEST = 16
#: Log-odds that a segment must have over being no entity.
MARGIN = 2.0

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_REGION = re.compile(r"[+(]?[0-9][0-9\x20().+-]*[0-9]\)?")
_GROUP = re.compile(r"[0-9]+")
_SPELLED = re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,40}\x20?(?:[\[(]at[\])]|\x20at\x20)\x20?[A-Za-z0-9-]{1,40}(?:\x20?(?:\.|[\[(]dot[\])]|\x20dot\x20)\x20?[A-Za-z0-9-]{1,20}){1,3}(?![A-Za-z0-9-])")
_TOKEN = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")
_NAMED = re.compile(r"(?i)(?:token|secret|passw(?:or)?d|api[_-]?key|access[_-]?key|credential|bearer)[\x20\"']*[=:]?[\x20\"']*\Z")
_CUES = ("secret", "key", "password", "passwd", "apikey", "bearer", "hash", "commit", "sha", "call", "phone", "tel", "fax", "mobile", "card", "visa", "pay", "credit", "ip", "host", "server", "mail", "contact", "account", "id", "date", "version", "isbn", "no", "token", "order")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) by the fixed patterns: leftmost, not overlapping within a kind."""
    out, end = [], 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            out.append((0, start, m.end()))
            end = m.end()
        at = text.find("@", max(at + 1, end))
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            out.append((1, m.start(), m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() <= 37 and 16 <= len(d := _digits(m[0])) <= 19 and luhn(d):
            out.append((2, m.start(), m.end()))
    for m in _PHONE.finditer(text):
        if 8 <= len(_digits(m[0])) <= 15:
            out.append((3, m.start(), m.end()))
    return out


def regions(text: str) -> Iterator[list[tuple[int, int]]]:
    """Candidate segments (start, end) of every region that could hold an entity, in order of their ends."""
    for m in _REGION.finditer(text):
        groups = [(g.start() + m.start(), g.end() + m.start()) for g in _GROUP.finditer(m[0])]
        if sum(b - a for a, b in groups) < 7:
            continue
        found = []
        for j in range(len(groups)):
            n = 0
            for i in range(j, max(-1, j - GROUPS), -1):
                n += groups[i][1] - groups[i][0]
                if n > 19 or groups[j][1] - groups[i][0] > LONGEST:
                    break
                if n >= 4:
                    found.append((groups[i][0], groups[j][1]))
                    for sign in ("+", "(", "+("):
                        start = groups[i][0] - len(sign)
                        if start >= m.start() and text[start : groups[i][0]] == sign:
                            found.append((start, groups[j][1]))
        if found:
            yield found
    low = text.lower() if "at" in text or "AT" in text else ""
    if "(at)" in low or "[at]" in low or (" at " in low and (" dot " in low or "(dot)" in low or "[dot]" in low)):
        for m in _SPELLED.finditer(text):
            if "dot" in m[0].lower() or "(at)" in m[0].lower() or "[at]" in m[0].lower():
                yield [(m.start(), m.end())]
    for m in _TOKEN.finditer(text):
        if not m[0].isdigit():
            yield [(m.start(), m.end())]


def _of_token(s: str, text: str, start: int, end: int) -> list[str]:
    """Names of the features of a long token."""
    n, digits, upper = len(s), sum(c.isdigit() for c in s), sum(c.isupper() for c in s)
    entropy = -sum(k / n * math.log2(k / n) for k in map(s.count, set(s)))
    quoted = text[start - 1 : start] in ("'", '"') and text[end : end + 1] == text[start - 1 : start]
    named = _NAMED.search(text[max(0, start - 32) : start]) is not None
    kinds = "hex" if all(c in "0123456789abcdef" for c in s) else "words" if not digits else "mixed" if upper and upper + digits < n else "plain"
    words = re.findall(r"[A-Za-z]+", text[max(0, start - 24) : start].lower())
    return ["token", f"token{kinds}", f"long{min(n // 8, 8)}", f"share{int(5 * digits / n)}", f"bits{int(2 * entropy)}", f"quoted{quoted}", f"named{named}", *(f"cue{w}" for w in words[-2:] if w in _CUES)]


def features(text: str, start: int, end: int) -> list[str]:
    """Names of the features of a whole segment."""
    s = text[start:end]
    if len(s) >= SHORTEST and _TOKEN.fullmatch(s) and not s.replace("-", "").isdigit():
        return _of_token(s, text, start, end)
    d = _digits(s)
    groups = _GROUP.findall(s)
    seps = "".join(sorted({c for c in s if not c.isalnum()}))
    out = ["bias", f"digits{len(d)}", f"groups{min(len(groups), 6)}", f"shape{'-'.join(str(min(len(g), 9)) for g in groups[:6])}", f"seps{seps}"]
    if 12 <= len(d) <= 19:
        out.append(f"luhn{luhn(d)}")
    if len(groups) == 4 and s.count(".") == 3 and len(s) == len(d) + 3:
        out.append(f"quad{all(len(g) <= 3 and int(g) <= 255 for g in groups)}")
    if s[0] in "+(":
        out.append(f"sign{s[0]}")
    if any(c.isalpha() for c in s):
        out.append("spelled" + "+".join(x for x in ("(at)", "[at]", " at ", "dot") if x in s.lower()))
    before, after = text[start - 1 : start], text[end : end + 1]
    out.append("left" + ("w" if before.isalnum() else "^" if not before else before if before in " \n+(.-" else "o"))
    out.append("right" + ("w" if after.isalnum() else "$" if not after else after if after in " \n).,-" else "o"))
    words = re.findall(r"[A-Za-z]+", text[max(0, start - 24) : start].lower())
    out += [f"cue{w}" for w in words[-2:] if w in _CUES]
    return out


class Field:
    """Weights of (kind, feature); a region's score is the sum over its chosen segments."""

    def __init__(self) -> None:
        self.w: dict[tuple[int, str], float] = defaultdict(float)

    def score(self, kind: int, names: list[str]) -> float:
        w = self.w
        return sum(w.get((kind, n), 0.0) for n in names)

    def _lattice(self, segments: list[tuple[int, int]]) -> tuple[list[int], list[tuple[int, int]]]:
        """Places where segments start or end, and each segment as a pair of places."""
        places = sorted({p for s in segments for p in s})
        number = {p: i for i, p in enumerate(places)}
        return places, [(number[a], number[b]) for a, b in segments]

    def best(self, text: str, segments: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
        """(kind, start, end) of the segments with the highest total; none costs 0 and any must beat MARGIN."""
        places, edges = self._lattice(segments)
        top, back = [0.0] * len(places), [None] * len(places)
        ending = defaultdict(list)
        for s, (i, j) in zip(segments, edges, strict=True):
            ending[j].append((i, s, features(text, *s)))
        for j in range(1, len(places)):
            top[j] = top[j - 1]
            for i, s, names in ending[j]:
                for kind in range(len(ALL_KINDS)):
                    gain = top[i] + self.score(kind, names) - MARGIN
                    if gain > top[j]:
                        top[j], back[j] = gain, (i, kind, s)
        out, j = [], len(places) - 1
        while j > 0:
            if back[j] is None:
                j -= 1
            else:
                i, kind, s = back[j]
                out.append((kind, *s))
                j = i
        return out[::-1]

    def learn(self, examples: list[tuple[str, list[tuple[int, int]], set[tuple[int, int, int]]]], rounds: int = 12, rate: float = 0.5, decay: float = 1e-3, seed: int = 8) -> Field:
        """Steps along the gradient of the conditional likelihood, by forward and backward sums over segments."""
        r = random.Random(seed)
        ready = []
        for text, segments, gold in examples:
            places, edges = self._lattice(segments)
            ready.append((len(places), [(i, j, features(text, *s), {k for k in range(len(ALL_KINDS)) if (k, *s) in gold}) for s, (i, j) in zip(segments, edges, strict=True)]))
        for step in range(rounds):
            r.shuffle(ready)
            now = rate / (1 + step)
            for n, segments in ready:
                ending, starting = defaultdict(list), defaultdict(list)
                for i, j, names, gold in segments:
                    for kind in range(len(ALL_KINDS)):
                        item = (i, j, kind, names, kind in gold, self.score(kind, names))
                        ending[j].append(item)
                        starting[i].append(item)
                ahead, behind = [0.0] * n, [0.0] * n
                for j in range(1, n):
                    ahead[j] = _log_sum([ahead[j - 1], *(ahead[x[0]] + x[5] for x in ending[j])])
                for i in range(n - 2, -1, -1):
                    behind[i] = _log_sum([behind[i + 1], *(behind[x[1]] + x[5] for x in starting[i])])
                for items in ending.values():
                    for i, j, kind, names, gold, score in items:
                        push = now * (gold - math.exp(min(0.0, ahead[i] + score + behind[j] - ahead[-1])))
                        if abs(push) > 1e-6:
                            for name in names:
                                self.w[kind, name] += push / len(names) - now * decay * self.w[kind, name]
        return self


def _log_sum(values: list[float]) -> float:
    top = max(values)
    return top + math.log(sum(math.exp(v - top) for v in values))


def _variant(kind: int, s: str, r: random.Random) -> tuple[int | None, str]:
    """Another way to write a span, and its kind (None: it is none any more)."""
    d = _digits(s)
    if kind == 0:
        name, _, host = s.partition("@")
        at, dot = r.choice([(" at ", " dot "), ("(at)", "."), (" [at] ", " [dot] "), (" (at) ", " (dot) ")])
        return 0, name + at + host.replace(".", dot)
    if kind == 1:
        return (None, ".".join(str(r.randrange(256, 999)) for _ in range(4))) if r.random() < 0.5 else (None, s.rpartition(".")[0] + "." + str(r.randrange(1000, 9999)))
    if kind == 2:
        if r.random() < 0.4:
            return None, d[:-1] + str((int(d[-1]) + r.randrange(1, 10)) % 10)
        return 2, r.choice(["-", " ", "."]).join(d[i : i + 4] for i in range(0, len(d), 4)) if r.random() < 0.7 else f"{d} {d}"
    if r.random() < 0.35:
        return None, "".join(r.choice("0123456789") for _ in range(len(d)))
    if len(d) > 9:
        return 3, r.choice([f"({d[-10:-7]}) {d[-7:-4]}-{d[-4:]}", f"{d[-10:-7]}-{d[-7:-4]}-{d[-4:]}", f"+{d[:-10]} {d[-10:-7]} {d[-7:-4]} {d[-4:]}", f"({d[-10:-7]}) {d[-7:-4]} {d[-4:]}"])
    return 3, s


Example = tuple[str, list[tuple[int, int]], set[tuple[int, int, int]]]


def _example(left: str, s: str, right: str, kind: int | None) -> Iterator[Example]:
    """The regions of left + s + right that meet s, which is a span of the kind, or none."""
    around, a, b = left + s + right, len(left), len(left) + len(s)
    gold = {(kind, a, b)} if kind is not None else set()
    if kind == 2 and s.count(" ") == 1 and len(_digits(s)) >= 32:  # two cards side by side
        half = a + len(s) // 2
        gold = {(2, a, half), (2, half + 1, b)}
    for segments in regions(around):
        if any(y > a and x < b for x, y in segments):
            yield around, segments, gold


def _secret_examples(left: str, s: str, right: str, r: random.Random) -> Iterator[Example]:
    """A named secret as it is, with other characters and another name, and tokens that are none."""
    yield from _example(left, s, right, 4)
    letters = r.choice(["0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"])
    other = "".join(r.choice(letters) for _ in range(r.choice([20, 24, 32, 40, 64])))
    name, quote = r.choice(["password", "secret", "api_key", "token", "access_key"]), r.choice(['"', "'", ""])
    yield from _example(f"{left[:12]} {name}{r.choice([' = ', ': ', '='])}{quote}", other, f"{quote} {right[-8:]}", 4)
    word = "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randrange(16, 40)))
    yield from _example(left[:12] + " ", r.choice([word, f"{word[:9]}-{word[9:]}", f"{word[:8]}/{word[8:]}/{r.randrange(99)}", "-" * len(word), "_" * len(word)]), f" {right[-8:]}", None)
    yield from _example(f"{left[:12]} {r.choice(['commit', 'hash', 'sha', 'id'])} ", "".join(r.choice("0123456789abcdef") for _ in range(40)), f" {right[-8:]}", None)


def examples_of(text: str, r: random.Random) -> Iterator[Example]:
    """Training regions of an excerpt: as it is, and with its spans written in another way."""
    base = base_spans(text)
    known = list(base)
    for kind, start, end in base:
        left, right = text[max(0, start - 30) : start], text[end : end + 20]
        yield from _example(left, text[start:end], right, kind)
        for _ in range(2):
            other, s = _variant(kind, text[start:end], r)
            yield from _example(left, s, right, other)
    for m in _TOKEN.finditer(text):
        if any(c.isdigit() for c in m[0]) and not m[0].isdigit() and _NAMED.search(text[max(0, m.start() - 32) : m.start()]):
            known.append((4, m.start(), m.end()))
            yield from _secret_examples(text[max(0, m.start() - 30) : m.start()], m[0], text[m.end() : m.end() + 20], r)
    for segments in regions(text):
        if not any(a < e and s < b for a, b in segments for _, s, e in known):
            at = max(0, segments[0][0] - 30)
            yield text[at : segments[-1][1] + 20], [(a - at, b - at) for a, b in segments], set()


def fit(docs: DataFrame, rows: int = TRAIN) -> Field:
    """Fit on all excerpts around digits, signs and long tokens of about ``rows`` rows, chosen by hash."""
    share = min(1.0, rows / max(1, docs.count()))
    some = docs.select(text_of().alias("text")).where(F.pmod(F.xxhash64(F.lit("pii"), "text"), F.lit(1_000_000)) < int(share * 1_000_000))
    # pieces of 160 characters and the rest of the last word, of which those with a digit, sign or token count
    pieces = F.regexp_extract_all("text", F.lit(r"(?s)(.{1,160}\S{0,60})"), 1)
    excerpts = F.filter(pieces, lambda p: p.rlike(r"@|[0-9]{4}|[0-9]\.[0-9]|[A-Za-z0-9+/_-]{20}"))
    parts = some.select(F.explode(excerpts).alias("part")).distinct().collect()
    r = random.Random(1)
    return Field().learn([x for part in sorted(row["part"] for row in parts) for x in examples_of(part, r)])


def find(text: str, field: Field) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """(base spans, all spans), each by kind and start."""
    base = sorted(base_spans(text))
    # the places that base spans take, as intervals that don't overlap, in order
    starts: list[int] = []
    ends: list[int] = []
    for start, end in sorted((s, e) for _, s, e in base):
        if ends and start <= ends[-1]:
            ends[-1] = max(ends[-1], end)
        else:
            starts.append(start)
            ends.append(end)

    def free(a: int, b: int) -> bool:
        i = bisect_left(starts, b) - 1
        return i < 0 or ends[i] <= a

    more = []
    for segments in regions(text):
        left = [x for x in segments if free(*x)] if base else segments
        if left:
            more += field.best(text, left)
    # a token and a run of digits in it are regions of their own: the earlier and longer one stays
    out, last = [], 0
    for kind, start, end in sorted(more, key=lambda x: (x[1], -x[2])):
        if start >= last:
            out.append((kind, start, end))
            last = end
    return base, sorted({*base, *out})


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{ALL_KINDS[k]}:{a}:{b}" for k, a, b in spans)


def scans(docs: DataFrame, field: Field | None = None) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone (base spans), base_sha256, spans (all), n_secret, n_spans (all) for every row of docs."""
    field = field or fit(docs)
    names = [*(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_secret", "n_spans"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for t in batch.column("text"):
                base, every = find(t.as_py(), field)
                kinds = [x[0] for x in base]
                rows.append((*(kinds.count(k) for k in range(len(KINDS))), hashlib.sha256(joined(base).encode()).hexdigest(), joined(every), sum(x[0] == len(KINDS) for x in every), len(every)))
            columns = zip(*rows, strict=True) if rows else [[] for _ in names]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, pa.int64() if n.startswith("n_") else pa.string()) for n, c in zip(names, columns, strict=True))], names=["doc_id", *names])

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", text_of().alias("text")).mapInArrow(run, f"doc_id {kind}, " + ", ".join(f"{n} {'long' if n.startswith('n_') else 'string'}" for n in names))
