"""Spelling variant grouping by full neighbourhood generation.

``vocabulary`` counts the words of all texts; ``variants`` finds, for each word, all words
that are one inserted, deleted or replaced code point away.  Every distinct deletion,
replacement and insertion of a word over the observed alphabet is made, by NumPy on
polynomial hashes that change in constant time with one letter.  A Bloom filter of the
vocabulary, of at most ``MOST_SEGMENTS`` segments, lets nearly only words through; what
passes is spelt out and joined to the vocabulary by equality, in Spark.  An equal string is a
neighbour by construction, so no distance is computed.  A vocabulary too large for the
filter makes it let more through; results stay exact.

Defined results: a null text has no words, a row without doc_id keeps its runs as they are;
repeated rows count again; of forms with equal counts the smallest in code-point order is
taken; an empty table gives no rows; other columns of the input are not used.  A run is one
word whatever its length; positions are worked on in pieces, so a long one needs no more memory.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from namelens.llm.common import checkpoint, mix64, steps, text_of

#: Runs of A-Z, a-z and U+00C0 to U+00FF in lower-cased UTF-8 (all other lead bytes end a run).
RUN = re.compile(rb"(?:[a-z]|\xc3[\x80-\xbf])+")
#: One run in so many loses a letter, and the words that count.
DAMAGE, LEAST_LENGTH, LEAST_COUNT = 97, 5, 3
#: A form is so many times as frequent as its variant, at least.
RATIO = 2
#: Words that a task counts before it passes them on.
HELD_WORDS = 500_000
#: The filter: bytes of a segment, segments at most (32 MB in all), bits a word below that, bits set for a word.
SEGMENT, MOST_SEGMENTS, BITS, PROBES = 65_536, 512, 16, 4
#: Candidates that one NumPy step works on, and words a partition.
CELLS, WORDS_EACH = 1_000_000, 4_000

_P = np.uint64(0x9E3779B97F4A7C15)
_P_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def _damaged(word: bytes, h: int) -> bytes:
    """The word without the code point at h modulo its length."""
    text = word.decode()
    at = h % len(text)
    return (text[:at] + text[at + 1 :]).encode()


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([w.decode() for w in held], pa.string()), pa.array(held.values(), pa.int64())], ["word", "n"])

    held: Counter[bytes] = Counter()
    for batch in batches:
        for part in steps(batch):
            for doc_id, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist(), strict=True):
                start = None if doc_id is None else zlib.crc32(f"{doc_id}:".encode())
                for word, n in Counter(RUN.findall(text.encode().lower())).items():
                    if start is not None and (h := zlib.crc32(word, start)) % DAMAGE == 0:
                        word = _damaged(word, h)  # noqa: PLW2901
                    if len(word) - word.count(0xC3) >= LEAST_LENGTH:
                        held[word] += n
            if len(held) >= HELD_WORDS:
                yield out()
                held.clear()
    if held:
        yield out()


def vocabulary(docs: DataFrame) -> DataFrame:
    """word, n of the words with at least LEAST_LENGTH code points that occur LEAST_COUNT times or more."""
    counted = docs.select(F.col("doc_id").cast("string").alias("doc_id"), text_of().alias("text")).mapInArrow(_counts, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_COUNT)


def _letter_values(alphabet: str) -> dict[str, np.uint64]:
    """A fixed odd number for each letter, the same in every task."""
    with np.errstate(over="ignore"):
        values = mix64(np.array([ord(c) for c in alphabet], np.uint64) * _P + np.uint64(1)) | np.uint64(1)
    return dict(zip(alphabet, values, strict=True))


def _powers(n: int) -> np.ndarray:
    power = np.full(n, _P)
    power[:1] = 1
    with np.errstate(over="ignore"):
        return np.cumprod(power)


def _matrix(words: list[str]) -> np.ndarray:
    """Code points of words of one length."""
    return np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).reshape(len(words), -1)


def _by_length(words: list[str]) -> Iterator[list[str]]:
    groups = defaultdict(list)
    for w in words:
        groups[len(w)].append(w)
    yield from groups.values()


class Neighbourhood:
    """Hashes of words and of their neighbours over an alphabet."""

    def __init__(self, alphabet: str) -> None:
        self.alphabet, of = alphabet, _letter_values(alphabet)
        self.letters = np.array([ord(c) for c in alphabet], np.uint32)
        self.values = np.array([of[c] for c in alphabet], np.uint64)
        self.table = np.zeros(0x110000 if not alphabet else max(map(ord, alphabet)) + 1, np.uint64)
        self.table[self.letters] = self.values

    def hashes(self, words: list[str]) -> np.ndarray:
        """Hashes of words of one length."""
        with np.errstate(over="ignore"):
            codes = _matrix(words)
            return (self.table[codes] * _powers(codes.shape[1])).sum(axis=1, dtype=np.uint64)

    def neighbours(self, words: list[str]) -> Iterator[tuple[str, int, np.ndarray, np.ndarray]]:
        """(kind, first position, hashes, which of them count) of words of one length, by pieces of positions.

        Hashes have an axis of words, of positions and, but for deletions, of letters.  A
        deletion counts at the first letter of a run, an insertion unless it repeats the letter
        before it, a replacement unless it keeps the letter: so each string is made once.
        """
        codes = _matrix(words)
        m, length = codes.shape
        with np.errstate(over="ignore"):
            powers = _powers(length + 1)
            terms = self.table[codes] * powers[:length]
            before = np.zeros((m, length + 1), np.uint64)
            np.cumsum(terms, axis=1, out=before[:, 1:])
            total = before[:, -1:]
            fresh = np.ones((m, length), bool)
            fresh[:, 1:] = codes[:, 1:] != codes[:, :-1]
            yield "delete", 0, before[:, :-1] + _P_INVERSE * (total - before[:, 1:]), fresh
            step = max(1, CELLS // (m * len(self.letters)))
            for at in range(0, length + 1, step):
                spot = slice(at, min(at + step, length + 1))
                added = powers[spot, None] * self.values
                shifted = before[:, spot] + _P * (total - before[:, spot])
                repeats = np.zeros((m, shifted.shape[1], len(self.letters)), bool)
                first = int(at == 0)
                repeats[:, first:] = codes[:, max(at - 1, 0) : spot.stop - 1, None] == self.letters
                yield "insert", at, shifted[:, :, None] + added, ~repeats
                here = slice(at, min(at + step, length))
                if here.start < here.stop:
                    rest = total - terms[:, here]
                    yield "replace", at, rest[:, :, None] + added[: here.stop - at], codes[:, here, None] != self.letters


def _places(h: np.ndarray, segments: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """(segment, bits within it) of hashes: the multiply-mixed hash gives both."""
    with np.errstate(over="ignore"):
        h = mix64(h)
    bits = np.uint64(SEGMENT * 8 - 1)
    return ((h >> np.uint64(32)) * np.uint64(segments)) >> np.uint64(32), [(h >> np.uint64(11 * i)) * np.uint64(0x2545F491) >> np.uint64(7) & bits for i in range(PROBES)]


def _segment_maker(alphabet: str, segments: int):
    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        space = Neighbourhood(alphabet)
        for batch in batches:
            for words in _by_length(batch.column(0).to_pylist()):
                h = space.hashes(words)
                yield pa.RecordBatch.from_arrays([pa.array(_places(h, segments)[0].astype(np.int32)), pa.array(h.view(np.int64))], ["segment", "h"])

    def fill(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(SEGMENT * 8, bool)
        for batch in batches:
            for spot in _places(np.asarray(batch.column("h")).view(np.uint64), segments)[1]:
                held[spot] = True
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([np.packbits(held, bitorder="little").tobytes()], pa.binary())], ["segment", "bits"])

    return places, fill


def _spelt(words: list[str], kind: str, at: int, where: np.ndarray, alphabet: str) -> Iterator[tuple[str, str]]:
    for row, place, *letter in zip(*where, strict=True):
        word, i = words[row], at + int(place)
        yield word, word[:i] + (alphabet[letter[0]] if letter else "") + word[i + (kind != "insert") :]


def _candidate_maker(alphabet: str, segments: int, shared):
    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        space, bloom = Neighbourhood(alphabet), np.frombuffer(shared.value, np.uint8)
        for batch in batches:
            for words in _by_length(batch.column(0).to_pylist()):
                few = max(1, CELLS // ((len(words[0]) + 1) * len(alphabet)))
                for i in range(0, len(words), few):
                    part, out = words[i : i + few], []
                    for kind, at, h, good in space.neighbours(part):
                        where = np.nonzero(good)
                        segment, spots = _places(h[where], segments)
                        base, alive = segment * np.uint64(SEGMENT), np.arange(len(segment))
                        for spot in spots:
                            alive = alive[bloom[base[alive] + (spot[alive] >> np.uint64(3))] >> (spot[alive] & np.uint64(7)).astype(np.uint8) & 1 == 1]
                        out += _spelt(part, kind, at, tuple(w[alive] for w in where), alphabet)
                    if out:
                        a, b = zip(*out, strict=True)
                        yield pa.RecordBatch.from_arrays([pa.array(a, pa.string()), pa.array(b, pa.string())], ["word", "near"])

    return candidates


def near_words(words: DataFrame) -> DataFrame:
    """word, near, near_n: every pair of words (word, n; written, each once) that are one edit apart, in both directions."""
    session = words.sparkSession
    # at most the 26 and 64 letters of the class
    alphabet = "".join(sorted(r[0] for r in words.select(F.explode(F.split("word", ""))).where("col <> ''").distinct().collect()))
    count = words.count()
    segments = max(1, min(MOST_SEGMENTS, -(-count * BITS // (SEGMENT * 8))))
    places, fill = _segment_maker(alphabet, segments)
    filled = words.select("word").mapInArrow(places, "segment int, h long").groupBy("segment").applyInArrow(fill, "segment int, bits binary").collect()
    held = {r["segment"]: bytes(r["bits"]) for r in filled}
    shared = session.sparkContext.broadcast(b"".join(held.get(s, bytes(SEGMENT)) for s in range(segments)))
    spread = words.select("word").repartition(max(1, count // WORDS_EACH), "word")
    candidates = spread.mapInArrow(_candidate_maker(alphabet, segments, shared), "word string, near string")
    return candidates.join(words.select(F.col("word").alias("near"), F.col("n").alias("near_n")), "near").select("word", "near", "near_n")


def _roots(forms: DataFrame) -> DataFrame:
    """word, root for the words with a form: pointers are doubled, since counts at least double along a chain it has few steps."""
    at = checkpoint(forms.where("form IS NOT NULL").select("word", F.col("form").alias("root")))
    while True:
        up = at.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = checkpoint(at.join(up, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        at = moved.drop("moved")
        if moved.where("moved").isEmpty():
            return at


def variants(words: DataFrame) -> DataFrame:
    """word, form, root, n, n_near, form_n of a vocabulary (word, n; a row a word): see the module.

    A word has at most a few hundred neighbours for each ten letters, and they are counted
    where they are joined before anything is shuffled.
    """
    words = checkpoint(words.select("word", "n"))
    best = near_words(words).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("minus"), F.col("near").alias("form"))).alias("b"))
    rows = words.join(best, "word", "left").withColumn("form_n", -F.col("b.minus"))
    good = F.col("form_n") >= RATIO * F.col("n")
    forms = checkpoint(rows.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(good, F.col("b.form")).alias("form"), F.when(good, F.col("form_n")).alias("form_n")))
    return forms.join(_roots(forms), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
