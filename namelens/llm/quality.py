"""Quality classifier: attention-based multiple-instance learning over passages.

A document is a bag of passages of ``PASSAGE`` words.  Each passage is encoded
(shares of byte classes and of their bigrams, word lengths, repeated words),
goes through a hidden layer, and a gated attention learned from the documents'
labels weighs the passages; the weighted representation gives the score.  The
network is fitted with NumPy on a bounded sample of labelled rows (``TRAIN`` rows at
most, the passages of long ones averaged to ``PARTS`` parts), then scores every passage
of every text in Arrow batches.  A long text is encoded in pieces of ``PIECE`` words,
of which only the hidden vectors and weights are kept.

Defined results: null and empty texts are a bag of one empty passage and get a
score as well; without labels of both kinds every score is the share of label 1
(1 without any label).  Labels, lang, source and doc_id are never inputs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from namelens.llm.common import SOLID, STEP_BYTES, cuts, span_hashes, steps, text_buffer, word_spans
from namelens.llm.labelled import held_out, labelled_sample

PASSAGE = 96
#: Labelled rows that the network is fitted on at most.
TRAIN = 4000
#: Parts that a long text has in fitting; each is the mean of its passages, so that all of them are seen.
PARTS = 64
#: Words of a piece of a long text.
PIECE = 512 * PASSAGE
THRESHOLD = 0.3

_CLASSES = 12
_CLASS = np.full(256, 9, np.uint8)
_CLASS[[32]] = 0
_CLASS[[9, 10, 11, 12, 13]] = 1
_CLASS[65:91], _CLASS[97:123], _CLASS[48:58] = 2, 3, 4
for _i, _of in enumerate((b".", b",;:", b"!?", b"|#$%&*@~^<>=+_/\\")):
    _CLASS[list(_of)] = 5 + _i
_CLASS[128:192], _CLASS[192:] = 10, 11
N_FEATURES = _CLASSES + _CLASSES * _CLASSES + 7


def passages(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(features of every passage, number of the first passage of every text and their total)."""
    texts = len(offsets) - 1
    start, end, text = word_spans(data, offsets, SOLID)
    words = np.bincount(text, minlength=texts)
    first_word = np.r_[0, np.cumsum(words)]
    bags = np.maximum(1, -(-words // PASSAGE))
    first = np.r_[0, np.cumsum(bags)]
    n = int(first[-1])
    of = first[:-1][text] + (np.arange(len(start)) - first_word[:-1][text]) // PASSAGE  # passage of a word
    size = np.bincount(of, minlength=n).astype(float)
    kinds = _CLASS[data].astype(np.int64)
    x = np.zeros((n, N_FEATURES))
    if len(start):
        # a passage's bytes: from its first word to the next passage, or to the end of the text
        heads = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])
        at = start[heads]
        until = np.r_[at[1:], len(data)]
        until = np.minimum(until, offsets[1:][text[heads]])
        length = until - at
        place = np.repeat(at - np.r_[0, np.cumsum(length)[:-1]], length) + np.arange(int(length.sum()))
        owner = np.repeat(of[heads], length)
        k = kinds[place]
        x[:, :_CLASSES] = np.bincount(owner * _CLASSES + k, minlength=n * _CLASSES).reshape(n, _CLASSES)
        same = owner[1:] == owner[:-1]
        pair = owner[:-1] * _CLASSES**2 + k[:-1] * _CLASSES + k[1:]
        x[:, _CLASSES : _CLASSES + _CLASSES**2] = np.bincount(pair[same], minlength=n * _CLASSES**2).reshape(n, -1)
        total = np.maximum(1, x[:, :_CLASSES].sum(axis=1, keepdims=True))
        x[:, : _CLASSES + _CLASSES**2] = np.sqrt(x[:, : _CLASSES + _CLASSES**2] / total)
        h, w = span_hashes(data, start, end), (end - start).astype(float)
        again = np.r_[False, (h[1:] == h[:-1]) & (of[1:] == of[:-1])]
        order = np.lexsort((h, of))
        fresh = np.r_[True, (h[order][1:] != h[order][:-1]) | (of[order][1:] != of[order][:-1])]
        per = np.maximum(1, size)
        stats = [
            np.log1p(size), np.bincount(of, w, n) / per, np.sqrt(np.bincount(of, w * w, n) / per), np.bincount(of, again, n) / per,
            np.bincount(of[order], fresh, n) / per, np.bincount(of, w > 20, n) / per, np.bincount(of, w <= 2, n) / per,
        ]
        x[:, _CLASSES + _CLASSES**2 :] = np.stack(stats, 1)
    return x, first


class Network:
    """Gated attention over hidden passage vectors, and its fitting by Adam."""

    def __init__(self, hidden: int = 24, gate: int = 12, seed: int = 5) -> None:
        r = np.random.default_rng(seed)
        d = N_FEATURES
        self.w = {"W": r.normal(0, d**-0.5, (d, hidden)), "b": np.zeros(hidden), "V": r.normal(0, 0.2, (hidden, gate)), "U": r.normal(0, 0.2, (hidden, gate)), "a": r.normal(0, 0.2, gate), "c": np.zeros(hidden), "c0": np.zeros(1)}
        self.mean, self.sd = np.zeros(d), np.ones(d)
        self.constant: float | None = None

    def hidden(self, x: np.ndarray) -> tuple:
        """Hidden vectors of passages, both gates and the attention before it is shared out."""
        w = self.w
        h = np.tanh(x @ w["W"] + w["b"])
        t, s = np.tanh(h @ w["V"]), 1 / (1 + np.exp(-(h @ w["U"])))
        return h, t, s, (t * s) @ w["a"]

    def forward(self, x: np.ndarray, first: np.ndarray) -> tuple:
        w = self.w
        h, t, s, e = self.hidden(x)
        of = np.repeat(np.arange(len(first) - 1), np.diff(first))
        p = np.exp(e - np.maximum.reduceat(e, first[:-1])[of])
        p /= np.add.reduceat(p, first[:-1])[of]
        z = np.add.reduceat(p[:, None] * h, first[:-1])
        return h, t, s, of, p, z, z @ w["c"] + w["c0"]

    def score(self, x: np.ndarray, first: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(first) - 1, self.constant)
        x = np.clip((x - self.mean) / self.sd, -6, 6)
        return 1 / (1 + np.exp(-np.clip(self.forward(x, first)[-1], -30, 30)))

    def score_pieces(self, data: np.ndarray) -> float:
        """The score of one long text, by pieces."""
        if self.constant is not None:
            return self.constant
        start, _, _ = word_spans(data, np.array([0, len(data)]), SOLID)
        edges = [*start[::PIECE].tolist(), len(data)] if len(start) else [0, len(data)]
        found = []
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            x, _ = passages(data[a:b], np.array([0, b - a]))
            found.append(self.hidden(np.clip((x - self.mean) / self.sd, -6, 6)))
        h, e = np.concatenate([f[0] for f in found]), np.concatenate([f[3] for f in found])
        p = np.exp(e - e.max())
        logit = (p / p.sum()) @ h @ self.w["c"] + self.w["c0"][0]
        return float(1 / (1 + np.exp(-np.clip(logit, -30, 30))))

    def gradients(self, x: np.ndarray, first: np.ndarray, y: np.ndarray) -> dict:
        w = self.w
        h, t, s, of, p, z, logit = self.forward(x, first)
        g = (1 / (1 + np.exp(-np.clip(logit, -30, 30))) - y) / len(y)
        dz = g[:, None] * w["c"]
        dp = (dz[of] * h).sum(axis=1)
        de = p * (dp - np.add.reduceat(p * dp, first[:-1])[of])
        dt, ds = de[:, None] * w["a"] * s * (1 - t * t), de[:, None] * w["a"] * t * s * (1 - s)
        dh = p[:, None] * dz[of] + dt @ w["V"].T + ds @ w["U"].T
        du = dh * (1 - h * h)
        return {"W": x.T @ du, "b": du.sum(0), "V": h.T @ dt, "U": h.T @ ds, "a": (t * s).T @ de, "c": z.T @ g, "c0": np.array([g.sum()])}

    def fit(self, bags: list[np.ndarray], y: np.ndarray, epochs: int = 24, batch: int = 64, rate: float = 0.005, decay: float = 1e-4, seed: int = 6) -> Network:
        if len(set(y.tolist())) < 2:
            self.constant = float(y.mean()) if len(y) else 1.0
            return self
        pool = np.concatenate(bags)
        self.mean, self.sd = pool.mean(0), pool.std(0) + 1e-3
        bags = [np.clip((b - self.mean) / self.sd, -6, 6) for b in bags]
        self.w["c0"][:] = np.log(y.mean() / (1 - y.mean()))
        m, v, step, r = {k: 0.0 for k in self.w}, {k: 0.0 for k in self.w}, 0, np.random.default_rng(seed)
        for epoch in range(epochs):
            order = r.permutation(len(bags))
            for at in range(0, len(order), batch):
                ids = order[at : at + batch]
                first = np.r_[0, np.cumsum([len(bags[i]) for i in ids])]
                grads, step = self.gradients(np.concatenate([bags[i] for i in ids]), first, y[ids]), step + 1
                now = rate * 0.5 * (1 + np.cos(np.pi * epoch / epochs))
                for k, g in grads.items():
                    g = g + decay * self.w[k]
                    m[k], v[k] = 0.9 * m[k] + 0.1 * g, 0.999 * v[k] + 0.001 * g * g
                    self.w[k] = self.w[k] - now * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
        return self


def averaged(bag: np.ndarray) -> np.ndarray:
    """The passages of a text; those of a long one as the means of PARTS runs of them."""
    if len(bag) <= PARTS:
        return bag
    starts = (np.arange(PARTS) * len(bag)) // PARTS
    return np.add.reduceat(bag, starts) / np.diff(np.r_[starts, len(bag)])[:, None]


def _encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in steps(batch):
            x, first = passages(*text_buffer(part.column("text")))
            rows = [averaged(x[a:b]).astype(np.float32).tobytes() for a, b in zip(first[:-1], first[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("label"), pa.array(rows, pa.binary())], names=["doc_id", "label", "bag"])


def fit(docs: DataFrame, labels: DataFrame, most: int = TRAIN) -> Network:
    """Fit on the encoded passages of the sample; they come to the driver, 3 KB on average and 42 KB at most for each of ``most`` rows."""
    sample = labelled_sample(docs, labels, "quality", most).select(F.col("doc_id").cast("long").alias("doc_id"), "label", "text")
    rows = sorted(sample.mapInArrow(_encode, "doc_id long, label int, bag binary").collect(), key=lambda r: (r["doc_id"], r["bag"]))
    bags = [np.frombuffer(bytes(r["bag"]), np.float32).reshape(-1, N_FEATURES).astype(float) for r in rows]
    return Network().fit(bags, np.array([r["label"] for r in rows], float))


def scored(docs: DataFrame, network: Network) -> DataFrame:
    """row (a struct of the columns of docs, whatever their names) and score."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("row").field("text").cast(pa.large_string()).fill_null("")
            found = []
            for start, length in cuts(texts):
                data, offsets = text_buffer(texts.slice(start, length))
                found.append(np.array([network.score_pieces(data)]) if length == 1 and len(data) > STEP_BYTES else network.score(*passages(data, offsets)))
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(np.concatenate(found or [np.zeros(0)]))], names=["row", "score"])

    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    return rows.mapInArrow(score, T.StructType([rows.schema["row"], T.StructField("score", T.DoubleType())]))


def classify(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs."""
    found = scored(docs.select("doc_id", "text"), fit(docs, labels))
    return found.select("row.doc_id", "score").select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def accepted(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that score at least the threshold, with the columns of docs."""
    return scored(docs, fit(docs, labels)).where(F.col("score") >= threshold).select("row.*")
