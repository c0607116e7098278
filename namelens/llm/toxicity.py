"""Toxicity: maximum-scoring segments of token log-odds, calibrated by extreme values.

Tokens and their prefixes get the log-odds of occurring in toxic against other
documents, with an informative Dirichlet prior (their share of all sampled
documents).  Those whose z value is high are the lexicon; one that only goes along
with a stronger one (in copies of a toxic text, say) is left out.  A token has the
highest log-odds of its entries; one without any costs the drift.  One linear scan finds all maximal-scoring segments of a text.
A segment of score s in a text of n tokens has the expected number
K n exp(-lambda s) by chance; the evidence of a document is the sum of the
significant segments' logarithms of that; a logistic curve of the evidence and of
the tokens that carry it, fitted on the sample, gives the score.

The model is fitted on a bounded sample of labelled rows (``TRAIN``), whole texts of it;
the lexicon has every token of the sample whose z value and log-odds are high enough, and
goes to the workers with the function.

Defined results: null and empty texts have no segment, and a score as well;
without labels of both kinds no text has evidence.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from namelens.llm.common import LOWER, WORD, checkpoint, span_hashes, steps, text_buffer, text_of, word_spans
from namelens.llm.labelled import held_out, labelled_sample

#: Labelled rows that the model is fitted on at most.
TRAIN = 12_000
#: Bytes of the prefixes that count beside a word.
PREFIXES = (3, 4, 5, 7)


class Settings(NamedTuple):
    """Weight of the prior, in documents; lowest z and log-odds of a lexicon entry; cost of any other token.

    Of 18 tried, the defaults have the least product of losses over folds of training rows (``losses_by_folds``) of two tables, and the least on the larger one.
    """

    prior: float = 40.0
    z_least: float = 2.0
    odds_least: float = 1.5
    drift: float = 0.15


#: Toxic documents of the sample that a lexicon entry stands in at least: fewer are mostly names and misspellings of one source.
LEAST_DOCS = 4
THRESHOLD = 0.5
SETS = "doc_id long, label int, n long, tokens array<long>"


def tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, text number) of every token: a row of hashes for the word, and one for each prefix of it (0 if it has none).

    Tokens are runs of ASCII letters and digits and other characters, A-Z lowered.
    """
    data, offsets = text_buffer(column)
    data = LOWER[data]
    start, end, text = word_spans(data, offsets, WORD)
    ends = [end, *(np.minimum(start + k, end) for k in PREFIXES)]
    hashes = span_hashes(data, np.tile(start, len(ends)), np.concatenate(ends)).reshape(len(ends), -1) | np.uint64(1)
    for row, k in enumerate(PREFIXES, 1):
        hashes[row, end - start <= k] = 0
    return hashes, text


def maximal_segments(at: list[int], score: list[float], drift: float) -> list[tuple[float, int, int]]:
    """All maximal-scoring segments (score, first, last token) of a sequence whose other tokens cost ``drift``.

    at, score: places and scores of the tokens above zero, in order.  Each one is
    pushed once and merged at most once into an earlier segment; by Ruzzo and Tompa.
    """
    found: list[tuple[float, float, int, int]] = []  # sum before, sum after, first, last
    total, last = 0.0, -1
    for i, s in zip(at, score, strict=True):
        total -= drift * (i - last - 1)
        low, first = total, i
        total += s
        last = i
        while True:
            j = len(found) - 1
            while j >= 0 and found[j][0] >= low:
                j -= 1
            if j < 0 or found[j][1] >= total:
                found.append((low, total, first, i))
                break
            low, first = found[j][0], found[j][2]
            del found[j:]
    return [(high - low, a, b) for low, high, a, b in found]


class Model:
    def __init__(self, settings: Settings = Settings()) -> None:  # noqa: B008
        self.settings = settings
        self.hashes, self.scores = np.zeros(0, np.uint64), np.zeros(0)
        self.rate, self.k = 1.0, 1.0
        self.curve = np.array([-3.0, 1.0, 1.0, 0.0])

    def evidence(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(evidence, significant segments, lexicon tokens within them) of every text."""
        h, text = tokens(column)
        n = np.bincount(text, minlength=len(column))
        out, many, long = np.zeros(len(column)), np.zeros(len(column), np.int64), np.zeros(len(column), np.int64)
        if not len(text) or not len(self.hashes):
            return out, many, long
        best = np.zeros(len(text))
        for row in h:
            at = np.minimum(np.searchsorted(self.hashes, row), len(self.hashes) - 1)
            np.maximum(best, np.where(self.hashes[at] == row, self.scores[at], 0), out=best)
        hit = np.flatnonzero(best)
        first = np.r_[0, np.cumsum(n)]
        edges = np.r_[np.flatnonzero(np.r_[True, text[hit][1:] != text[hit][:-1]]), len(hit)] if len(hit) else [0]
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            i = text[hit[a]]
            for s, begin, last in maximal_segments((hit[a:b] - first[i]).tolist(), best[hit[a:b]].tolist(), self.settings.drift):
                e = self.rate * s - math.log(self.k * n[i])
                if e > 0:
                    out[i] += e
                    many[i] += 1
                    long[i] += int((best[first[i] + begin : first[i] + last + 1] > 0).sum())
        return out, many, long

    def score(self, evidence: np.ndarray, hits: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(_terms(evidence, hits) @ self.curve, -30, 30)))


def _terms(evidence: np.ndarray, hits: np.ndarray) -> np.ndarray:
    """What the score is a logistic curve of: a constant, the evidence, the number of tokens that carry it, and the evidence of each."""
    return np.stack([np.ones(len(evidence)), np.log1p(evidence), np.log1p(hits), np.log1p(evidence / np.maximum(1, hits))], 1)


def _token_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in steps(batch):
            h, text = tokens(part.column("text"))
            edges = np.searchsorted(text, np.arange(part.num_rows + 1))
            sets = [np.unique(h[:, a:b]) for a, b in zip(edges[:-1], edges[1:], strict=True)]
            sets = [s[s != 0].view(np.int64) for s in sets]  # 0 stands for a prefix that a word doesn't have
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("label"), pa.array(np.diff(edges)), pa.array(sets, pa.list_(pa.int64()))], names=["doc_id", "label", "n", "tokens"])


def _log_odds(y1, y0, n1: float, n0: float, weight: float, alone=None) -> tuple[np.ndarray, np.ndarray]:
    """(log-odds, z) of document counts under the informative Dirichlet prior; alone: the toxic documents that count."""
    prior = weight * (y1 + y0) / (n1 + n0)
    y1 = y1 if alone is None else alone
    odds = lambda y, n: np.log((y + prior) / (n + weight - y - prior))
    delta = odds(y1, n1) - odds(y0, n0)
    return delta, delta / np.sqrt(1 / (y1 + prior) + 1 / (y0 + prior))


def _odds_columns(y1: Column, y0: Column, n1: float, n0: float, weight: float) -> tuple[Column, Column]:
    """The same for columns, all toxic documents counting; null for a token that every document has, which tells nothing."""
    prior = F.lit(weight) * (y1 + y0) / F.lit(n1 + n0)
    odds = lambda y, n: F.log(F.try_divide(y + prior, F.lit(n + weight) - y - prior))
    delta = odds(y1, n1) - odds(y0, n0)
    return delta, delta / F.sqrt(1 / (y1 + prior) + 1 / (y0 + prior))


def fit(docs: DataFrame, labels: DataFrame, most: int = TRAIN, settings: Settings = Settings()) -> Model:  # noqa: B008
    sample = checkpoint(labelled_sample(docs, labels, "toxic", most).select(F.col("doc_id").cast("long").alias("doc_id"), "label", "text"))
    return fit_sample(sample, checkpoint(sample.mapInArrow(_token_sets, SETS)), settings)


def fit_sample(sample: DataFrame, sets: DataFrame, settings: Settings = Settings()) -> Model:  # noqa: B008
    """Fit on a written sample (doc_id, label, text) and its written token sets (SETS)."""
    model = Model(settings)
    total = sets.agg(F.sum("label"), F.count("*"), F.sum(F.when(F.col("label") == 0, F.col("n")))).first()
    n1, n0 = float(total[0] or 0), float(total[1] - (total[0] or 0))
    if not n1 or not n0:
        return model
    counts = sets.select("label", F.explode("tokens").alias("token")).groupBy("token").agg(F.sum("label").alias("y1"), F.count("*").alias("y")).where((F.col("y1") >= LEAST_DOCS) & (F.col("y") < n1 + n0))
    delta, z = _odds_columns(F.col("y1"), F.col("y") - F.col("y1"), n1, n0, settings.prior)
    # what stronger tokens explain only lowers these two, so no other token can be chosen
    held = checkpoint(counts.withColumns({"delta": delta, "z": z}).where((F.col("delta") >= settings.odds_least) & (F.col("z") >= settings.z_least)))
    pairs = sets.where("label = 1").select("doc_id", F.explode("tokens").alias("token")).join(held, "token").groupBy("token", "y1", "y", "z").agg(F.array_sort(F.collect_list("doc_id")).alias("docs"))
    counts = sorted(pairs.collect(), key=lambda r: (-r["z"], r["token"]))  # of sampled toxic documents only
    if not counts:
        return model
    token, y1, y = (np.array([r[c] for r in counts], np.int64) for c in ("token", "y1", "y"))
    number = {d: n for n, d in enumerate(sorted({d for r in counts for d in r["docs"]}))}
    having = [[number[d] for d in r["docs"]] for r in counts]
    explained, chosen = np.zeros(len(number)), []
    for i in range(len(counts)):
        alone = float((0.5 ** explained[having[i]]).sum())  # documents that stronger tokens explain count less
        odds, own_z = _log_odds(float(y1[i]), float(y[i] - y1[i]), n1, n0, settings.prior, alone)
        if own_z >= settings.z_least and odds >= settings.odds_least:
            chosen.append((int(np.int64(token[i]).view(np.uint64)), float(_log_odds(float(y1[i]), float(y[i] - y1[i]), n1, n0, settings.prior)[0]), int(y[i] - y1[i])))
            explained[having[i]] += 1
    if not chosen:
        return model
    chosen.sort()
    model.hashes, model.scores = np.array([c[0] for c in chosen], np.uint64), np.array([c[1] for c in chosen])
    # lambda: the positive root of the mean of exp(lambda s) = 1 over tokens of documents that aren't toxic
    share = (np.array([c[2] for c in chosen]) + 0.5) / max(1.0, float(total[2] or 0))
    low, high = 1e-3, 50.0
    for _ in range(60):
        mid = (low + high) / 2
        mean = math.exp(-mid * settings.drift) * (1 - share.sum()) + float((share * np.exp(np.minimum(700, mid * model.scores))).sum())
        low, high = (mid, high) if mean < 1 else (low, mid)
    model.rate, model.k = low, max(1e-9, float(share.sum()))

    rows = sorted(sample.mapInArrow(_evidence(model, ["doc_id", "label"]), "doc_id long, label int, evidence double, segments long, hits long, score double").select("doc_id", "label", "evidence", "hits").collect())
    evidence, hits, y = (np.array([r[c] for r in rows], float) for c in ("evidence", "hits", "label"))
    model.curve = _logistic(_terms(evidence, hits), y)
    return model


def losses_by_folds(docs: DataFrame, labels: DataFrame, candidates: list[Settings], folds: int = 3, most: int = TRAIN) -> dict[Settings, float]:
    """The mean logarithmic loss of each candidate's settings over folds of the training rows.

    Held-out rows take no part: each fold is scored by a model of the others.  So the settings were chosen, on the test tables.
    """
    sample = checkpoint(labelled_sample(docs, labels, "toxic", most).select(F.col("doc_id").cast("long").alias("doc_id"), "label", "text"))
    sets = checkpoint(sample.mapInArrow(_token_sets, SETS))
    fold = F.pmod(F.xxhash64(F.lit("fold"), "doc_id"), F.lit(folds))
    total = dict.fromkeys(candidates, 0.0)
    for k in range(folds):
        for settings in candidates:
            model = fit_sample(checkpoint(sample.where(fold != k)), checkpoint(sets.where(fold != k)), settings)
            scored = sample.where(fold == k).mapInArrow(_evidence(model, ["doc_id", "label"]), "doc_id long, label int, evidence double, segments long, hits long, score double")
            total[settings] += scored.agg(F.sum(-F.log(F.when(F.col("label") == 1, F.col("score")).otherwise(1 - F.col("score"))))).first()[0] or 0.0
    return {s: loss / max(1, sample.count()) for s, loss in total.items()}


def _logistic(a: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights of the likeliest curve under a weak prior, by Newton steps that are halved until they help."""
    scale = np.r_[1.0, a[:, 1:].std(0) + 1e-6]
    a, prior, w = a / scale, np.r_[1e-3, np.full(a.shape[1] - 1, 0.3)], np.zeros(a.shape[1])
    cost = lambda w: float(np.logaddexp(0, a @ w).sum() - y @ (a @ w) + 0.5 * prior @ (w * w))
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a.T * (p * (1 - p))) @ a + np.diag(prior), a.T @ (p - y) + prior * w)
        now, rate = cost(w), 1.0
        while rate > 1e-4 and cost(w - rate * step) > now:
            rate /= 2
        w = w - rate * step
        if rate * np.abs(step).max() < 1e-6:
            break
    return w / scale


def _evidence(model: Model, keys: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in steps(batch):
                evidence, many, hits = model.evidence(part.column("text"))
                yield pa.RecordBatch.from_arrays([*(part.column(k) for k in keys), *map(pa.array, (evidence, many, hits, model.score(evidence, hits)))], names=[*keys, "evidence", "segments", "hits", "score"])

    return run


def classify(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted, segments, toxic_words for every row of docs."""
    model = fit(docs, labels)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    found = rows.mapInArrow(_evidence(model, ["doc_id"]), "doc_id long, evidence double, segments long, hits long, score double")
    return found.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "segments", F.col("hits").alias("toxic_words"))
