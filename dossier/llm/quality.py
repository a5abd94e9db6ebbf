"""Text quality learnt from trusted positives and unlabelled texts with a non-negative risk."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dossier.llm import ragged
from dossier.llm.common import FIT_ROWS, fit_labels, remainder, thinned

HIDDEN = 16

_UPPER, _LOWER, _DIGIT, _HIGH, _LINE = range(5)
# Signs that have a share of their own.
SIGNS = "!#$%&*|.,;:?-_=@/<>()[]{}\"'\\+~^`"


def _byte_classes() -> np.ndarray:
    """For each byte which of the counted classes it belongs to, as columns of 0 and 1."""
    kinds = np.zeros((256, 5 + len(SIGNS)), dtype=np.float32)
    kinds[65:91, _UPPER] = kinds[97:123, _LOWER] = kinds[48:58, _DIGIT] = kinds[128:, _HIGH] = 1
    kinds[10, _LINE] = 1
    for k, sign in enumerate(SIGNS):
        kinds[ord(sign), 5 + k] = 1
    return kinds


def features(column: pa.Array) -> np.ndarray:
    """One row of style features for each text: shares of signs, of cases and of repeated words."""
    data, offsets = ragged.text_run(column)
    starts, ends, rows = ragged.word_bounds(data, offsets)
    words = ragged.word_hashes(data, starts, ends)
    size = np.diff(offsets)
    counts = np.diff(rows)
    n, m = np.maximum(size, 1), np.maximum(counts, 1)
    # A count for each text and byte gives all classes at once.
    texts = np.repeat(np.arange(len(size)), size)
    histogram = np.bincount(texts * 256 + data, minlength=256 * len(size)).reshape(-1, 256)
    shares = histogram.astype(np.float32) @ _byte_classes() / n[:, None]
    lengths = (ends - starts).astype(np.float64)
    same = np.zeros(len(words))
    if len(words) > 1:
        same[1:] = words[1:] == words[:-1]
    heads = rows[:-1][counts > 0]
    same[heads] = 0
    unique, bounds = ragged.distinct_in_rows(words, rows)
    distinct = np.diff(bounds)
    order = np.lexsort((words, np.repeat(np.arange(len(counts)), counts)))
    ordered = words[order]
    fresh = np.ones(len(words), dtype=bool)
    if len(words) > 1:
        fresh[1:] = ordered[1:] != ordered[:-1]
    fresh[heads] = True
    at = np.flatnonzero(fresh)
    times = np.diff(np.r_[at, len(words)]).astype(np.float64)
    top = ragged.row_reduce(np.maximum, times, bounds, 0.0)
    tail = data[np.maximum(ends - 1, 0)] if len(ends) else np.zeros(0, np.uint8)
    odd_tail = ragged.row_sums(np.isin(tail, np.frombuffer(b"!#$%&*|", np.uint8)).astype(float), rows)
    caps = (data[starts] >= 65) & (data[starts] < 91) if len(starts) else np.zeros(0, bool)
    letters = np.maximum(shares[:, _UPPER] + shares[:, _LOWER], 1e-6)
    lines = shares[:, _LINE] * n + 1
    dense = np.stack([
        np.log1p(size), np.log1p(counts), ragged.row_sums(lengths, rows) / m,
        np.log1p(ragged.row_reduce(np.maximum, lengths, rows, 0.0)),
        distinct / m, np.log1p(m) - np.log1p(np.maximum(distinct, 1)), top / m,
        ragged.row_sums(same, rows) / m, odd_tail / m, ragged.row_sums(caps.astype(float), rows) / m,
        shares[:, _UPPER] / letters, np.log1p(m / lines), (counts == 0).astype(float),
    ], axis=1)
    return np.concatenate([dense, np.sqrt(shares)], axis=1).astype(np.float32)


@dataclass
class Scorer:
    """Scaling of the features and a network with one hidden layer."""

    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: np.ndarray
    prior: float = 0.5

    def logits(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -6, 6)
        return np.tanh(z @ self.w1 + self.b1) @ self.w2 + self.b2[0]

    def scores(self, column: pa.Array) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(features(column)), -30, 30).astype(float)))


def fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float, steps: int = 1500, batch: int = 512,
        rate: float = 0.01, seed: int = 5) -> Scorer:
    """Minimise the non-negative risk of positive against unlabelled rows with logistic loss.

    The risk is ``prior * R_p(+)`` plus ``R_u(-) - prior * R_p(-)``, where the second part
    estimates the risk of the negatives. When a minibatch makes it negative the step goes the
    other way on that part alone, so the network does not learn the unlabelled positives.
    Without rows of both kinds the score is the prior everywhere.
    """
    width = (positive if len(positive) else unlabelled).shape[1]
    random = np.random.default_rng(seed)
    prior = float(np.clip(prior, 0.01, 0.99))
    zero = np.zeros((width, HIDDEN), np.float32)
    model = Scorer(np.zeros(width, np.float32), np.ones(width, np.float32), zero, np.zeros(HIDDEN, np.float32),
                   np.zeros(HIDDEN, np.float32), np.array([np.log(prior / (1 - prior))], np.float32), prior)
    if not len(positive) or not len(unlabelled):
        return model
    model.mean, model.scale = unlabelled.mean(axis=0), unlabelled.std(axis=0) + 1e-3
    model.w1 = random.normal(0, 1 / np.sqrt(width), (width, HIDDEN)).astype(np.float32)
    model.w2 = random.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN).astype(np.float32)
    p = np.clip((positive - model.mean) / model.scale, -6, 6)
    u = np.clip((unlabelled - model.mean) / model.scale, -6, 6)
    weights = [model.w1, model.b1, model.w2, model.b2]
    first = [np.zeros_like(w) for w in weights]
    second = [np.zeros_like(w) for w in weights]
    for step in range(1, steps + 1):
        x = np.concatenate([p[random.integers(0, len(p), batch)], u[random.integers(0, len(u), batch)]])
        hidden = np.tanh(x @ model.w1 + model.b1)
        up = 1 / (1 + np.exp(-np.clip(hidden @ model.w2 + model.b2[0], -30, 30)))
        loss = np.logaddexp(0, np.clip(hidden @ model.w2 + model.b2[0], -30, 30))
        negative = loss[batch:].mean() - prior * loss[:batch].mean()
        # Derivative of the loss of "-" is the score, that of "+" the score minus one.
        back = np.concatenate([-prior * up[:batch], up[batch:]]) / batch
        if negative < 0:
            back = -back
        else:
            back[:batch] += prior * (up[:batch] - 1) / batch
        inner = back[:, None] * model.w2 * (1 - hidden**2)
        gradients = [x.T @ inner + 1e-4 * model.w1, inner.sum(axis=0), hidden.T @ back + 1e-4 * model.w2, back.sum(keepdims=True)]
        pace = rate * min(1.0, 2 * (1 - step / (steps + 1)))
        for w, g, m, v in zip(weights, gradients, first, second, strict=True):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            w -= (pace * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-7)).astype(np.float32)
    return model


def estimate_prior(labelled_positive: int, labelled: int) -> float:
    """Share of positives, estimated from all labelled rows outside the held-out fold."""
    return (labelled_positive + 1) / (labelled + 2)


def train(documents: DataFrame, labels: DataFrame, rows: int = FIT_ROWS, label: str = "quality", folds: int = 5) -> Scorer:
    """Fit on about ``rows`` trusted positives and as many unlabelled texts, chosen by hash of the id.

    Neither set holds texts of fold 0. The class prior comes from all labelled rows of the other
    folds. Only features travel to the driver: at most about ``2 * rows`` short rows.
    """

    @F.arrow_udf(T.BinaryType())
    def described(column: pa.Array) -> pa.Array:
        return pa.array([row.tobytes() for row in _sliced(features, column)], pa.binary())

    known = fit_labels(labels, label, folds)
    total = known.agg(F.count("*"), F.sum((F.col("label") > 0).cast("long"))).first()
    trusted = thinned(known.filter("label > 0"), rows, "doc_id").select("doc_id")
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter(remainder("doc_id", folds) != 0)
    # The positives are at most about ``rows`` ids, so they may go to every executor.
    positive = texts.join(F.broadcast(trusted), "doc_id").select("doc_id", F.lit(1).alias("kind"), described("text").alias("x"))
    unlabelled = thinned(texts, rows, "doc_id", seed=13).select("doc_id", F.lit(0).alias("kind"), described("text").alias("x"))
    table = positive.unionAll(unlabelled).toArrow().combine_chunks()
    width = features(pa.array([""])).shape[1]
    x = np.frombuffer(b"".join(table["x"].to_pylist()), dtype=np.float32).reshape(-1, width)
    kind, ids = table["kind"].to_numpy(), table["doc_id"].to_numpy()
    order = np.lexsort((x[:, 0], ids, kind))
    x, kind = x[order], kind[order]
    return fit(x[kind == 1], x[kind == 0], estimate_prior(total[1] or 0, total[0]))


def _sliced(measure, column: pa.Array) -> np.ndarray:
    """``measure`` of a column, slice by slice so that its arrays stay small."""
    batch = pa.RecordBatch.from_arrays([column], ["text"])
    parts = [measure(part.column("text")) for part in ragged.slices(batch, "text")]
    return np.concatenate(parts) if parts else measure(column)


def quality(df: DataFrame, model: Scorer, text: str = "text") -> Column:
    """Score of the whole text from 0 to 1, higher for better texts; null and empty texts too."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf(T.DoubleType())
    def score(column: pa.Array) -> pa.Array:
        return pa.array(_sliced(shared.value.scores, column), pa.float64())

    return score(F.col(text))
