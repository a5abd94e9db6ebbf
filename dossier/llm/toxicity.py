"""A convolutional classifier of whole texts: hashed word embeddings, several widths, maxima."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dossier.llm import ragged
from dossier.llm.common import FIT_ROWS, fit_labels, remainder, settled

BUCKETS = 1 << 16
SIZE = 8
#: Filters of each width in words.
FILTERS = {1: 8, 2: 4, 3: 4}
#: Share of words left out in training, and how far used embeddings shrink each step.
DROPPED = 0.4
#: Training texts with which the random part of a bucket's embedding starts at half its size.
HALF_TEXTS = 20
DECAY = 0.001
#: Words that one training task learns from, about, unless one text alone has more.
TASK_WORDS = 1 << 24
#: Words that a training step looks at together.
STEP_WORDS = 1 << 18
#: Toxic texts from which on a language has a cut of its own.
LEAST = 30
#: Buckets of the model that are averaged together, and parts that a unit of the logit falls into.
_ROWS = 1 << 10
_FINE = 256

# Frequent short words by which the language of a text is told for calibration.
STOP_WORDS = {
    "en": "the of and to in is it that for was on with be by this are or at from an",
    "de": "der die und das ist nicht ein eine zu den mit von sich auf für im dem des auch wird",
    "fr": "le la les et des du un une est que qui dans pour pas sur avec au par ce il",
    "es": "el los las que y en del por con una para es se no su al lo como más pero",
}
LANGUAGES = ("other", *STOP_WORDS)


def _word_hash(words: list[str]) -> np.ndarray:
    data, offsets = ragged.text_run(pa.array(words))
    return ragged.word_hashes(data, offsets[:-1], offsets[1:])


def word_rows(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words (runs of letters and digits) of each text, and their offsets."""
    data, offsets = ragged.text_run(column)
    starts, ends, rows = ragged.word_bounds(data, offsets, ragged.NOT_LETTER)
    return ragged.word_hashes(data, starts, ends), rows


class LanguageTable:
    """Tells the language of a text by its frequent words."""

    def __init__(self):
        pairs = [(h, k) for k, w in enumerate(STOP_WORDS.values()) for h in _word_hash(w.split())]
        self.hashes, at = np.unique(np.array([h for h, _ in pairs], dtype=np.uint64), return_inverse=True)
        self.votes = np.zeros((len(self.hashes) + 1, len(STOP_WORDS)), dtype=np.int32)
        np.add.at(self.votes, (at, [k for _, k in pairs]), 1)

    def of(self, words: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Place in ``LANGUAGES`` of each text; 0 without any frequent word, the first in a tie."""
        at = np.searchsorted(self.hashes, words)
        hit = at < len(self.hashes)
        hit[hit] = self.hashes[at[hit]] == words[hit]
        where = np.flatnonzero(hit)
        bounds = np.searchsorted(where, rows)
        votes = ragged.row_reduce(np.add, self.votes[at[where]], bounds, 0)
        return np.where(votes.max(axis=1) > 0, votes.argmax(axis=1) + 1, 0)


def buckets(hashes: np.ndarray) -> np.ndarray:
    return (hashes % np.uint64(BUCKETS)).astype(np.int32)


def _padded(words: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all words with empty ones after each text, so that no filter joins two texts."""
    pad = max(FILTERS) - 1
    counts = np.diff(rows)
    out = np.full(len(words) + pad * len(counts) + pad, BUCKETS, dtype=np.int64)
    out[np.arange(len(words)) + pad * np.repeat(np.arange(len(counts)), counts)] = words
    return out, rows[:-1] + pad * np.arange(len(counts))


@dataclass
class Classifier:
    """Weights of the network and the logit from which a language's texts count as toxic."""

    embedding: np.ndarray
    filters: dict[int, np.ndarray]
    bias: np.ndarray
    out: np.ndarray
    out_bias: float
    cuts: np.ndarray = field(default_factory=lambda: np.zeros(len(LANGUAGES)))

    @classmethod
    def start(cls, seed: int = 7) -> Classifier:
        random = np.random.default_rng(seed)
        embedding = random.normal(0, 0.1, (BUCKETS + 1, SIZE)).astype(np.float32)
        embedding[BUCKETS] = 0
        filters = {
            w: random.normal(0, 0.5 / np.sqrt(w), (w, SIZE, n)).astype(np.float32) for w, n in FILTERS.items()
        }
        total = sum(FILTERS.values())
        return cls(embedding, filters, np.zeros(total, np.float32), np.full(total, 0.5, np.float32), -2.0)

    def tables(self) -> dict[int, list[np.ndarray]]:
        """Each bucket's share in each filter, by place within the filter."""
        return {w: [self.embedding @ f[k] for k in range(w)] for w, f in self.filters.items()}

    def logits(self, words: np.ndarray, rows: np.ndarray, tables: dict) -> np.ndarray:
        if len(rows) < 2:
            return np.zeros(0)
        x, starts = _padded(words, rows)
        parts = []
        for w, table in tables.items():
            value = table[0][x[: len(x) - w + 1]]
            for k in range(1, w):
                value = value + table[k][x[k: len(x) - w + 1 + k]]
            parts.append(np.maximum.reduceat(value, starts, axis=0))
        pooled = np.maximum(np.concatenate(parts, axis=1) + self.bias, 0)
        return pooled @ self.out + self.out_bias

    def scores(self, column: pa.Array, languages: LanguageTable, tables: dict) -> tuple[np.ndarray, np.ndarray]:
        words, rows = word_rows(column)
        kind = languages.of(words, rows)
        logit = self.logits(buckets(words), rows, tables) - self.cuts[kind]
        return 1 / (1 + np.exp(-np.clip(logit, -30, 30))), kind


class _Adam:
    def __init__(self, rate: float):
        self.rate, self.state, self.steps = rate, {}, 0
        self.touched = np.zeros(BUCKETS)

    def step(self, name: str, value: np.ndarray, gradient: np.ndarray, at=slice(None)) -> None:
        m, v = self.state.setdefault(name, (np.zeros_like(value), np.zeros_like(value)))
        m[at] = 0.9 * m[at] + 0.1 * gradient
        v[at] = 0.99 * v[at] + 0.01 * gradient**2
        late = self.steps + 1
        value[at] -= self.rate * (m[at] / (1 - 0.9**late)) / (np.sqrt(v[at] / (1 - 0.99**late)) + 1e-6)


def fit(words: np.ndarray, rows: np.ndarray, labels: np.ndarray, epochs: int = 4, batch: int = 64, seed: int = 7) -> Classifier:
    """Train on the word buckets of labelled texts.

    The first coordinate of each embedding starts with the bucket's log odds in the training
    texts, the rest at random; everything is then trained by minibatches, the embeddings too.
    Without texts of both classes the network stays as it starts.
    """
    model = Classifier.start(seed)
    n_yes = int((labels > 0).sum())
    if not 0 < n_yes < len(labels):
        return model
    _odds(model, *_seen(words, rows, labels), n_yes, len(labels) - n_yes)
    _learn(model, words, rows, labels, n_yes / len(labels), epochs, batch, seed)
    return model


def _learn(
    model: Classifier, words: np.ndarray, rows: np.ndarray, labels: np.ndarray, share: float, epochs: int = 4, batch: int = 64, seed: int = 7
) -> _Adam:
    """Train by minibatches; ``share`` is that of the toxic among all texts, which sets their weight."""
    random, adam = np.random.default_rng(seed), _Adam(0.01)
    weight = np.where(labels > 0, min(3.0, (1 - share) / share), 1.0)
    for _ in range(epochs):
        order = random.permutation(len(labels))
        for a in range(0, len(order), batch):
            _train(model, adam, random, words, rows, labels, weight, order[a: a + batch])
    return adam


def _blocks(rows: np.ndarray, size: int = 1 << 17) -> list[tuple[int, int]]:
    """First and last text of runs of texts with about ``size`` words."""
    cuts = np.flatnonzero(np.diff(rows[:-1] // size)) + 1
    return list(zip(np.r_[0, cuts].tolist(), np.r_[cuts, len(rows) - 1].tolist(), strict=True))


def _seen(words: np.ndarray, rows: np.ndarray, labels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each bucket the number of toxic texts with it, and of others."""
    yes, no = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for a, b in _blocks(rows):
        seen, bounds = ragged.distinct_in_rows(words[rows[a]: rows[b]], rows[a: b + 1] - rows[a])
        toxic = np.repeat(labels[a:b], np.diff(bounds)) > 0
        yes += np.bincount(seen[toxic], minlength=BUCKETS)
        no += np.bincount(seen[~toxic], minlength=BUCKETS)
    return yes, no


def _odds(model: Classifier, yes: np.ndarray, no: np.ndarray, n_yes: int, n_no: int) -> None:
    odds = np.log((yes + 0.5) / (n_yes + 1)) - np.log((no + 0.5) / (n_no + 1))
    # Buckets seen in few texts say little.
    spread = np.sqrt(1 / (yes + 0.5) + 1 / (no + 0.5))
    sure = np.sign(odds) * np.maximum(0, np.abs(odds) - 2.5 * spread)
    model.embedding[:BUCKETS, 0] = np.clip(sure, -4, 4) / 2
    # The random part grows with the texts: there is none of buckets not seen, and any can be learnt.
    model.embedding[:BUCKETS, 1:] *= ((yes + no) / (yes + no + HALF_TEXTS))[:, None].astype(np.float32)
    for w, filters in model.filters.items():
        filters[:, 0, 0] = 1.0 / w


def _train(model: Classifier, adam: _Adam, random, words, rows, labels, weight, chosen: np.ndarray) -> None:
    # Some words of each text are left out each time, so that no single rare word is learnt.
    picked = [words[rows[i]: rows[i + 1]] for i in chosen]
    picked = [p[random.random(len(p)) > DROPPED] for p in picked]
    bounds = np.concatenate([[0], np.cumsum([len(p) for p in picked])])
    x, starts = _padded(np.concatenate(picked), bounds)
    ends = np.r_[starts[1:], len(x) - max(FILTERS) + 1]
    tops, values = _maxima(model, x, starts, ends)
    pooled = np.concatenate(values, axis=1) + model.bias
    active = np.maximum(pooled, 0)
    p = 1 / (1 + np.exp(-np.clip(active @ model.out + model.out_bias, -30, 30)))
    error = ((p - labels[chosen]) * weight[chosen] / len(chosen)).astype(np.float32)
    back = error[:, None] * model.out * (pooled > 0)
    slots, grads, at = [], [], 0
    for (w, f), top in zip(model.filters.items(), tops, strict=True):
        own = back[:, at: at + f.shape[2]]
        at += f.shape[2]
        change = np.zeros_like(f)
        for k in range(w):
            change[k] = np.einsum("nf,nfd->df", own, model.embedding[x[top + k]])
            slots.append(x[top + k].ravel())
            grads.append((own[:, :, None] * f[k].T).reshape(-1, SIZE))
        adam.step(f"filter{w}", f, change)
    slot, inverse = np.unique(np.concatenate(slots), return_inverse=True)
    total = np.zeros((len(slot), SIZE), dtype=np.float32)
    np.add.at(total, inverse, np.concatenate(grads))
    # The empty bucket between texts stays empty.
    real = slot < BUCKETS
    adam.step("embedding", model.embedding, total[real], slot[real])
    adam.touched[slot[real]] += 1
    model.embedding[slot[real]] *= 1 - DECAY
    adam.step("bias", model.bias, back.sum(axis=0))
    adam.step("out", model.out, active.T @ error + 1e-4 * model.out)
    model.out_bias -= 0.02 * float(error.sum())
    adam.steps += 1


def _maxima(model: Classifier, x: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[list, list]:
    """For each width where in ``x`` each text's filters are highest, and how high; in runs of
    ``STEP_WORDS`` words, so that a long text is seen whole in little memory."""
    tops = [np.zeros((len(starts), n), dtype=np.int64) for n in FILTERS.values()]
    values = [np.full((len(starts), n), -np.inf, dtype=np.float32) for n in FILTERS.values()]
    for low in range(0, int(ends[-1]), STEP_WORDS):
        high = min(low + STEP_WORDS, int(ends[-1]))
        embedded = model.embedding[x[low: high + max(FILTERS) - 1]]
        texts = np.flatnonzero((starts < high) & (ends > low))
        for (w, f), top, most in zip(model.filters.items(), tops, values, strict=True):
            n = len(embedded) - w + 1
            value = sum(embedded[k: n + k] @ f[k] for k in range(w))
            for i in texts:
                a, b = max(starts[i] - low, 0), min(ends[i], high) - low
                at = a + value[a:b].argmax(axis=0)
                found = value[at, np.arange(value.shape[1])]
                better = found > most[i]
                top[i, better], most[i, better] = at[better] + low, found[better]
    return tops, values


def cuts(logits: DataFrame, least: int = LEAST) -> np.ndarray:
    """For each language the logit with the best F1; languages with few toxic texts share one.

    ``logits`` has a row ``language, logit, label`` for each text. All their distinct logits are
    compared: sums over narrow ranges of logits travel to every executor, and within a range a
    window adds up the rest.
    """
    toxic = F.col("label") > 0
    one = logits.groupBy("language", "logit").agg(F.sum(toxic.cast("long")).alias("yes"), F.count("*").alias("n"))
    both = one.withColumn("language", F.explode(F.array("language", F.lit(-1)))).groupBy("language", "logit").agg(
        F.sum("yes").alias("yes"), F.sum("n").alias("n")
    )
    # Ranges of 1/256 from -128 to 128; what lies beyond is in the first or the last.
    span = 128 * _FINE
    both = settled(both.withColumn("range", F.greatest(F.lit(-span), F.least(F.lit(span), F.floor(F.col("logit") * _FINE)))))
    down = Window.partitionBy("language").orderBy(F.desc("range"))
    sums = both.groupBy("language", "range").agg(F.sum("yes").alias("yes"), F.sum("n").alias("n")).select(
        "language", "range", *[(F.sum(c).over(down) - F.col(c)).alias(f"{c}_above") for c in ("yes", "n")],
        *[F.sum(c).over(Window.partitionBy("language")).alias(f"{c}_all") for c in ("yes", "n")],
    )
    inside = Window.partitionBy("language", "range").orderBy(F.desc("logit"))
    hits, seen = (F.sum(c).over(inside) + F.col(f"{c}_above") for c in ("yes", "n"))
    best = (
        both.join(F.broadcast(sums), ["language", "range"])
        .withColumn("f1", 2.0 * hits / (seen + F.col("yes_all")))
        .groupBy("language").agg(
            F.max(F.struct("f1", "logit")).alias("best"), F.first("yes_all").alias("yes"), F.first("n_all").alias("n"),
        )
        .select("language", F.col("best.logit").alias("cut"), "yes", "n")
    )
    found = best.collect()
    below = both.join(F.broadcast(logits.sparkSession.createDataFrame(
        [(r["language"], r["cut"]) for r in found], "language int, cut double"
    )), "language").filter("logit < cut").groupBy("language").agg(F.max("logit").alias("logit")).collect() if found else []
    below = {r["language"]: r["logit"] for r in below}
    values = {
        r["language"]: (r["cut"] + below.get(r["language"], r["cut"])) / 2 if 0 < r["yes"] < r["n"] else 0.0 for r in found
    }
    many = {r["language"] for r in found if r["yes"] >= least}
    return np.array([values[k] if k in many else values.get(-1, 0.0) for k in range(len(LANGUAGES))])


def _texts(batch: pa.RecordBatch | pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word buckets of all texts of a batch of ``prepared`` rows, their offsets, and the labels."""
    lists = [np.frombuffer(x.as_py(), np.uint16) for x in batch.column("words")]
    words = np.concatenate([*lists, np.zeros(0, np.uint16)]).astype(np.int32)
    labels = (batch.column("label").to_numpy() > 0).astype(np.int64)
    return words, np.r_[0, np.cumsum([len(x) for x in lists], dtype=np.int64)], labels


def prepared(documents: DataFrame, known: DataFrame) -> DataFrame:
    """``doc_id, label, language, size, words`` of every row of the documents that has a label.

    The words are buckets of 16 bits, a third of the text's bytes; they travel in place of texts,
    to be merged with the labels at every size.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        languages = LanguageTable()
        for batch in batches:
            for part in ragged.slices(batch, "text"):
                words, rows = word_rows(part.column("text"))
                data, kinds = buckets(words).astype(np.uint16), languages.of(words, rows)
                yield pa.RecordBatch.from_arrays([
                    part.column("doc_id"), pa.array(kinds.astype(np.int32)), pa.array(np.diff(rows)),
                    pa.array([data[a:b].tobytes() for a, b in zip(rows[:-1], rows[1:], strict=True)], pa.binary()),
                ], ["doc_id", "language", "size", "words"])

    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter("doc_id is not null")
    words = texts.mapInArrow(run, "doc_id long, language int, size long, words binary")
    return words.join(known.hint("merge"), "doc_id").select("doc_id", "label", "language", "size", "words")


def _counted(texts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """``_seen`` over all rows of ``prepared``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yes, no = np.zeros(BUCKETS), np.zeros(BUCKETS)
        for batch in batches:
            for part in ragged.slices(batch, "words"):
                a, b = _seen(*_texts(part))
                yes, no = yes + a, no + b
        at = np.flatnonzero(yes + no)
        yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in (at, yes[at], no[at])], ["bucket", "yes", "no"])

    found = texts.select("label", "words").mapInArrow(run, "bucket long, yes long, no long").groupBy("bucket").agg(
        F.sum("yes").alias("yes"), F.sum("no").alias("no")
    ).toArrow()
    yes, no = np.zeros(BUCKETS), np.zeros(BUCKETS)
    at = found["bucket"].to_numpy()
    yes[at], no[at] = found["yes"].to_numpy(), found["no"].to_numpy()
    return yes, no


def _averaged(texts: DataFrame, model: Classifier, share: float, tasks: int) -> Classifier:
    """Train ``tasks`` times from one start, each on its share of the texts, and average.

    A bucket's embedding counts in a task as often as the task moved it, all else by the steps.
    """
    shared = texts.sparkSession.sparkContext.broadcast(model)
    schema = "piece int, weights binary, sums binary"
    dense = [*model.filters.values(), model.bias, model.out, np.array([model.out_bias])]
    last = -(-BUCKETS // _ROWS)

    def run(table: pa.Table) -> pa.Table:
        part = table["part"][0].as_py()
        # Rows arrive in any order; rows alike in all this are alike to the training.
        words, rows, labels = _texts(table.sort_by([(c, "ascending") for c in ("doc_id", "size", "label", "words")]))
        start = shared.value
        own = Classifier(start.embedding.copy(), {w: f.copy() for w, f in start.filters.items()}, start.bias.copy(), start.out.copy(), start.out_bias)
        adam = _learn(own, words, rows, labels, share, seed=7 + part)
        pieces = [
            (k, adam.touched[a: a + _ROWS], adam.touched[a: a + _ROWS, None] * own.embedding[a: min(a + _ROWS, BUCKETS)])
            for k, a in enumerate(range(0, BUCKETS, _ROWS))
        ]
        flat = np.concatenate([np.ravel(x) for x in (*own.filters.values(), own.bias, own.out, own.out_bias)])
        pieces.append((last, np.array([float(adam.steps)]), adam.steps * flat.astype(np.float64)))
        return _sent(pieces)

    def added(table: pa.Table) -> pa.Table:
        weights = sum(np.frombuffer(x.as_py()) for x in table["weights"])
        return _sent([(table["piece"][0].as_py(), weights, sum(np.frombuffer(x.as_py()) for x in table["sums"]))])

    parts = texts.withColumn("part", F.pmod(F.xxhash64("doc_id"), F.lit(tasks)).cast("int"))
    trained = parts.groupBy("part").applyInArrow(run, schema).groupBy("piece").applyInArrow(added, schema)
    for row in trained.collect():
        weights, sums = np.frombuffer(row["weights"]), np.frombuffer(row["sums"])
        if row["piece"] < last:
            at = np.flatnonzero(weights)
            model.embedding[row["piece"] * _ROWS + at] = sums.reshape(-1, SIZE)[at] / weights[at, None]
            continue
        flat = np.split(sums / weights, np.cumsum([x.size for x in dense])[:-1])
        flat = [x.reshape(y.shape).astype(y.dtype) for x, y in zip(flat, dense, strict=True)]
        model.filters, (model.bias, model.out) = dict(zip(model.filters, flat, strict=False)), flat[-3:-1]
        model.out_bias = float(flat[-1][0])
    return model


def _sent(pieces: list[tuple[int, np.ndarray, np.ndarray]]) -> pa.Table:
    """Pieces of a model's weighted sums, as they travel."""
    return pa.table({
        "piece": pa.array([k for k, _, _ in pieces], pa.int32()),
        "weights": pa.array([w.astype(np.float64).tobytes() for _, w, _ in pieces], pa.binary()),
        "sums": pa.array([s.astype(np.float64).tobytes() for _, _, s in pieces], pa.binary()),
    })


def train(documents: DataFrame, labels: DataFrame, rows: int = FIT_ROWS, label: str = "toxic", folds: int = 5) -> Classifier:
    """Fit and calibrate on every labelled text, whatever its length, but those of fold 0.

    Counts and cuts come from all these texts. Training tasks have about ``rows`` texts each, by
    hash of the id, so reruns agree; their models are averaged.
    """
    learnt = documents.filter(remainder("doc_id", folds) != 0)
    texts = settled(prepared(learnt, fit_labels(labels, label, folds)))
    total = texts.agg(F.count("*"), F.sum((F.col("label") > 0).cast("long")), F.sum("size")).first()
    n, n_yes = total[0], total[1] or 0
    model = Classifier.start()
    if 0 < n_yes < n:
        _odds(model, *_counted(texts), n_yes, n - n_yes)
        tasks = max(1, -(-n // rows), -(-total[2] // TASK_WORDS))
        model = _averaged(texts, model, n_yes / n, tasks)
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = shared.value
        tables = weights.tables()
        for batch in batches:
            for part in ragged.slices(batch, "words"):
                words, bounds, _ = _texts(part)
                logit = np.concatenate([
                    weights.logits(words[bounds[a]: bounds[b]], bounds[a: b + 1] - bounds[a], tables) for a, b in _blocks(bounds)
                ])
                yield pa.RecordBatch.from_arrays(
                    [part.column("language"), pa.array(logit.astype(np.float64)), part.column("label")], ["language", "logit", "label"]
                )

    if n:
        model.cuts = cuts(texts.select("language", "label", "words").mapInArrow(scored, "language int, logit double, label int"))
    return model


def toxicity(df: DataFrame, model: Classifier, text: str = "text") -> Column:
    """``struct<score, language>`` of the whole text; from 0.5 on the text counts as toxic.

    Null and empty texts have the score of a text without words and the language ``other``.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf(T.StructType([T.StructField("score", T.DoubleType()), T.StructField("language", T.StringType())]))
    def score(column: pa.Array) -> pa.Array:
        weights = shared.value
        if not hasattr(weights, "ready"):
            weights.ready = LanguageTable(), weights.tables()
        scores, kinds = [np.zeros(0)], [np.zeros(0, np.int64)]
        for part in ragged.slices(pa.RecordBatch.from_arrays([column], ["text"]), "text"):
            s, k = weights.scores(part.column("text"), *weights.ready)
            scores.append(s)
            kinds.append(k)
        names = pa.array(LANGUAGES).take(pa.array(np.concatenate(kinds)))
        return pa.StructArray.from_arrays([pa.array(np.concatenate(scores), pa.float64()), names], ["score", "language"])

    return score(F.col(text))
