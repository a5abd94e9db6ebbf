"""A log-bilinear language model of two levels, trained with noise-contrastive estimation.

A word's probability is that of its class after the two words before it, times that of the word
within its class; the model gives both. Words that occur often enough to learn from have a vector
of their own, as words to predict and as words before others. Ordered by frequency they are cut
into classes, about as many as the root of their number, so each level is normalised by a small
matrix product. Words too rare for a vector form one class more, in which counts over the whole
corpus tell the word's share. The product sums to one over the seen words and one unseen word.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dossier.llm import ragged
from dossier.llm.common import remainder, settled

#: Least number of classes of frequent words, and classes of all others.
TOP = 200
SHARED = 1
#: Least number of context buckets for words without a vector, and the size of vectors.
CONTEXTS = 4096
SIZE = 16
#: Words with fewer tokens have no vector (but the ``TOP`` most frequent always have one). No more
#: than ``MOST`` words have one, as every executor holds them; those are the most frequent.
LEAST = 10
MOST = 1 << 18
#: Tokens of a training step, and noise words that the tokens of a step share.
STEP = 2048
NOISE = 48
#: Weights that are formed together when tokens are scored: they stay in the cache.
SCORED = 1 << 16
#: Tokens, about, that share the weights of their context words when they are scored.
SHARING = 400_000
#: Tokens after a context word from which on its weights for all classes are shared, and classes
#: whose weights are formed at once.
OFTEN = 3
CLASSES = 64
#: Noise words of the same class for each token whose class has several words.
NEAR = 3
RATE = 0.15
#: Gradients are means over a step's tokens times this, against the start of the adaptive rates.
PULL = 200.0
START = 1e-2
#: Tokens that one training task learns from, about: their number decides how many tasks there
#: are, whatever the files, so that every task gets away from the start.
TASK_TOKENS = 1 << 24
#: Distinct words that a task keeps while it counts.
COUNT_ROWS = 1 << 20
#: Rows of the model that travel together, and tasks whose changes are added up in one step.
_ROWS = 1 << 12
_ADDED = 64
END = ragged.mix(np.array([0x1F2E3D4C5B6A7988], dtype=np.uint64))[0]


def token_rows(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each text's tokens, its words and then one end, and the offsets of the texts."""
    data, offsets = ragged.text_run(column)
    starts, ends, rows = ragged.word_bounds(data, offsets)
    n = len(rows) - 1
    out = np.empty(len(starts) + n, dtype=np.uint64)
    out[np.arange(len(starts)) + np.repeat(np.arange(n), np.diff(rows))] = ragged.word_hashes(data, starts, ends)
    out[rows[1:] + np.arange(n)] = END
    return out, rows + np.arange(n + 1)


def word_counts(texts: DataFrame) -> DataFrame:
    """``word`` (hash) and ``c``, its number of tokens in all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        waiting: list[np.ndarray] = []

        def merged():
            found, n = np.unique(np.concatenate(waiting), return_counts=True)
            keys, inverse = np.unique(np.concatenate([words, found]), return_inverse=True)
            return keys, np.bincount(inverse, weights=np.concatenate([counts, n])).astype(np.int64)

        def rows():
            return pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), pa.array(counts)], ["word", "c"])

        for batch in batches:
            for part in ragged.slices(batch, "text"):
                waiting.append(token_rows(part.column("text"))[0])
                if sum(map(len, waiting)) > COUNT_ROWS:
                    words, counts = merged()
                    waiting = []
                    if len(words) > COUNT_ROWS:
                        yield rows()
                        words, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        if waiting:
            words, counts = merged()
        if len(words):
            yield rows()

    return texts.select("text").mapInArrow(run, "word long, c long").groupBy("word").agg(F.sum("c").alias("c"))


@dataclass
class Vocabulary:
    """Words with vectors (by hash) and their counts, and classes as runs of these words by rank.

    ``order`` is each word's rank, ``starts`` the first rank of each class and the end of the last,
    ``upto`` the counts, one added to each, of all words up to a rank. ``mass`` holds the sums of
    these for the classes; the last one is that of all other words and an unseen one.
    """

    words: np.ndarray
    counts: np.ndarray
    order: np.ndarray
    starts: np.ndarray
    upto: np.ndarray
    mass: np.ndarray
    tokens: int
    distinct: int

    def __post_init__(self):
        # Where the words with the same first bits begin; few words share them.
        bits = max(1, 3 + len(self.words).bit_length())
        heads = np.searchsorted(self.words >> np.uint64(64 - bits), np.arange((1 << bits) + 1, dtype=np.uint64))
        self._shift, self._heads = np.uint64(64 - bits), heads[:-1].astype(np.int32)
        self._most = int(np.diff(heads).max()) if len(self.words) else 0
        self._class = np.append(np.repeat(np.arange(len(self.starts) - 1), np.diff(self.starts)), len(self.starts) - 1)

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether each word has a vector, and its place among those that have."""
        if not len(self.words):
            return np.zeros(len(hashes), bool), np.zeros(len(hashes), np.int64)
        if self._most > 64:
            at = np.minimum(np.searchsorted(self.words, hashes), len(self.words) - 1)
            return self.words.take(at) == hashes, at
        at = self._heads.take((hashes >> self._shift).view(np.int64)).astype(np.int64)
        np.minimum(at, len(self.words) - 1, out=at)
        found = self.words.take(at) == hashes
        left = np.flatnonzero(~found)
        for _ in range(1, self._most):
            left = left[at[left] < len(self.words) - 1]
            left = left[self.words.take(at[left]) < hashes[left]]
            at[left] += 1
            hit = self.words.take(at[left]) == hashes[left]
            found[left[hit]] = True
            left = left[~hit]
        return found, at

    def ranks(self, found: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Each word's rank; words without a vector come after all others."""
        return np.where(found, self.order[at], len(self.words)) if len(self.words) else at

    def classes_of(self, ranks: np.ndarray) -> np.ndarray:
        return self._class.take(ranks)

    def within(self, ranks: np.ndarray, classes: np.ndarray) -> np.ndarray:
        """Places of the tokens whose class has several words with vectors."""
        sizes = np.append(np.diff(self.starts), 0)
        return np.flatnonzero((sizes[classes] > 1) & (ranks < len(self.words)))

    def tilts(self) -> np.ndarray:
        """For each rank, the log of its share of its class against an even share."""
        sizes = np.diff(self.starts)
        own = np.diff(np.append(0, self.upto))
        return (np.log(own) + np.repeat(np.log(sizes) - np.log(self.mass[:-1]), sizes)).astype(np.float32)

    def buckets(self) -> int:
        """Number of context vectors: one a word that has any, and those that the others share."""
        return len(self.words) + max(CONTEXTS, len(self.words) // 8)

    def contexts(self, hashes: np.ndarray, rows: np.ndarray, found: np.ndarray, at: np.ndarray) -> np.ndarray:
        others = np.uint64(self.buckets() - len(self.words))
        bucket = np.where(found, at, len(self.words) + ((hashes >> np.uint64(41)) % others).astype(np.int64))
        return _before(bucket.astype(np.int32), rows, self.buckets())


def _frequent(counts: DataFrame) -> DataFrame:
    """The words that get a vector; those of the last level taken are chosen by hash."""
    levels = counts.filter(F.col("c") >= LEAST).groupBy(F.floor(F.log2("c") * 8).alias("level")).agg(
        F.count("*").alias("n"), F.min("c").alias("c")
    ).orderBy(F.desc("level")).collect()
    if sum(row["n"] for row in levels) < TOP:
        return counts.orderBy(F.desc("c"), "word").limit(TOP)
    taken, whole, last = 0, None, None
    for row in levels:
        if taken + row["n"] > MOST:
            last = row["c"], (MOST - taken) / row["n"]
            break
        taken, whole = taken + row["n"], row["c"]
    chosen = F.lit(False) if whole is None else F.col("c") >= whole
    if last is not None:
        share = F.pmod("word", F.lit(1 << 20)) < F.lit(int(last[1] * (1 << 20)))
        chosen = chosen | ((F.col("c") >= last[0]) & share)
    return counts.filter(chosen)


def vocabulary(counts: DataFrame) -> Vocabulary:
    """Words with vectors and class sizes from the table of counts, which stays distributed."""
    total = counts.agg(F.sum("c"), F.count("*")).first()
    tokens, distinct = total[0] or 0, total[1]
    frequent = _frequent(counts).toArrow()
    words, c = frequent["word"].to_numpy().view(np.uint64), frequent["c"].to_numpy()
    by_hash = np.argsort(words)
    words, c = words[by_hash], c[by_hash]
    by_rank = np.lexsort((words, -c))
    order = np.empty(len(words), dtype=np.int64)
    order[by_rank] = np.arange(len(words))
    upto = np.cumsum(c[by_rank] + 1)
    if len(words) <= TOP:
        heads = np.arange(len(words))
    else:
        # Each class has about the same sum of roots of counts: frequent words stand alone.
        number = max(TOP, math.isqrt(len(words)))
        sums = np.cumsum(np.sqrt(c[by_rank]))
        cut = np.minimum((sums - np.sqrt(c[by_rank])) / sums[-1] * number, number - 1).astype(np.int64)
        heads = np.flatnonzero(np.r_[True, cut[1:] != cut[:-1]])
    starts = np.append(heads, len(words))
    sums = np.append(0, upto)
    rest = tokens + distinct - sums[-1] + 1
    mass = np.append(np.diff(sums[starts]), rest).astype(np.float64)
    return Vocabulary(words, c, order, starts, upto, mass, tokens, distinct)


@dataclass
class Model:
    """Context vectors, a weight vector for each of the two places, vectors and biases of classes,
    and those of words within their classes (the bias, in the last column, adds to the log share)."""

    context: np.ndarray
    place: np.ndarray
    target: np.ndarray
    bias: np.ndarray
    word: np.ndarray

    @classmethod
    def start(cls, mass: np.ndarray, seed: int = 9, buckets: int = CONTEXTS, words: int = 0) -> Model:
        """Class biases are those of the counts; the rest is small and random, or nothing for words."""
        random = np.random.default_rng(seed)
        context = random.normal(0, 0.1, (buckets + 1, SIZE)).astype(np.float32)
        place = np.ones((2, SIZE), dtype=np.float32)
        target = random.normal(0, 0.1, (len(mass), SIZE)).astype(np.float32)
        word = np.zeros((words, SIZE + 1), dtype=np.float32)
        return cls(context, place, target, np.log(mass / mass.sum()).astype(np.float32), word)

    def rows(self) -> np.ndarray:
        """All parameters as rows of one table."""
        parts = [self.context, self.place, np.concatenate([self.target, self.bias[:, None]], axis=1), self.word]
        return np.concatenate([np.pad(x, ((0, 0), (0, SIZE + 1 - x.shape[1]))) for x in parts])

    def filled(self, table: np.ndarray) -> Model:
        ends = np.cumsum([len(self.context), len(self.place), len(self.target)])
        context, place, target, word = np.split(table.astype(np.float32), ends)
        return Model(context[:, :SIZE].copy(), place[:, :SIZE].copy(), target[:, :SIZE].copy(), target[:, SIZE].copy(), word)

    def predicted(self, before: np.ndarray) -> np.ndarray:
        """The vector that two context words (columns of ``before``) predict for the next."""
        return self.context.take(before[:, 0], axis=0) * self.place[0] + self.context.take(before[:, 1], axis=0) * self.place[1]

    def guessed(self, before: np.ndarray) -> np.ndarray:
        """Predicted vectors with a last column of ones, which meets the biases."""
        out = np.ones((len(before), SIZE + 1), dtype=np.float32)
        for a in range(0, len(before), STEP):
            out[a: a + STEP, :SIZE] = self.predicted(before[a: a + STEP])
        return out

    def class_logs(self, guess: np.ndarray, classes: np.ndarray, before: np.ndarray | None = None) -> np.ndarray:
        """Log probability of each token's class, by predicted vectors that end with one.

        A weight is the product of one weight for each place, so with ``before`` the weights of
        context words that come up several times are formed once for all tokens after them.
        """
        rows = np.append(self.target, self.bias[:, None], axis=1)
        if before is None:
            return _chosen(guess, rows, classes)
        out = np.empty(len(classes), dtype=np.float64)
        own, sums = self._shared_sums(before)
        left = np.ones(len(classes), dtype=bool)
        left[own] = False
        left = np.flatnonzero(left)
        out[left] = _chosen(guess.take(left, axis=0), rows, classes.take(left))
        picked = np.einsum("nd,nd->n", guess.take(own, axis=0), rows.take(classes.take(own), axis=0))
        out[own] = picked - np.log(sums)
        return out

    def _shared_sums(self, before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Tokens whose two context words come up several times, and the sums of their classes' weights."""
        shared = np.bincount(before[:, 0], minlength=len(self.context)) >= OFTEN
        words = np.flatnonzero(shared)
        own = np.flatnonzero(shared.take(before[:, 0]) & shared.take(before[:, 1]))
        number = np.cumsum(shared) - 1
        pairs = number.take(before[:, 0].take(own)) * len(words) + number.take(before[:, 1].take(own))
        # In order of the first word its weights stay in the cache; equal pairs have one sum.
        pairs, order = _sorted(pairs, len(words) ** 2)
        new = np.ones(len(pairs), dtype=bool)
        new[1:] = pairs[1:] != pairs[:-1]
        own, pair = own.take(order), np.cumsum(new) - 1
        first, second = np.divmod(pairs[new], max(1, len(words)))
        vectors = self.context.take(words, axis=0)
        sums = np.zeros(len(first))
        top = np.zeros((2, len(words)), dtype=np.float32)
        with np.errstate(over="ignore", invalid="ignore"):
            for a in range(0, len(self.target), CLASSES):
                target = self.target[a: a + CLASSES].T
                weights = np.exp(vectors * self.place[0] @ target + self.bias[a: a + CLASSES]), np.exp(vectors * self.place[1] @ target)
                np.maximum(top, [x.max(axis=1) for x in weights], out=top)
                for b in range(0, len(sums), STEP):
                    both = weights[0].take(first[b: b + STEP], axis=0), weights[1].take(second[b: b + STEP], axis=0)
                    sums[b: b + STEP] += np.einsum("nd,nd->n", *both)
        # Where all weights are moderate, what single precision loses below its range is nothing to the sum.
        good = (top[0].take(first) < 1e15) & (top[1].take(second) < 1e15) & (sums > 1e-6)
        own, pair = own[good.take(pair)], pair[good.take(pair)]
        return own, sums.take(pair)

    def logs(self, before: np.ndarray, ranks: np.ndarray, classes: np.ndarray, known: Vocabulary) -> np.ndarray:
        """log10 probability of each token: of its class, normalised over all classes, and of it within
        the class, normalised over the class's words; a token without a vector counts as one unseen."""
        guess = self.guessed(before)
        out = np.where(ranks < len(known.words), 0.0, -np.log(known.mass[-1]))
        out += self.class_logs(guess, classes, before)
        some = known.within(ranks, classes)
        some = some[np.argsort(classes[some].astype(np.int16), kind="stable")]
        ends = np.append(np.flatnonzero(np.diff(classes[some])) + 1, len(some))
        share = np.diff(np.append(0, known.upto))
        for a, b in zip(np.append(0, ends[:-1]), ends, strict=True):
            if a == b:
                continue
            k, own = classes[some[a]], some[a:b]
            low, high = known.starts[k], known.starts[k + 1]
            rows = self.word[low:high].copy()
            rows[:, SIZE] += np.log(share[low:high] / share[low:high].sum()).astype(np.float32)
            out[own] += _chosen(guess.take(own, axis=0), rows, ranks[own] - low)
        return out / np.log(10)


def _chosen(guess: np.ndarray, rows: np.ndarray, own: np.ndarray) -> np.ndarray:
    """Log of the normalised weight of one row for each guess; both end with what the bias needs."""
    out = np.empty(len(own), dtype=np.float64)
    weights, ones = np.ascontiguousarray(rows.T), np.ones(len(rows), dtype=np.float32)
    size = max(32, SCORED // len(rows))
    with np.errstate(over="ignore"):
        for a in range(0, len(own), size):
            logits = guess[a: a + size] @ weights
            at = own[a: a + size]
            picked = logits.ravel().take(np.arange(0, logits.size, len(rows)) + at)
            sums = np.exp(logits) @ ones
            if not (sums.min() > 0 and sums.max() < np.inf):
                top = logits.max(axis=1)
                picked, sums = picked - top, np.exp(logits - top[:, None]) @ ones
            out[a: a + size] = picked - np.log(sums)
    return out


def contexts(hashes: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Hashed buckets of the two tokens before each token, where no word has a vector."""
    return _before(((hashes >> np.uint64(41)) % np.uint64(CONTEXTS)).astype(np.int32), rows, CONTEXTS)


def _before(bucket: np.ndarray, rows: np.ndarray, empty: int) -> np.ndarray:
    """Buckets of the two tokens before each token; before a text begins an empty one."""
    before = np.full((len(bucket), 2), empty, dtype=np.int32)
    before[1:, 0] = bucket[:-1]
    before[2:, 1] = bucket[:-2]
    heads = rows[:-1]
    before[heads] = empty
    second = heads + 1
    before[second[second < rows[1:]], 1] = empty
    return before


def _summed(keys: np.ndarray, values: np.ndarray, shares: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, below 2**31, and the sum of the rows of each.

    With ``shares``, one for each key, a row of ``values`` belongs to several keys in turn and
    counts by its share.
    """
    keys, order = _sorted(keys, 1 << 31)
    rows = values.take(order if shares is None else order // (len(keys) // len(values)), axis=0)
    if shares is not None:
        rows *= shares.take(order)[:, None]
    heads = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    times = np.diff(heads, append=len(keys))
    # Most keys have one row, or two: a context word is the first before one token and the second before another.
    sums = rows.take(heads, axis=0)
    two, more = np.flatnonzero(times == 2), np.flatnonzero(times > 2)
    _put(sums, two, sums.take(two, axis=0) + rows.take(heads.take(two) + 1, axis=0))
    if len(more):
        rows, times = rows.take(np.flatnonzero(np.repeat(times > 2, times)), axis=0), times.take(more)
        _put(sums, more, np.add.reduceat(rows, np.cumsum(times) - times, axis=0))
    return keys.take(heads), sums


def _sorted(keys: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys, below a limit, in order, and their places: both are sorted as one number, if that holds them."""
    bits = len(keys).bit_length()
    if limit.bit_length() + bits > 63:
        order = np.argsort(keys, kind="stable")
        return keys.take(order), order
    packed = np.sort(keys.astype(np.int64) << bits | np.arange(len(keys)))
    return packed >> bits, packed & ((1 << bits) - 1)


def _put(table: np.ndarray, at: np.ndarray, rows: np.ndarray) -> None:
    """``table[at] = rows`` for distinct places, each row moved as a whole."""
    row = np.dtype((np.void, table.strides[0]))
    table.view(row)[:, 0][at] = np.ascontiguousarray(rows).view(row)[:, 0]


class Trainer:
    """Noise-contrastive training on a stream of tokens, with step sizes that adapt."""

    def __init__(self, model: Model, mass: np.ndarray, seed: int, known: Vocabulary | None = None):
        self.model, self.random, self.known = model, np.random.default_rng(seed), known
        self.noise = np.cumsum(mass / mass.sum())
        self.shift = np.log(NOISE * mass / mass.sum()).astype(np.float32)
        self.tilts = known.tilts() if known is not None else None
        self.squares = [np.full_like(x, START) for x in (model.context, model.place, model.target, model.bias, model.word)]

    def step(self, before: np.ndarray, classes: np.ndarray, ranks: np.ndarray | None = None) -> None:
        """A step on some tokens; without ``ranks`` only classes are learnt."""
        m, n = self.model, len(classes)
        noise = np.minimum(np.searchsorted(self.noise, self.random.random(NOISE), side="right"), len(self.noise) - 1)
        first, second = m.context.take(before[:, 0], axis=0), m.context.take(before[:, 1], axis=0)
        # Guesses with a last column of ones, which meets the biases.
        grown = np.ones((n, SIZE + 1), dtype=np.float32)
        guess = grown[:, :SIZE]
        np.multiply(first, m.place[0], out=guess)
        guess += second * m.place[1]
        own, others = m.target.take(classes, axis=0), m.target[noise]
        real = np.einsum("nd,nd->n", guess, own) + m.bias[classes] - self.shift[classes]
        # Error of the guess that a word is real: for the true words and for the noise.
        up = 1 / (1 + np.exp(np.clip(real, -30, 30)))
        down = grown @ np.append(-others, (self.shift[noise] - m.bias[noise])[:, None], axis=1).T
        with np.errstate(over="ignore"):
            np.exp(down, out=down)
        down += 1
        np.reciprocal(down, out=down)
        back = up[:, None] * own - down @ others
        added = np.append((up[:, None] * grown).T, -(grown.T @ down), axis=1)
        at = np.append(classes, noise)
        gain = np.stack([np.bincount(at, x, len(m.bias)) for x in added], axis=1).astype(np.float32)
        words = None if ranks is None else self._within(grown, classes, ranks, back)
        change = np.empty((2 * n, SIZE), dtype=np.float32)
        np.multiply(back, m.place[0], out=change[:n])
        np.multiply(back, m.place[1], out=change[n:])
        places = np.stack([np.einsum("nd,nd->d", back, first), np.einsum("nd,nd->d", back, second)])
        slots, sums = _summed(before.T.ravel(), change)
        scale = np.float32(PULL / n)
        if words is not None:
            self._move(4, m.word, words[1] * scale, words[0])
        self._move(2, m.target, gain[:, :SIZE] * scale)
        self._move(3, m.bias, gain[:, SIZE] * scale)
        self._move(1, m.place, places * scale)
        self._move(0, m.context, sums * scale, slots)

    def _within(self, grown: np.ndarray, classes: np.ndarray, ranks: np.ndarray, back: np.ndarray):
        """Gradients of words within classes, by rank; what they ask of the guess is added to ``back``."""
        known = self.known
        some = known.within(ranks, classes)
        if not len(some):
            return None
        k, grown = classes.take(some), grown.take(some, axis=0)
        low = known.starts.take(k)
        size = known.starts.take(k + 1) - low
        rows = np.empty((len(some), NEAR + 1), dtype=np.int64)
        rows[:, 0] = ranks.take(some)
        # Every word of the class is as likely as noise; its share of the class adds to its score.
        rows[:, 1:] = low[:, None] + (self.random.random((len(some), NEAR), dtype=np.float32) * size[:, None]).astype(np.int64)
        np.minimum(rows[:, 1:], (low + size - 1)[:, None], out=rows[:, 1:])
        vectors = self.model.word.take(rows, axis=0)
        error = np.einsum("nd,nkd->nk", grown, vectors)
        error += self.tilts.take(rows)
        error -= np.float32(np.log(NEAR))
        error = -1 / (1 + np.exp(np.clip(-error, -30, 30)))
        error[:, 0] += 1
        _put(back, some, back.take(some, axis=0) + np.einsum("nk,nkd->nd", error, vectors[:, :, :SIZE]))
        return _summed(rows.ravel(), grown, error.ravel())

    def _move(self, k: int, value: np.ndarray, gradient: np.ndarray, at: np.ndarray | None = None) -> None:
        squares = self.squares[k] if at is None else self.squares[k].take(at, axis=0)
        squares += gradient * gradient
        gradient *= RATE
        gradient /= np.sqrt(squares)
        if at is None:
            value += gradient
        else:
            _put(self.squares[k], at, squares)
            _put(value, at, value.take(at, axis=0) + gradient)

    def learnt(self) -> np.ndarray:
        """How much each row of the model has been asked to change, as its weight among tasks."""
        context, place, target, bias, word = self.squares
        parts = [x.mean(axis=1) for x in (context, place, np.append(target, bias[:, None], axis=1), word)]
        return np.concatenate(parts) - np.float32(START)


def train(texts: DataFrame, known: Vocabulary) -> Model:
    """Train on all tokens of all texts: each task on its own, from one start, then averaged.

    The number of tasks follows from the tokens. A row of the model counts in a task by what the
    task learnt about it, so a word that few tasks meet is not diluted by the others. A task
    sends the rows of its model that it changed, so what travels follows its words; the sums are
    formed by parts of the model, over many tasks in two steps.
    """
    start = Model.start(known.mass, buckets=known.buckets(), words=len(known.words))
    if not known.tokens:
        return start
    shared = texts.sparkSession.sparkContext.broadcast((start, known))
    tasks = max(1, round(known.tokens / TASK_TOKENS))
    size = SIZE + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, words = shared.value
        task = TaskContext.get().partitionId()
        model = base.filled(base.rows())
        trainer = Trainer(model, words.mass, task, words)
        for batch in batches:
            for part in ragged.slices(batch, "text"):
                hashes, rows = token_rows(part.column("text"))
                found, at = words.find(hashes)
                before, ranks = words.contexts(hashes, rows, found, at), words.ranks(found, at)
                classes = words.classes_of(ranks)
                for a in range(0, len(hashes), STEP):
                    trainer.step(before[a: a + STEP], classes[a: a + STEP], ranks[a: a + STEP])
        weight = trainer.learnt()
        del trainer
        change = model.rows()
        change -= base.rows()
        for a in range(0, len(change), _ROWS):
            own = weight[a: a + _ROWS]
            at = np.flatnonzero(own > 0)
            if len(at):
                rows = np.append(change[a: a + _ROWS][at], np.ones((len(at), 1), np.float32), axis=1) * own[at, None]
                yield _sent(a // _ROWS, task // _ADDED, at, rows)

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for row in range(batch.num_rows):
                number, group, at, data = (batch.column(k)[row].as_py() for k in ("part", "group", "at", "total"))
                own = sums.setdefault((number, group), np.zeros((_ROWS, size + 1)))
                own[np.frombuffer(at, np.int16)] += np.frombuffer(data, np.float32).reshape(-1, size + 1)
        for (number, group), own in sums.items():
            at = np.flatnonzero(own[:, size] > 0)
            yield _sent(number, group // _ADDED, at, own[at])

    schema = "part int, group int, at binary, total binary"
    table = start.rows()
    parts = -(-len(table) // _ROWS)
    sums = texts.select("text").coalesce(tasks).mapInArrow(run, schema)
    groups = -(-tasks // _ADDED)
    while True:
        sums = sums.repartition(parts * groups, "part", "group").mapInArrow(added, schema)
        if groups == 1:
            break
        groups = -(-groups // _ADDED)
    for row in sums.toLocalIterator():
        at = row["part"] * _ROWS + np.frombuffer(row["at"], np.int16).astype(np.int64)
        own = np.frombuffer(row["total"], np.float32).reshape(-1, size + 1)
        table[at] += own[:, :size] / own[:, size:]
    return start.filled(table)


def _sent(part: int, group: int, at: np.ndarray, rows: np.ndarray) -> pa.RecordBatch:
    """Rows of a part of the model, as they travel."""
    return pa.RecordBatch.from_pydict({
        "part": pa.array([part], pa.int32()), "group": pa.array([group], pa.int32()),
        "at": pa.array([at.astype(np.int16).tobytes()], pa.binary()), "total": pa.array([rows.astype(np.float32).tobytes()], pa.binary()),
    })


def _many_tokens(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Parts of a batch without their texts, which are read by slices, and their tokens as ``token_rows`` gives them."""
    rest, first, held, n = batch.drop_columns(["text"]), 0, [], 0

    def joined():
        sizes = np.concatenate([np.diff(offsets) for _, offsets in held])
        return rest.slice(first, len(sizes)), np.concatenate([x for x, _ in held]), np.append(0, np.cumsum(sizes))

    for part in ragged.slices(batch, "text"):
        held.append(token_rows(part.column("text")))
        n += len(held[-1][0])
        if n >= SHARING:
            out = joined()
            yield out
            first, held, n = first + out[0].num_rows, [], 0
    if held:
        yield joined()


def language_scores(df: DataFrame, held_out: Column) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` of every row.

    ``held_out`` marks the rows that nothing is learnt from. Null texts are empty and have one
    token, their end. ``base_score`` comes from word counts alone with one added, ``score`` from
    the model; both are sums of log10 probabilities. Without rows to learn from every word is
    unseen. Repeated rows stay; words are told apart by a 64-bit hash.
    """
    rows = df.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(held_out, F.lit(False)).alias("held_out"), "text")
    learnt = rows.filter(~F.col("held_out"))
    counts = settled(word_counts(learnt))
    known = vocabulary(counts)
    shared = df.sparkSession.sparkContext.broadcast((train(learnt, known), known))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, words = shared.value
        logs = np.log10(words.counts + 1.0)
        for batch in batches:
            for part, hashes, offsets in _many_tokens(batch):
                found, at = words.find(hashes)
                ranks = words.ranks(found, at)
                classes, before = words.classes_of(ranks), words.contexts(hashes, offsets, found, at)
                own = model.logs(before, ranks, classes, words)
                frequent = np.where(found, logs[at], 0.0) if len(logs) else np.zeros(len(hashes))
                # Other words go on with their number in the text, to meet their counts.
                row = np.repeat(np.arange(part.num_rows), np.diff(offsets))[~found]
                rare = hashes[~found]
                order = np.lexsort((rare, row))
                rare, row = rare[order], row[order]
                heads = np.flatnonzero(np.r_[True, (rare[1:] != rare[:-1]) | (row[1:] != row[:-1])]) if len(rare) else np.zeros(0, int)
                times = np.diff(np.r_[heads, len(rare)])
                ends = np.concatenate([[0], np.cumsum(np.bincount(row[heads], minlength=part.num_rows))]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([
                    part.column("row"), part.column("doc_id"), part.column("held_out"), pa.array(np.diff(offsets)),
                    pa.array(ragged.row_sums(found.astype(np.int64), offsets)), pa.array(ragged.row_sums(frequent, offsets)),
                    pa.array(ragged.row_sums(own, offsets)),
                    pa.ListArray.from_arrays(pa.array(ends), pa.array(rare[heads].view(np.int64))),
                    pa.ListArray.from_arrays(pa.array(ends), pa.array(times.astype(np.int32))),
                ], ["row", "doc_id", "held_out", "n_tokens", "n_frequent", "logs", "own", "rare", "times"])

    scored = settled(rows.withColumn("row", F.monotonically_increasing_id()).mapInArrow(
        run, "row long, doc_id long, held_out boolean, n_tokens long, n_frequent long, logs double, own double, "
             "rare array<long>, times array<int>",
    ))
    # A word without a vector has few tokens or comes after 2**18 others, so the join has no hot key.
    rest = (
        scored.select("row", F.explode(F.arrays_zip("rare", "times")).alias("w"))
        .select("row", F.col("w.rare").alias("word"), F.col("w.times").alias("n"))
        .join(counts, "word").groupBy("row")
        .agg(F.sum("n").alias("more"), F.sum(F.col("n") * F.log10(F.col("c") + 1.0)).alias("more_logs"))
    )
    more = F.coalesce("more_logs", F.lit(0.0))
    return scored.join(rest, "row", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("n_frequent") + F.coalesce("more", F.lit(0))).cast("long").alias("n_known"),
        F.lit(known.tokens).cast("long").alias("train_tokens"),
        (F.col("logs") + more - F.col("n_tokens") * F.log10(F.lit(float(known.tokens + known.distinct + 1)))).alias("base_score"),
        (F.col("own") + more).alias("score"),
    )


def fold(divisor: int, held: int, id_column: str = "doc_id") -> Column:
    """Whether the CRC-32 of a row's id leaves this remainder; rows without id are not held out."""
    return F.coalesce(remainder(id_column, divisor) == held, F.lit(False))
