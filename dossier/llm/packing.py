"""Pack documents into token windows by multiway differencing of Karmarkar and Karp."""

from __future__ import annotations

import heapq
import os
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import compress, pairwise

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dossier.llm import ragged

WINDOW = 2048
END = 1
#: Pieces that are dealt out over windows together.
GROUP_PIECES = 768
#: Documents are cut at multiples of the window, and what is left over into parts of this size.
PART = 512
#: Distinct words whose ids one worker keeps (about 40 bytes each), and how many of the first of them stay when there are
#: more: frequent words come early, so those are the ones worth keeping.
CACHE_WORDS = 1_000_000
KEPT_WORDS = 750_000


def differenced(sizes: np.ndarray, windows: int) -> np.ndarray:
    """The window, 0 up to ``windows``, of each size, so that the windows' sums are near equal.

    Every size starts as a partition with one filled window. The two partitions with the widest
    gap between their fullest and emptiest window are merged again and again, the fullest windows
    of one with the emptiest of the other, until one is left.
    """
    n = len(sizes)
    if windows <= 1 or n == 0:
        return np.zeros(n, dtype=np.int64)
    sums: list[np.ndarray | None] = []
    for size in sizes:
        one = np.zeros(windows, dtype=np.int64)
        one[0] = size
        sums.append(one)
    heap = [(-int(s), i) for i, s in enumerate(sizes)]
    heapq.heapify(heap)
    merged = []
    while len(heap) > 1:
        a, b = heapq.heappop(heap)[1], heapq.heappop(heap)[1]
        # Sums are kept in descending order: turning one around sets full windows on empty ones.
        total = sums[a] + sums[b][::-1]
        order = np.argsort(-total, kind="stable")
        total = total[order]
        sums[a] = sums[b] = None
        sums.append(total - total[-1])
        merged.append((a, b, order))
        heapq.heappush(heap, (-int(total[0] - total[-1]), len(sums) - 1))
    # Backwards: where each partition's windows lie among the final ones.
    place: dict[int, np.ndarray] = {heap[0][1]: np.arange(windows)}
    for k in range(len(merged) - 1, -1, -1):
        a, b, order = merged[k]
        final = place.pop(n + k)
        own = np.empty(windows, dtype=np.int64)
        own[order] = final
        place[a], place[b] = own, own[::-1]
    return np.array([place[i][0] for i in range(n)], dtype=np.int64)


def windows_of(sizes: np.ndarray, capacity: int = WINDOW) -> np.ndarray:
    """A window for each size (none above the capacity), no window fuller than the capacity.

    Starts with as few windows as the sum needs; while one is too full there are more of them.
    """
    count = max(1, -(-int(sizes.sum()) // capacity))
    while True:
        window = differenced(sizes, count)
        filled = np.bincount(window, weights=sizes, minlength=count)
        excess = np.maximum(filled - capacity, 0).sum()
        if not excess:
            return window
        count += max(1, int(excess // (4 * capacity)))


def cut(length: int) -> list[int]:
    """Lengths of a document's pieces: full windows, then parts of what is left over."""
    full, rest = divmod(length, WINDOW)
    pieces = [WINDOW] * full
    while rest > PART:
        pieces.append(PART)
        rest -= PART
    return pieces + [rest] * (rest > 0)


_LETTER, _SIGN, _LEAD, _TRAIL, _OTHER, _GAP = range(6)


def _kinds() -> np.ndarray:
    """What each byte of UTF-8 is: a letter or a sign of ASCII (but the apostrophe, and no digit),
    the first or second byte of a letter of Latin-1, the space between words, or something else."""
    kinds = np.full(256, _OTHER, dtype=np.uint8)
    kinds[33:127] = _SIGN
    kinds[[*range(65, 91), *range(97, 123)]] = _LETTER
    kinds[[ord("'"), *range(48, 58)]] = _OTHER
    kinds[128:192] = _TRAIL
    # The signs for times and divided by stand among the letters.
    kinds[[0x97, 0xB7]] = _OTHER
    kinds[0xC3], kinds[32] = _LEAD, _GAP
    return kinds


_KINDS = _kinds()


def plain_words(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Which words are letters and then signs, either of them possibly missing, and of how many of the two each consists."""
    kind = _KINDS[np.frombuffer(b" ".join(words) + b" ", dtype=np.uint8)]
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.append(0, ends[:-1])
    here, after = kind[:-1], kind[1:]
    wrong = (here == _OTHER) | ((here == _LEAD) != (after == _TRAIL))
    wrong |= (here == _SIGN) & (after != _SIGN) & (after != _GAP)
    bad = np.add.reduceat(np.append(wrong, False), starts, dtype=np.int64) > 0
    bad |= kind[starts] == _TRAIL
    first, last = kind[starts], kind[ends - 2]
    return ~bad, (first != _SIGN).astype(np.int64) + (last == _SIGN)


class Ids:
    """Token ids of texts by a tokenizer file, with the ids of words met kept by their hash.

    The tokenizer drops white space, never joins words and does not tell A to Z by case, so a
    text's ids are its words' ids. Words are told apart by 64 bits.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        sample = [self.tokenizer.encode(t, add_special_tokens=False).ids for t in ("ABC XYZ", "abc", " \t\nxyz")]
        if sample[0] != sample[1] + sample[2]:
            raise ValueError("this tokenizer tells upper from lower case or joins words")
        vocab = self.tokenizer.get_vocab()
        self.last = np.zeros(max(vocab.values()) + 1, dtype=bool)
        self.last[[i for token, i in vocab.items() if token.endswith("</w>")]] = True
        # A word's code is its place in order of arrival; its ids lie before the end of that place.
        self.hashes = np.zeros(1 << 16, dtype=np.uint64)
        self.ends = np.zeros((1 << 16) + 1, dtype=np.int64)
        self.ids = np.zeros(1 << 18, dtype=np.uint32)
        self.count = 0
        self._table(1 << 18)

    def _table(self, slots: int) -> None:
        """A table with the codes of all words kept, each at or after the slot of its hash."""
        self.mask = np.uint64(slots - 1)
        self.slots = np.full(slots, -1, dtype=np.int32)
        self._place(np.arange(self.count, dtype=np.int32))

    def _place(self, codes: np.ndarray) -> None:
        at = (self.hashes[codes] & self.mask).view(np.int64)
        while len(codes):
            free = self.slots.take(at) < 0
            # Of several words for one slot the last one written has it; the others go on.
            self.slots[at[free]] = codes[free]
            left = self.slots.take(at) != codes
            codes, at = codes[left], (at[left] + 1) & int(self.mask)

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Codes of words, -1 for those not kept."""
        at = (hashes & self.mask).view(np.int64)
        out = self.slots.take(at)
        left = np.flatnonzero((out >= 0) & (self.hashes.take(out) != hashes))
        while len(left):
            at[left] = (at[left] + 1) & int(self.mask)
            code = self.slots.take(at[left])
            out[left] = code
            left = left[(code >= 0) & (self.hashes.take(code) != hashes[left])]
        return out

    def shrink(self) -> None:
        """Forget all but the first words."""
        self.count = min(self.count, KEPT_WORDS)
        self._table(len(self.slots))

    def learn(self, words: list[bytes], hashes: np.ndarray) -> None:
        """Keep the ids of some words that are not kept."""
        if not words:
            return
        # Plain words go together in one call. Letters are one piece, signs after them another,
        # and the last id of a piece is the only one that marks an end.
        is_plain, n_pieces = plain_words(words)
        plain, n_pieces, own = list(compress(words, is_plain)), n_pieces[is_plain], hashes[is_plain]
        for a in range(0, len(plain), 5_000):
            some = plain[a: a + 5_000]
            ids = np.array(self.tokenizer.encode_batch_fast([b" ".join(some).decode()], add_special_tokens=False)[0].ids, dtype=np.uint32)
            ends = np.flatnonzero(self.last[ids]) + 1
            self._keep(own[a: a + 5_000], ids, ends[np.cumsum(n_pieces[a: a + 5_000]) - 1])
        rest, own = list(compress(words, ~is_plain)), hashes[~is_plain]
        for a in range(0, len(rest), 5_000):
            found = self.tokenizer.encode_batch_fast([w.decode() for w in rest[a: a + 5_000]], add_special_tokens=False)
            lists = [f.ids for f in found]
            ends = np.cumsum(np.fromiter(map(len, lists), np.int64, len(lists)))
            self._keep(own[a: a + 5_000], np.fromiter((i for ids in lists for i in ids), np.uint32, int(ends[-1])), ends)

    def _keep(self, hashes: np.ndarray, ids: np.ndarray, ends: np.ndarray) -> None:
        n, start = self.count, self.ends[self.count]
        while n + len(hashes) > len(self.hashes):
            self.hashes = np.concatenate([self.hashes, np.zeros_like(self.hashes)])
            self.ends = np.concatenate([self.ends, np.zeros(len(self.ends) - 1, np.int64)])
        while start + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        self.hashes[n: n + len(hashes)] = hashes
        self.ends[n + 1: n + 1 + len(hashes)] = start + ends
        self.ids[start: start + len(ids)] = ids
        self.count = n + len(hashes)
        if 2 * self.count > len(self.slots):
            self._table(2 * len(self.slots))
        else:
            self._place(np.arange(n, self.count, dtype=np.int32))

    def flat(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in one array, and the offsets of each text's; null is empty."""
        data, offsets = ragged.text_run(column)
        starts, ends, rows = ragged.word_bounds(data, offsets)
        hashes = ragged.word_hashes(data, starts, ends)
        codes = self.find(hashes)
        missing = np.flatnonzero(codes < 0)
        if len(missing):
            fresh, first = np.unique(hashes[missing], return_index=True)
            if self.count + len(fresh) > CACHE_WORDS:
                self.shrink()
                codes = self.find(hashes)
                missing = np.flatnonzero(codes < 0)
                fresh, first = np.unique(hashes[missing], return_index=True)
            whole, at = data.tobytes(), missing[first]
            self.learn([whole[a:b] for a, b in zip(starts[at].tolist(), ends[at].tolist(), strict=True)], fresh)
            codes[missing] = self.find(hashes[missing])
        begins = self.ends.take(codes)
        lengths = self.ends.take(codes + 1) - begins
        before = np.append(0, np.cumsum(lengths))
        out = self.ids.take(np.repeat(begins - before[:-1], lengths) + np.arange(before[-1]))
        return out, before[rows]

    def of(self, column: pa.Array) -> list[np.ndarray]:
        """Ids of each text."""
        ids, offsets = self.flat(column)
        return [ids[a:b] for a, b in pairwise(offsets.tolist())]


@lru_cache(maxsize=2)
def ids_of(path: str) -> Ids:
    return Ids(path)


PIECES = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
)


def packed(df: DataFrame, path: str, id_column: str = "doc_id", text: str = "text", with_ids: bool = False) -> DataFrame:
    """One row for each piece of each document in a sequence of at most ``WINDOW`` tokens.

    A document is its token ids and the id ``END``; null and empty texts are that id alone. Pieces
    of a document cover it without gaps. Windows are filled within each partition of the input,
    group by group, so nothing is shuffled and no task holds more than one group; sequence ids are
    unique and, for the same input files, the same in every run and retry. Repeated rows are packed
    again. ``with_ids`` adds each piece's ids.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = ids_of(path)
        context = TaskContext.get()
        sequence = (context.partitionId() if context else 0) << 33
        waiting: list[tuple] = []
        for batch in batches:
            for part in ragged.slices(batch, "text"):
                rows: list[tuple] = []
                for doc, ids in zip(part.column("doc_id").to_pylist(), tokens.of(part.column("text")), strict=True):
                    ids = np.append(ids, np.uint32(END)).astype("<u4")
                    start = 0
                    for length in cut(len(ids)):
                        own = ids[start: start + length]
                        piece = (doc, start, length, zlib.crc32(own.tobytes()), len(ids), own if with_ids else None)
                        start += length
                        if length == WINDOW:
                            rows.append((*piece, sequence, 0))
                            sequence += 1
                        else:
                            waiting.append(piece)
                while len(waiting) >= GROUP_PIECES:
                    some, sequence = _dealt(waiting[:GROUP_PIECES], sequence)
                    rows += some
                    del waiting[:GROUP_PIECES]
                if rows:
                    yield _batch(rows, with_ids)
        if waiting:
            yield _batch(_dealt(waiting, sequence)[0], with_ids)

    schema = PIECES + (", ids array<long>" if with_ids else "")
    return df.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, schema)


def _dealt(pieces: list[tuple], sequence: int) -> tuple[list[tuple], int]:
    """Pieces with their sequence and their offset there, and the next free sequence."""
    sizes = np.array([p[2] for p in pieces], dtype=np.int64)
    window = windows_of(sizes)
    # Windows without pieces are left out.
    used, window = np.unique(window, return_inverse=True)
    order = np.argsort(window, kind="stable")
    ordered = sizes[order]
    ends = np.cumsum(ordered)
    heads = np.r_[True, np.diff(window[order]) > 0]
    offsets = ends - ordered - np.maximum.accumulate(np.where(heads, ends - ordered, 0))
    rows = [(*pieces[i], sequence + int(window[i]), int(o)) for i, o in zip(order, offsets, strict=True)]
    return rows, sequence + len(used)


def _batch(rows: list[tuple], with_ids: bool) -> pa.RecordBatch:
    doc, start, length, crc, tokens, ids, sequence, offset = zip(*rows, strict=True)
    columns = [pa.array(c, pa.int64()) for c in (doc, start, length, crc, tokens, sequence, offset)]
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    if with_ids:
        columns.append(pa.array([i.astype(np.int64) for i in ids], pa.list_(pa.int64())))
        names.append("ids")
    return pa.RecordBatch.from_arrays(columns, names)
