"""Token counts of byte-level byte-pair encodings by merging whole arrays of pieces at once."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Distinct chunks of text whose counts one worker keeps; beyond that it starts anew.
CACHE_SIZE = 400_000
#: Bytes of the longest piece that is merged together with others in one array.
GROUP_BYTES = 1 << 20

# White space as the pre-tokenizer's \s has it, and the pre-tokenizer's pattern.
SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_NONE = np.int32(2**31 - 1)


class Merges:
    """The merge table of a tokenizer file, as sorted arrays.

    A pair of symbols is ``left * width + right``. Pairs lie in a table by a hash of that
    number; the few that find their slot taken are kept in a sorted list beside it.
    """

    SLOTS_LOG2 = 20

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in merges]
        self.width = np.int64(max(vocab.values()) + 1)
        left = np.array([vocab[a] for a, _ in pairs], dtype=np.int64)
        right = np.array([vocab[b] for _, b in pairs], dtype=np.int64)
        made = np.array([vocab[a + b] for a, b in pairs], dtype=np.int64)
        keys = left * self.width + right
        self.made = made.astype(np.int32)
        slot = self._slot(keys)
        _, first = np.unique(slot, return_index=True)
        later = np.setdiff1d(np.arange(len(keys)), first)
        self.slot_key = np.full(1 << self.SLOTS_LOG2, -1, dtype=np.int64)
        self.slot_rank = np.full(1 << self.SLOTS_LOG2, _NONE, dtype=np.int32)
        self.slot_key[slot[first]], self.slot_rank[slot[first]] = keys[first], first
        self.crowded = np.zeros(1 << self.SLOTS_LOG2, dtype=bool)
        self.crowded[slot[later]] = True
        later = later[np.argsort(keys[later])]
        self.more_keys, self.more_ranks = keys[later], later.astype(np.int32)
        self.bytes = np.array([vocab[c] for c in _byte_symbols()], dtype=np.int64)
        self.special = sorted(
            (t["content"] for t in spec.get("added_tokens", [])), key=len, reverse=True
        )

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        spread = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (spread >> np.uint64(64 - self.SLOTS_LOG2)).astype(np.int64)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair; pairs that never merge rank last."""
        keys = left * self.width + right
        slot = self._slot(keys)
        found = self.slot_key[slot] == keys
        ranks = np.where(found, self.slot_rank[slot], _NONE)
        rest = np.flatnonzero(self.crowded[slot] & ~found)
        if len(rest):
            at = np.minimum(np.searchsorted(self.more_keys, keys[rest]), len(self.more_keys) - 1)
            same = self.more_keys[at] == keys[rest]
            ranks[rest[same]] = self.more_ranks[at[same]]
        return ranks


def _byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(spare)) for b in range(256)]


@lru_cache(maxsize=4)
def merges_of(path: str) -> Merges:
    return Merges(path)


def count_symbols(table: Merges, data: bytes, lengths: np.ndarray) -> np.ndarray:
    """Number of tokens of each piece; the pieces follow each other in ``data``.

    All pieces lie in one array of symbols. In each step every piece that still has a pair of
    the table finds its lowest rank, and all places of that pair in it are merged at once, from
    left to right where they overlap. Pieces without such a pair leave the array.
    """
    counts = lengths.copy()
    symbols = table.bytes[np.frombuffer(data, dtype=np.uint8)]
    owner = np.repeat(np.arange(len(lengths)), lengths)
    rank = _pair_ranks(table, symbols, owner, np.arange(len(symbols)))
    while len(symbols):
        heads = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
        sizes = np.diff(np.r_[heads, len(owner)])
        least = np.minimum.reduceat(rank, heads)
        live = least < _NONE
        if not live.all():
            counts[owner[heads[~live]]] = sizes[~live]
            stay = np.repeat(live, sizes)
            symbols, owner, rank = symbols[stay], owner[stay], rank[stay]
            if not len(symbols):
                break
            least, sizes = least[live], sizes[live]
        # In a chain of places that touch (one symbol repeated) every second one merges.
        at = np.flatnonzero(rank == np.repeat(least, sizes))
        touch = np.diff(at) == 1
        if touch.any():
            nth = np.arange(len(at))
            nth -= np.maximum.accumulate(np.where(np.r_[True, ~touch], nth, 0))
            at = at[nth % 2 == 0]
        symbols[at] = table.made[rank[at]]
        stay = np.ones(len(symbols), dtype=bool)
        stay[at + 1] = False
        symbols, owner, rank = symbols[stay], owner[stay], rank[stay]
        # Only the pairs before and after a merged symbol change their rank.
        at -= np.arange(len(at))
        todo = np.concatenate([at, at[at > 0] - 1])
        rank[todo] = _pair_ranks(table, symbols, owner, todo)
    return counts


def _pair_ranks(table: Merges, symbols: np.ndarray, owner: np.ndarray, at: np.ndarray):
    """Ranks of the pairs that start at the places ``at``; none where a piece ends."""
    after = np.minimum(at + 1, max(len(symbols) - 1, 0))
    within = (owner[at] == owner[after]) & (after > at)
    return np.where(within, table.rank(symbols[at], symbols[after]), _NONE)


class Counter:
    """Counts tokens of texts; keeps the counts of chunks between white space.

    A chunk is a run without white space with the one space before it, or a run of white space.
    The pre-tokenizer never joins two chunks, so a text's count is the sum over its chunks.
    """

    def __init__(self, path: str):
        self.table = merges_of(path)
        self.chunks = re.compile(f" ?[^{SPACE}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")
        self.pieces = regex.compile(PIECES)
        self.known: dict[str, int] = {}

    def learn(self, chunks: list[str]) -> None:
        """Count new chunks. Joined by line feeds they are cut into pieces in one pass."""
        blank = [c for c in chunks if c.isspace()]
        if blank:
            data = [c.encode() for c in blank]
            counts = self.count_pieces(b"".join(data), np.array([len(d) for d in data]))
            self.known.update(zip(blank, counts.tolist(), strict=True))
            chunks = [c for c in chunks if not c.isspace()]
        if not chunks:
            return
        joined = "\n".join(chunks)
        pieces = self.pieces.findall(joined)
        if not joined.isascii():
            pieces = map(str.encode, pieces)
        lengths = np.fromiter(map(len, pieces), dtype=np.int64)
        data = joined.encode()
        counts = self.count_pieces(data, lengths)
        starts = np.cumsum(lengths) - lengths
        breaks = np.flatnonzero(np.frombuffer(data, dtype=np.uint8)[starts] == 10)
        counts[breaks] = 0
        totals = np.add.reduceat(counts, np.r_[0, breaks])
        self.known.update(zip(chunks, totals.tolist(), strict=True))

    def count_pieces(self, data: bytes, lengths: np.ndarray) -> np.ndarray:
        """Tokens of pieces that follow each other in ``data``, in groups of bounded size."""
        ends = np.cumsum(lengths)
        cuts = np.flatnonzero(np.diff((ends - lengths) // GROUP_BYTES)) + 1
        out = []
        for a, b in zip(np.r_[0, cuts], np.r_[cuts, len(lengths)], strict=True):
            part = data[int(ends[a] - lengths[a]): int(ends[b - 1])]
            out.append(count_symbols(self.table, part, lengths[a:b]))
        return np.concatenate(out)

    def count(self, texts: list[str | None]) -> list[int]:
        """Tokens of each text; a special string counts one, null and empty texts none."""
        rows, extra = [], []
        for text in texts:
            parts, special = [text or ""], 0
            for token in self.table.special:
                if token in parts[0] or special:
                    split = [part.split(token) for part in parts]
                    special += sum(len(s) - 1 for s in split)
                    parts = [x for s in split for x in s]
            own = self.chunks.findall(parts[0])
            for part in parts[1:]:
                own += self.chunks.findall(part)
            rows.append(own)
            extra.append(special)
        chunks = set().union(*rows)
        fresh = chunks.difference(self.known)
        if len(self.known) + len(fresh) > CACHE_SIZE:
            self.known.clear()
            fresh = chunks
        if fresh:
            self.learn(list(fresh))
        known = self.known.__getitem__
        return [sum(map(known, row)) + n for row, n in zip(rows, extra, strict=True)]


@lru_cache(maxsize=2)
def counter_of(path: str) -> Counter:
    return Counter(path)


def token_counts(df: DataFrame, path: str, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id``, ``n_bytes`` (UTF-8) and ``n_tokens`` of every row of ``df``.

    ``path`` names a byte-level BPE file that every executor can open (it is part of an
    installed package). Null and empty texts have 0 bytes and tokens; rows are neither joined
    nor dropped, so repeated rows stay; other columns are left aside.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from dossier.llm.ragged import slices

        counter = counter_of(path)
        for batch in batches:
            for part in slices(batch, "text"):
                texts = part.column("text").to_pylist()
                yield pa.RecordBatch.from_pydict({
                    "doc_id": part.column("doc_id"),
                    "n_bytes": part.column("n_bytes"),
                    "n_tokens": pa.array(counter.count(texts), pa.int64()),
                })

    given = df.select(
        F.col(id_column).cast("long").alias("doc_id"),
        F.col(text).alias("text"),
        F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"),
    )
    schema = T.StructType([
        T.StructField("doc_id", T.LongType()),
        T.StructField("n_bytes", T.LongType()),
        T.StructField("n_tokens", T.LongType()),
    ])
    return given.mapInArrow(run, schema)
