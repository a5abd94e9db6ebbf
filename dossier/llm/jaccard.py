"""Exact Jaccard join of shingle sets: segment keys, then T-occurrence search within blocks.

Two sets that are alike enough differ in few shingles. Cut by hash into more segments than that,
they agree on whole segments, so equal segment keys find every candidate. Sets that keys connect
form a block, where that is too large those whose pairs share enough keys; within a block the
inverted lists are searched for the sets that occur often enough (DivideSkip: short lists merged,
long lists probed), which verifies every link exactly.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dossier.llm import ragged
from dossier.llm.common import freed, settled
from dossier.llm.graph import components

#: Shingles of all sets that one block holds, unless one set alone has more.
BLOCK_SHINGLES = 250_000
#: Sets with the most shared keys of a component; all its blocks hold them.
HUBS = 8
#: Sets of a key whose pairs are counted, at most; and pairs for each row of keys, at most.
KEY_SETS = 64
KEY_PAIRS = 2
#: Shingles that blocks in pairs hold at a time, as a multiple of those of all sets.
ROUND_COPIES = 2
#: Bits of the filter on ids that spares most other texts the second look; a fixed size.
FILTER_BITS = 1 << 22
#: Above any number of keys that must be shared, as it is kept beside the level; more is not asked.
NEED_LIMIT = 1 << 20
#: Weight of a probe against a merge step when lists are divided into short and long ones.
PROBE_WEIGHT = 0.01
#: Sets of a block after which freed memory is given back; most blocks are of a few sets.
RELEASE_ROWS = 100
_GROWTH = 1.5


@dataclass(frozen=True)
class Rule:
    """Sets link when ``whole * intersection >= part * union``; shingles have ``words`` words."""

    words: int = 5
    part: int = 4
    whole: int = 5

    def overlap(self, total):
        """Least intersection of two sets whose sizes add up to ``total``."""
        return -(-self.part * total // (self.part + self.whole))

    def least(self, size):
        """Least size of a set that can link to one of ``size``."""
        return -(-self.part * size // self.whole)

    def level(self, size: int) -> int:
        """Sizes fall into levels; both sets of a pair use the level of the larger one."""
        return int(math.log(size) / math.log(_GROWTH)) if size > 1 else 0

    def segments(self, level: int) -> tuple[int, int]:
        """Number of segments at a level, and how many of them two linked sets share at least."""
        top = math.ceil(_GROWTH ** (level + 1)) + 1
        differ = 2 * top * (self.whole - self.part) // (self.whole + self.part)
        equal = 1 + (-(-(differ + 1) // 5) if differ else 0)
        return differ + equal, equal


def shingle_sets(column: pa.Array, rule: Rule) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each text's distinct shingles in ascending order, their offsets, and a hash of the set."""
    data, offsets = ragged.text_run(column)
    starts, ends, rows = ragged.word_bounds(data, offsets)
    words = ragged.word_hashes(data, starts, ends)
    values, bounds = ragged.distinct_in_rows(*ragged.shingle_hashes(words, rows, rule.words))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(ragged.mix(values ^ np.uint64(0x5DEECE66D)))])
    sign = ragged.mix(sums[bounds[1:]] - sums[bounds[:-1]] + np.diff(bounds).astype(np.uint64))
    return values, bounds, sign


def segment_keys(values: np.ndarray, rule: Rule) -> tuple[np.ndarray, np.ndarray]:
    """Keys of one set, and for each key a code: its level and how many keys of it must be shared.

    A shingle that only one of two sets has spoils one segment, so two linked sets share at least
    the number of segments that ``Rule.segments`` names. Empty segments are left out and taken off
    that number; only a set with so many of them that nothing would be left has keys for them
    too. Sets of the smallest levels link to equal sets only and have no keys.
    """
    size = len(values)
    keys, codes = [np.zeros(0, np.uint64)], [np.zeros(0, np.int32)]
    if not size:
        return keys[0], codes[0]
    mixed = np.concatenate([np.zeros(1, np.uint64), np.cumsum(ragged.mix(values))])
    for level in range(rule.level(size), rule.level(size * rule.whole // rule.part) + 1):
        count, equal = rule.segments(level)
        if count == 1:
            continue
        segment = (((values >> np.uint64(32)) * np.uint64(count)) >> np.uint64(32)).astype(np.int64)
        sizes = np.bincount(segment, minlength=count)
        ends = np.cumsum(sizes)
        place = np.arange(count, dtype=np.uint64) + (np.uint64(level) << np.uint64(40))
        own = ragged.mix(mixed[ends] - mixed[ends - sizes] + ragged.mix(place))
        need = equal - int((sizes == 0).sum())
        if need > 0:
            own = own[sizes > 0]
        keys.append(own)
        codes.append(np.full(len(own), level * NEED_LIMIT + min(max(need, 1), NEED_LIMIT - 1), np.int32))
    return np.concatenate(keys), np.concatenate(codes)


def _lists(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(values.view(np.int64)))


def signatures(df: DataFrame, rule: Rule, with_keys: bool = True) -> DataFrame:
    """``doc_id, n_shingles, sign, keys, codes`` of every row; a text without words has no shingles.

    Without keys these are null: they are large, and cheaper to find again than to store.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in ragged.slices(batch, "text"):
                values, bounds, sign = shingle_sets(part.column("text"), rule)
                if not with_keys:
                    none = pa.nulls(part.num_rows, pa.list_(pa.int64()))
                    yield pa.RecordBatch.from_arrays([
                        part.column("doc_id"), pa.array(np.diff(bounds)), pa.array(sign.view(np.int64)),
                        none, none.cast(pa.list_(pa.int32())),
                    ], ["doc_id", "n_shingles", "sign", "keys", "codes"])
                    continue
                pairs = [segment_keys(values[a:b], rule) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
                ends = np.concatenate([[0], np.cumsum([len(k) for k, _ in pairs])]).astype(np.int32)
                keys, codes = (np.concatenate(c) for c in zip(*pairs, strict=True))
                yield pa.RecordBatch.from_arrays([
                    part.column("doc_id"), pa.array(np.diff(bounds)), pa.array(sign.view(np.int64)),
                    _lists(keys, ends), pa.ListArray.from_arrays(pa.array(ends), pa.array(codes)),
                ], ["doc_id", "n_shingles", "sign", "keys", "codes"])

    return df.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        run, "doc_id long, n_shingles long, sign long, keys array<long>, codes array<int>"
    )


class Block:
    """Inverted lists over some sets, searched for sets that share enough shingles."""

    def __init__(self, sizes: np.ndarray, values: np.ndarray, bounds: np.ndarray, rule: Rule):
        """Sets must come in ascending order of size; ``values[bounds[i]:bounds[i + 1]]`` is set i."""
        self.sizes, self.rule = sizes, rule
        # Positions take 32 bits: a block is far smaller, unless one text alone is not.
        kind = np.int32 if len(values) < 2**31 else np.int64
        order = np.argsort(values, kind="stable").astype(kind)
        self.owners = np.repeat(np.arange(len(sizes), dtype=kind), np.diff(bounds))[order]
        ordered = values[order]
        heads = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]]) if len(values) else np.zeros(0, int)
        del ordered
        starts = np.repeat(heads, np.diff(np.r_[heads, len(values)])).astype(kind)
        # For each shingle of each set: where its list starts and how many earlier sets are on it.
        self.start = np.empty(len(values), dtype=kind)
        self.before = np.empty(len(values), dtype=kind)
        self.start[order] = starts
        self.before[order] = np.arange(len(values), dtype=kind) - starts
        self.bounds = bounds

    def search(self, i: int, allowed: np.ndarray) -> np.ndarray:
        """Earlier sets, of those allowed, that link to set i."""
        a, b = self.bounds[i], self.bounds[i + 1]
        low = int(np.searchsorted(self.sizes, self.rule.least(int(self.sizes[i]))))
        need = self.rule.overlap(int(self.sizes[i] + self.sizes[min(low, i)]))
        lengths = self.before[a:b]
        some = np.flatnonzero(lengths)
        if len(some) < need or low >= i or not allowed[low:i].any():
            return np.zeros(0, dtype=np.int64)
        by_length = some[np.argsort(lengths[some], kind="stable")]
        starts, lengths = self.start[a:b][by_length], lengths[by_length]
        long = min(need - 1, int(need / (PROBE_WEIGHT * math.log2(int(lengths[-1]) + 1) + 1)))
        short = len(by_length) - long
        # The short lists, merged in one pass: how often each earlier set stands on them.
        n = lengths[:short].astype(np.int64)
        at = np.repeat(starts[:short] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        counts = np.bincount(self.owners[at], minlength=i)[:i]
        found = np.flatnonzero((counts >= max(need - long, 1)) & allowed[:i])
        found = found[found >= low]
        counts = counts[found]
        needs = self.rule.overlap(self.sizes[i] + self.sizes[found])
        # Each long list is probed for the sets that can still reach their overlap.
        for k in range(long):
            alive = counts + (long - k) >= needs
            if not alive.all():
                found, counts, needs = found[alive], counts[alive], needs[alive]
            if not len(found):
                break
            s, m = starts[short + k], lengths[short + k]
            own = self.owners[s: s + m]
            place = np.minimum(np.searchsorted(own, found), m - 1)
            counts = counts + (own[place] == found)
        hit = counts >= needs
        return found[hit][np.argsort(-counts[hit], kind="stable")]

    def links(self, cluster: np.ndarray, chunk: np.ndarray | None = None) -> list[tuple[int, int]]:
        """Links that join clusters, enough of them to connect all sets that links connect.

        Sets of one cluster count as connected already. With ``chunk`` only pairs of different
        chunks are searched, the others having been searched before.
        """
        cluster, out = cluster.copy(), []
        for i in range(len(self.sizes)):
            allowed = cluster != cluster[i]
            if chunk is not None:
                allowed &= chunk != chunk[i]
            for j in self.search(i, allowed):
                if cluster[j] != cluster[i]:
                    out.append((i, int(j)))
                    cluster[cluster == cluster[j]] = cluster[i]
        return out


def _block_links(rule: Rule, across: bool):
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("n_shingles", "ascending"), ("sign", "ascending"), ("chunk", "ascending")])
        lists = table["values"].combine_chunks()
        bounds = np.concatenate([[0], np.cumsum(np.diff(lists.offsets.to_numpy()))])
        sign = table["sign"].to_numpy()
        block = Block(table["n_shingles"].to_numpy(), lists.flatten().to_numpy(), bounds, rule)
        _, cluster = np.unique(table["cluster"].to_numpy(), return_inverse=True)
        links = block.links(cluster, table["chunk"].to_numpy() if across else None)
        del block, lists
        a, b = (sign[[p[k] for p in links]] if links else np.zeros(0, np.int64) for k in (0, 1))
        out = pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})
        if table.num_rows > RELEASE_ROWS:
            del table
            ragged.release()
        return out

    return run


def _sets(df: DataFrame, members: DataFrame, rule: Rule) -> DataFrame:
    """``sign, values`` of the members (``sign, doc_id``), from a second look at their texts.

    A filter of fixed size keeps most other texts from the shuffle.
    """
    bits = np.zeros(FILTER_BITS, dtype=bool)
    places = members.select(F.pmod(F.xxhash64("doc_id"), F.lit(FILTER_BITS)).cast("int").alias("p")).distinct()
    bits[places.toArrow()["p"].to_numpy()] = True
    shared = df.sparkSession.sparkContext.broadcast(np.packbits(bits))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = np.unpackbits(shared.value).astype(bool)
        for batch in batches:
            kept = batch.filter(pa.array(wanted[batch.column("place").to_numpy()]))
            for part in ragged.slices(kept, "text"):
                values, bounds, sign = shingle_sets(part.column("text"), rule)
                yield pa.RecordBatch.from_arrays([
                    part.column("doc_id"), pa.array(sign.view(np.int64)), _lists(values, bounds),
                ], ["doc_id", "sign", "values"])

    placed = df.filter("doc_id is not null").select(
        F.col("doc_id").cast("long").alias("doc_id"), "text",
        F.pmod(F.xxhash64(F.col("doc_id").cast("long")), F.lit(FILTER_BITS)).cast("int").alias("place"),
    )
    sets = placed.mapInArrow(run, "doc_id long, sign long, values array<long>")
    return sets.join(members.select("doc_id", "sign"), ["doc_id", "sign"]).select("sign", "values")


def near_duplicates(df: DataFrame, rule: Rule = Rule()) -> DataFrame:
    """``doc_id, n_shingles, component_id`` of every row of ``df``.

    ``component_id`` is the least ``doc_id`` that links reach. Null texts and texts without words
    have no shingles and are linked with nothing. Repeated rows stay; a row without id takes part
    through its text only if another row has the same text and an id. Other columns are left aside.
    """
    rows = settled(signatures(df, rule, with_keys=False).drop("keys", "codes"))
    sets = settled(
        rows.filter("n_shingles > 0").groupBy("sign")
        .agg(F.min("doc_id").alias("doc_id"), F.first("n_shingles").alias("n_shingles"))
        .filter("doc_id is not null")
    )
    keys = (
        signatures(df, rule).filter("n_shingles > 0").groupBy("sign")
        .agg(F.first("keys").alias("keys"), F.first("codes").alias("codes"))
    )
    shared = settled(_shared_keys(keys))
    freed(df.sparkSession)
    linked = _links(df, sets, shared, rule)
    names = linked.join(sets.select(F.col("sign").alias("node"), "doc_id"), "node").groupBy("component").agg(
        F.min("doc_id").alias("component_id")
    )
    named = (
        sets.select("sign", F.col("doc_id").alias("own"))
        .join(linked.select(F.col("node").alias("sign"), "component"), "sign", "left")
        .join(names, "component", "left").select("sign", F.coalesce("component_id", "own").alias("component_id"))
    )
    some = rows.filter("n_shingles > 0").select("doc_id", "n_shingles", "sign").join(named, "sign", "left")
    none = rows.filter("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return some.select("doc_id", "n_shingles", "component_id").unionAll(none)


def _shared_keys(sets: DataFrame) -> DataFrame:
    """``sign, key, code, hub, n`` of keys that several sets have; ``hub`` is the least of these sets.

    A set that shares too few keys of a level with all others together links to none of them
    there. Leaving its keys out can leave others with too few, hence a second round.
    """
    by_key = Window.partitionBy("key")
    keys = sets.select("sign", F.explode(F.arrays_zip("keys", "codes")).alias("k")).select(
        "sign", F.col("k.keys").alias("key"), F.col("k.codes").alias("code")
    )
    # Most keys are of one set: what moved them all is given back before the rest moves.
    shared = settled(keys.withColumn("n", F.count("*").over(by_key)).filter("n > 1"))
    freed(sets.sparkSession)
    for _ in range(2):
        found = F.count("*").over(Window.partitionBy("sign", "code"))
        shared = shared.withColumn("found", found).filter(f"found >= code % {NEED_LIMIT}")
        shared = shared.withColumn("n", F.count("*").over(by_key)).filter("n > 1")
    return shared.select("sign", "key", "code", F.min("sign").over(by_key).alias("hub"), "n")


def _narrow_edges(keys: DataFrame) -> DataFrame:
    """``a, b``: edges that connect all sets that can link, far fewer than common keys do.

    ``keys`` are ``sign, key, code, n`` as ``_shared_keys`` gives them. Two sets that link share as
    many keys of a level as either must. Keys of few sets are counted pair by pair; of all others
    two sets share no more than either has. A set that has enough of these alone is joined to the
    least such set on each. How many sets are few follows from how many pairs there would be.
    """
    total = keys.count()
    sizes = keys.filter(F.col("n") <= KEY_SETS).groupBy("n").agg(F.count("*").alias("rows")).collect()
    few, pairs = 1, 0.0
    for n, rows in sorted((r["n"], r["rows"]) for r in sizes):
        pairs += rows * (n - 1) / 2
        if pairs > KEY_PAIRS * total:
            break
        few = n
    often = F.sum((F.col("n") > few).cast("int")).over(Window.partitionBy("sign", "code")).cast("int")
    keys = keys.withColumn("often", often)
    on = (
        keys.filter(F.col("n") <= few).groupBy("key")
        .agg(F.sort_array(F.collect_list(F.struct("sign", "code", "often"))).alias("on"))
    )
    each = on.select(F.posexplode("on").alias("i", "x"), "on").select(
        "x", F.explode(F.slice("on", F.col("i") + 2, F.size("on"))).alias("y")
    )
    counted = each.groupBy(
        F.col("x.sign").alias("a"), F.col("y.sign").alias("b"),
        F.greatest("x.code", "y.code").alias("code"), F.least("x.often", "y.often").alias("often"),
    ).agg(F.count("*").alias("k"))
    pairs = counted.filter(f"k + often >= code % {NEED_LIMIT}").select("a", "b")
    common = keys.filter((F.col("n") > few) & F.expr(f"often >= code % {NEED_LIMIT}")).select("key", "sign")
    least = common.groupBy("key").agg(F.min("sign").alias("b"))
    return pairs.unionAll(common.join(least, "key").select(F.col("sign").alias("a"), "b"))


def _cut(members: DataFrame) -> DataFrame:
    """``members`` with ``chunk``: the block of each set, in order of size within its component."""
    ordered = Window.partitionBy("component").orderBy("n_shingles", "sign")
    before = F.sum("n_shingles").over(ordered.rowsBetween(Window.unboundedPreceding, 0)) - F.col("n_shingles")
    return members.withColumn("chunk", F.floor(before / BLOCK_SHINGLES))


def _large(members: DataFrame) -> DataFrame:
    """``component, last`` of the components of several blocks."""
    return members.groupBy("component").agg(F.max("chunk").alias("last")).filter("last > 0")


def _members(sets: DataFrame, shared: DataFrame) -> DataFrame:
    """``component, sign, doc_id, n_shingles, weight, chunk`` of the sets that may link with another."""
    coarse = components(shared.select(F.col("sign").alias("a"), F.col("hub").alias("b")))
    weight = shared.groupBy(F.col("sign").alias("node")).agg(F.sum("n").alias("weight"))
    columns = ["component", "sign", "doc_id", "n_shingles", "weight"]
    members = settled(_cut(
        coarse.join(weight, "node").join(sets.withColumnRenamed("sign", "node"), "node")
        .withColumnRenamed("node", "sign").select(*columns)
    ))
    large = _large(members)
    if large.isEmpty():
        return members
    # Few shared keys connect ever more sets as there are more of them: these are looked at closely.
    wide = members.join(large.select("component"), "component", "left_semi").drop("component", "chunk")
    narrow = components(_narrow_edges(shared.join(wide.select("sign"), "sign").select("sign", "key", "code", "n")))
    close = wide.join(narrow.withColumnRenamed("node", "sign"), "sign").select(*columns)
    small = members.join(large.select("component"), "component", "left_anti")
    members = settled(small.unionByName(_cut(close)))
    freed(members.sparkSession)
    return members


def _links(df: DataFrame, sets: DataFrame, shared: DataFrame, rule: Rule) -> DataFrame:
    """``node, component`` of the sets that links connect with another, by their hash."""
    members = _members(sets, shared)
    values = settled(_sets(df, members, rule))
    large = _large(members)
    central = (
        members.join(large, "component")
        .withColumn("r", F.row_number().over(Window.partitionBy("component").orderBy(F.desc("weight"), "sign")))
        .filter(f"r <= {HUBS}")
        .select("component", "sign", "n_shingles", F.explode(F.sequence(F.lit(0).cast("long"), "last")).alias("chunk"))
    )
    inside = members.select("component", "sign", "n_shingles", "chunk").unionByName(central).distinct()
    first = settled(_searched(inside.withColumn("cluster", F.col("sign")), values, ["component", "chunk"], rule, False))
    # Components of several blocks whose blocks and hubs did not connect them: blocks in pairs.
    clusters = components(first)
    apart = (
        members.join(large, "component")
        .join(clusters.select(F.col("node").alias("sign"), F.col("component").alias("cluster")), "sign", "left")
        .withColumn("cluster", F.coalesce("cluster", "sign"))
    )
    mixed = apart.groupBy("component").agg(F.countDistinct("cluster").alias("k")).filter("k > 1").select("component")
    apart = settled(apart.join(mixed, "component"))
    pairs = settled(_pairs(apart, rule))
    total = pairs.agg(F.sum("shingles")).first()[0]
    if total is None:
        return clusters
    # A block is sent once for each pair: in rounds, so that not all these copies are there at once.
    rounds = math.ceil(total / (ROUND_COPIES * members.agg(F.sum("n_shingles")).first()[0]))
    links = first
    for r in range(rounds):
        turn = pairs.filter(F.pmod(F.xxhash64("component", "low", "high"), F.lit(rounds)) == r)
        sides = turn.select("component", "low", "high", F.explode(F.array("low", "high")).alias("chunk"))
        # No name keeps the unsettled table, else its copies stayed.
        links = links.unionAll(settled(
            _searched(apart.join(sides, ["component", "chunk"]), values, ["component", "low", "high"], rule, True)
        ))
        freed(df.sparkSession)
    return components(links)


def _pairs(members: DataFrame, rule: Rule) -> DataFrame:
    """``component, low, high, shingles``: blocks of a component in pairs, where sets of both may link by size."""
    blocks = members.groupBy("component", "chunk").agg(
        F.min("n_shingles").alias("least"), F.max("n_shingles").alias("most"), F.sum("n_shingles").alias("own")
    )
    low = blocks.select("component", F.col("chunk").alias("low"), "most", F.col("own").alias("of_low"))
    high = blocks.select("component", F.col("chunk").alias("high"), "least", "own")
    near = F.col("most") * rule.whole >= F.col("least") * rule.part
    return low.join(high, "component").filter((F.col("low") < F.col("high")) & near).select(
        "component", "low", "high", (F.col("of_low") + F.col("own")).alias("shingles")
    )


def _searched(members: DataFrame, values: DataFrame, block: list[str], rule: Rule, across: bool) -> DataFrame:
    rows = members.join(values, "sign").select(*block, *[c for c in ("chunk",) if c not in block], "sign", "n_shingles", "cluster", "values")
    return rows.groupBy(*block).applyInArrow(_block_links(rule, across), "a long, b long")
