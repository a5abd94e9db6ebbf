"""Shards of near equal bytes: a k-d tree over metadata, split at distributed weighted medians."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dossier.llm.common import settled

#: Bits of a coordinate in a key; below them those of a hash of the text, which keep equal texts side by
#: side, and last those of a hash of text and id, by which a text too large for a cut is divided.
VALUE_BITS, TEXT_BITS, ROW_BITS = 24, 14, 24
TIE_BITS = TEXT_BITS + ROW_BITS
#: Bits that one pass over the rows settles; it collects at most this many sums a node.
PASS_BITS = 11
#: A cut is good enough once the rows it cannot tell apart have this share of the node's bytes.
NEAR = 1 / 4000
#: Rows of a shard that are numbered together, about.
SLOT_ROWS = 20_000

DIMENSIONS = ("x_size", "x_lang", "x_source", "x_id")


@dataclass
class Node:
    """A part of the tree: its leaves, and once it is split the dimension and key of the cut."""

    leaves: int
    first: int = 0
    dimension: str = ""
    cut: int = 0
    left: Node | None = None
    right: Node | None = None


def coordinates(df: DataFrame) -> DataFrame:
    """``doc_id, size, text_crc32, sign, tie`` and the coordinates of every row.

    Equal texts have equal coordinates, those of their least source, language and id, and ties that
    differ in the last bits only. The size counts on a log scale, categories by their hash, which
    keeps equal ones together.
    """
    text = F.coalesce("text", F.lit(""))

    def place(column: str) -> Column:
        if column not in df.columns:
            return F.lit(0.0)
        value = F.col(column).cast("string").cast("binary")
        return F.coalesce(F.crc32(value), F.lit(0)) / F.lit(float(1 << 32))

    rows = settled(df.select(
        F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("sign"),
        place("lang").alias("lang"), place("source").alias("source"),
    ))
    groups = rows.groupBy("sign", "text_crc32").agg(
        F.min("lang").alias("x_lang"), F.min("source").alias("x_source"),
        F.coalesce(F.min("doc_id"), F.lit(0)).cast("double").alias("x_id"),
    )
    tie = F.shiftleft(F.shiftrightunsigned("sign", 64 - TEXT_BITS), ROW_BITS).bitwiseOR(
        F.shiftrightunsigned(F.xxhash64("sign", "doc_id"), 64 - ROW_BITS)
    )
    return rows.drop("lang", "source").join(groups, ["sign", "text_crc32"]).withColumns({"x_size": F.log1p("size"), "tie": tie})


def _key(dimension: str, low: float, high: float) -> Column:
    """The coordinate in ``VALUE_BITS`` bits before the bits of the tie."""
    scaled = (F.col(dimension) - low) / (high - low if high > low else 1.0)
    value = F.floor(scaled * float((1 << VALUE_BITS) - 1)).cast("long")
    return F.shiftleft(value, TIE_BITS).bitwiseOR(F.col("tie"))


def _chosen(nodes: list[tuple[int, Node]], bounds: dict) -> Column:
    """For each row the key in the dimension of its open node."""
    key = F.lit(None).cast("long")
    for at, node in nodes:
        key = F.when(F.col("node") == at, _key(node.dimension, *bounds[node.dimension])).otherwise(key)
    return key


def divided(rows: DataFrame, shards: int) -> tuple[DataFrame, Node]:
    """Rows with coordinates, ``size`` and ``tie`` with their ``shard`` added, and the tree.

    All nodes of a depth are split together. A pass sums the bytes of each node by the next bits
    of the keys, so what reaches the driver depends on the number of nodes and bits only; passes
    go on until the cut is near the wanted share of bytes or all bits are used.
    """
    wide = rows.agg(*[f(d) for d in DIMENSIONS for f in (F.min, F.max)]).first()
    bounds = {d: (wide[2 * k] or 0.0, wide[2 * k + 1] or 0.0) for k, d in enumerate(DIMENSIONS)}
    root = Node(shards)
    level = {1: root}
    rows = rows.withColumn("node", F.lit(1).cast("long")).withColumn("shard", F.lit(0 if shards == 1 else None).cast("int"))
    while open_nodes := [(at, n) for at, n in level.items() if n.leaves > 1]:
        seen = {r["node"]: r for r in rows.filter("shard is null").groupBy("node").agg(
            F.sum("size").alias("bytes"), *[f(d).alias(f"{n}_{d}") for d in DIMENSIONS for n, f in (("min", F.min), ("max", F.max))]
        ).collect()}
        for at, node in open_nodes:
            row = seen.get(at)

            def extent(d: str, row=row) -> float:
                span = bounds[d][1] - bounds[d][0]
                return 0.0 if row is None or not span else (row[f"max_{d}"] - row[f"min_{d}"]) / span

            node.dimension = max(DIMENSIONS, key=extent)
        rows = settled(rows.withColumn("key", _chosen(open_nodes, bounds)))
        _cut(rows.filter("shard is null"), open_nodes, {at: r["bytes"] for at, r in seen.items()})
        level, side, shard = {}, F.col("node"), F.col("shard")
        for at, node in open_nodes:
            node.left = Node(node.leaves // 2, node.first)
            node.right = Node(node.leaves - node.leaves // 2, node.first + node.leaves // 2)
            level |= {2 * at: node.left, 2 * at + 1: node.right}
            side = F.when(F.col("node") == at, 2 * F.col("node") + (F.col("key") >= F.lit(node.cut).cast("long")).cast("long")).otherwise(side)
        for at, node in level.items():
            if node.leaves == 1:
                shard = F.when(F.col("node") == at, F.lit(node.first)).otherwise(shard)
        # The new node is a column of its own before the shard is told from it.
        rows = rows.withColumn("node", F.when(F.col("shard").isNull(), side).otherwise(F.col("node"))).drop("key")
        rows = settled(rows).withColumn("shard", shard)
    return rows.drop("node"), root


def _step(bits: int) -> int:
    """Bits left after a pass; one of them ends where the bits of the rows begin."""
    return max(ROW_BITS if bits > ROW_BITS else 0, bits - PASS_BITS)


def _cut(rows: DataFrame, nodes: list[tuple[int, Node]], weight: dict[int, int]) -> None:
    """Find the key at which each node's left part has its share of the node's bytes."""
    open_at = {at: [0, VALUE_BITS + TIE_BITS, 0] for at, _ in nodes if weight.get(at)}
    by_at = dict(nodes)
    while open_at:
        start, shift = F.lit(None).cast("long"), F.lit(None).cast("int")
        for at, (base, bits, _) in open_at.items():
            step = _step(bits)
            start = F.when((F.col("node") == at) & (F.shiftright("key", bits) == base >> bits), F.lit(base).cast("long")).otherwise(start)
            shift = F.when(F.col("node") == at, F.lit(step)).otherwise(shift)
        sums = (
            rows.withColumn("start", start).filter("start is not null").withColumn("shift", shift)
            .groupBy("node", F.expr("shiftright(key - start, shift)").alias("digit")).agg(F.sum("size").alias("bytes"))
            .toArrow().sort_by([("node", "ascending"), ("digit", "ascending")]).to_pylist()
        )
        found: dict[int, list[tuple[int, int]]] = {}
        for row in sums:
            found.setdefault(row["node"], []).append((row["digit"], row["bytes"]))
        for at in list(open_at):
            base, bits, before = open_at[at]
            step = _step(bits)
            node, total = by_at[at], weight[at]
            wanted = total * (node.leaves // 2) / node.leaves
            for digit, size in found[at]:
                if before + size >= wanted:
                    break
                before += size
            edge = base + (digit << step)
            if step and size > total * NEAR:
                open_at[at] = [edge, step, before]
                continue
            # The rows of this digit go to the side that leaves the smaller error.
            node.cut = edge if wanted - before <= before + size - wanted else edge + (1 << step)
            del open_at[at]


def sharded(df: DataFrame, shards: int | None = 16, target_bytes: int | None = None) -> DataFrame:
    """``doc_id, size, text_crc32, shard, slot`` of every row of ``df``.

    ``size`` is the text's UTF-8 bytes plus one (null: one). The tree has ``shards`` leaves, or as
    many as bring each to ``target_bytes``. Leaves have near equal bytes. Rows of equal texts stay
    in one shard unless a cut falls among them and they are too large for either side; then the
    cut divides them by a hash of the id. So a cut tears one text at most, whatever the size of the
    table, but for texts whose hashes agree in their first bits.
    ``slot`` numbers the rows of a shard from 0 without gaps. Rows without id, with null texts or
    repeated are placed like others; an empty table gives an empty result.
    """
    placed = coordinates(df)
    total = df.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 1)).first()[0] or 0
    if target_bytes:
        shards = max(1, -(-total // target_bytes))
    rows = divided(settled(placed), shards)[0].select("doc_id", "size", "text_crc32", "sign", "shard")
    return numbered(rows, "shard").drop("sign")


def numbered(rows: DataFrame, group: str) -> DataFrame:
    """Add ``slot``, the number of each row within its group, from 0; large groups in parts."""
    most = rows.groupBy(group).count().agg(F.max("count")).first()[0] or 0
    parts = max(1, most // SLOT_ROWS)
    rows = rows.withColumn("_part", F.pmod(F.xxhash64("doc_id", "sign"), F.lit(parts)))
    order = Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, 0)
    starts = rows.groupBy(group, "_part").agg(F.count("*").alias("_n"))
    starts = starts.withColumn("_start", F.sum("_n").over(order) - F.col("_n")).drop("_n")
    within = F.row_number().over(Window.partitionBy(group, "_part").orderBy("doc_id", "sign"))
    return (
        rows.withColumn("_within", within - 1).join(starts, [group, "_part"])
        .withColumn("slot", (F.col("_start") + F.col("_within")).cast("long")).drop("_start", "_within", "_part")
    )
