"""Merkle manifest of a table: hash trees by group, stored in van Emde Boas layout.

The leaves of a group are cut into aligned subtrees of at most ``2**HEIGHT`` leaves. Each subtree
is one block: an array of digests in which a subtree is stored as its top half, then its bottom
halves one after another, each again in that way, so that a path from a leaf upwards touches few
places whatever the size of a cache line. Where a node lies follows from its depth and number alone. The
roots of the blocks are the leaves of the next tier, until one block is left for each group; the
roots of the groups are the leaves of one more tree, built by the same steps.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dossier.llm.common import settled

#: Levels of a block above its leaves: 4096 leaves, 262 kB of digests.
HEIGHT = 12
DIGEST = 32


def digest(text: bytes) -> bytes:
    """SHA-256 as lowercase hex."""
    return hashlib.sha256(text).hexdigest().encode()


@lru_cache(maxsize=64)
def _splits(height: int) -> tuple[tuple[int, int, int], ...]:
    """For each depth below the root: where the subtree cut above that depth begins, and the
    number of nodes of its top part and of each of its bottom parts."""
    out = [(0, 0, 0)] * (height + 1)

    def split(first: int, levels: int) -> None:
        if levels == 1:
            return
        top = levels // 2
        out[first + top] = (first, (1 << top) - 1, (1 << (levels - top)) - 1)
        split(first, top)
        split(first + top, levels - top)

    split(0, height + 1)
    return tuple(out)


def address(depth: int, number: np.ndarray, height: int) -> np.ndarray:
    """Places of the nodes with these numbers at a depth of a tree, the root being at 0."""
    number = np.asarray(number, dtype=np.int64)
    place = np.zeros_like(number)
    while depth:
        first, top, bottom = _splits(height)[depth]
        # The top part lies before all bottom parts, of which this node begins one.
        place += top + (number & top) * bottom
        number = number >> (depth - first)
        depth = first
    return place


def tree_height(leaves: int) -> int:
    return max(0, leaves - 1).bit_length()


def build(leaves: Sequence[bytes], height: int) -> np.ndarray:
    """All nodes above some leaves (hex digests, in order), by address; missing nodes are zero.

    Every two nodes of a level become one of the next; an odd last one becomes one alone.
    """
    store = np.zeros(((2 << height) - 1, DIGEST), dtype=np.uint8)
    nodes = list(leaves)
    for depth in range(height, -1, -1):
        raw = np.frombuffer(bytes.fromhex(b"".join(nodes).decode()), dtype=np.uint8)
        store[address(depth, np.arange(len(nodes)), height)] = raw.reshape(-1, DIGEST)
        if depth:
            nodes = [digest(b"".join(nodes[i: i + 2])) for i in range(0, len(nodes), 2)]
    return store


def siblings(store: np.ndarray, height: int, count: int, number: np.ndarray) -> list[list[bytes]]:
    """For each level from the leaves up, every leaf's sibling by address: the side it is on and
    its digest in hex, or nothing where the node is alone."""
    out = []
    for level in range(height):
        own = number >> level
        other = own ^ 1
        there = other < -(-count >> level)
        text = store[address(height - level, np.where(there, other, 0), height)].tobytes().hex().encode()
        out.append([
            (b"<" if left else b">") + text[64 * k: 64 * k + 64] if some else b""
            for k, (left, some) in enumerate(zip((own & 1).tolist(), there.tolist(), strict=True))
        ])
    return out


def folded(node: bytes, steps: Sequence[bytes]) -> bytes:
    """The root that follows from a leaf and the siblings on its way up."""
    for step in steps:
        node = digest(step[1:] + node if step[:1] == b"<" else node + step[1:])
    return node


def leaf(fields: Sequence[Column]) -> Column:
    """A row's digest: of each field its length in bytes, a colon and its text, or a dash if null."""
    texts = [f.cast("string") for f in fields]
    parts = [F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]
    return F.sha2(F.concat(*parts), 256)


def group_key(group: Column) -> Column:
    """Text that orders as the group does, null before all others, and is never null."""
    text = group.cast("string")
    return F.when(text.isNull(), "").otherwise(F.concat(F.lit("="), text))


def positions(rows: DataFrame, order: Sequence[str]) -> DataFrame:
    """``rows`` with ``position``, 0, 1, ... in each ``grp`` by the given columns.

    The table is cut into ranges of group and order; rows that tie come in any order, also over
    several ranges. Each range counts for itself and adds the rows of the ranges before it, so no
    group is one task's work; only the first group of a range can have begun in an earlier one,
    so there is at most one offset for each range.
    """
    ranges = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tie = F.monotonically_increasing_id()
    # Bounds come from a sample, hence written down before it is read twice.
    cut = settled(
        rows.withColumn("_tie", tie).repartitionByRange(ranges, "grp", *order, "_tie")
        .withColumn("_range", F.spark_partition_id())
    )
    sizes = cut.groupBy("grp", "_range").agg(F.count("*").alias("_n"))
    earlier = Window.partitionBy("grp").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        sizes.withColumn("_before", F.sum("_n").over(earlier)).filter("_before > 0")
        .select("grp", "_range", "_before")
    )
    within = F.row_number().over(Window.partitionBy("_range", "grp").orderBy(*order, "_tie")) - 1
    return (
        cut.withColumn("_within", within).join(F.broadcast(offsets), ["grp", "_range"], "left")
        .withColumn("position", (F.col("_within") + F.coalesce("_before", F.lit(0))).cast("long"))
        .select(*rows.columns, "position")
    )


@dataclass
class Manifest:
    """Blocks of each tier (``grp, block, size, height, final, tree, root``), from the leaves up,
    those of the tree over the groups, and the root of everything (None for an empty table).
    ``final`` blocks are the whole of their group."""

    tiers: list[DataFrame]
    over: list[DataFrame]
    root: str | None


def _blocks(nodes: DataFrame) -> DataFrame:
    """Blocks over ``grp, block, at, node``.

    A first block with room left is its whole group. A full one may have others after it, so it
    counts as one of several: if there are none, the next tier has one node, which is the root.
    """

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("at")
        final = table["block"][0].as_py() == 0 and table.num_rows < 1 << HEIGHT
        height = tree_height(table.num_rows) if final else HEIGHT
        store = build([n.encode() for n in table["node"].to_pylist()], height)
        return pa.table({
            "grp": table["grp"][:1], "block": table["block"][:1], "size": pa.array([table.num_rows], pa.int64()),
            "height": pa.array([height], pa.int32()), "final": pa.array([final]),
            "tree": pa.array([store.tobytes()], pa.binary()), "root": [store[0].tobytes().hex()],
        })

    # Dealt by block, so that a large group is many tasks' work.
    return nodes.select("grp", "block", "at", "node").repartition("grp", "block").groupBy("grp", "block").applyInArrow(
        run, "grp string, block long, size long, height int, final boolean, tree binary, root string"
    )


def _placed(nodes: DataFrame, number: str) -> DataFrame:
    """The block of each node and its place there, from its number in the group."""
    return nodes.withColumn("block", F.shiftright(number, HEIGHT)).withColumn("at", F.col(number).bitwiseAND((1 << HEIGHT) - 1))


def _tiers(nodes: DataFrame) -> list[DataFrame]:
    """Blocks over ``grp, position, node`` tier by tier until every group is one block."""
    nodes = _placed(nodes, "position")
    out = []
    while True:
        out.append(settled(_blocks(nodes)))
        rest = out[-1].filter("not final").select("grp", F.col("block").alias("position"), F.col("root").alias("node"))
        if rest.isEmpty():
            return out
        nodes = _placed(rest, "position")


def _roots(tiers: list[DataFrame]) -> DataFrame:
    """``grp, node``: the root of each group, from the tier in which it is one block."""
    ends = [t.filter("final").select("grp", F.col("root").alias("node")) for t in tiers]
    out = ends[0]
    for end in ends[1:]:
        out = out.unionByName(end)
    return out


def _leaves_over(manifest: list[DataFrame]) -> DataFrame:
    """The groups' roots with their place in the tree over all groups."""
    return positions(_roots(manifest).select(F.lit("").alias("grp"), F.col("grp").alias("own"), "node"), ["own"])


def manifest(leaves: DataFrame) -> tuple[Manifest, DataFrame]:
    """The trees over ``grp, position, leaf`` and the groups' places (``own, position, node``)."""
    tiers = _tiers(leaves.select("grp", "position", F.col("leaf").alias("node")))
    groups = settled(_leaves_over(tiers))
    over = _tiers(groups.select("grp", "position", "node"))
    root = _roots(over).first()
    return Manifest(tiers, over, root["node"] if root else None), groups


def _climbed(children: DataFrame, blocks: DataFrame, finish, schema: str) -> DataFrame:
    """``finish(children, steps of each, subroot)`` for the children of each block, which has the
    steps from its own root upwards in ``steps``."""

    def run(rows: pa.Table, block: pa.Table) -> pa.Table:
        row = {c: block[c][0].as_py() for c in ("size", "height", "tree", "steps", "subroot")}
        store = np.frombuffer(row["tree"], dtype=np.uint8).reshape(-1, DIGEST)
        levels = siblings(store, row["height"], row["size"], rows["at"].to_numpy())
        above = [s.encode() for s in row["steps"]]
        return finish(rows, [[*own, *above] for own in zip(*levels, strict=True)] if levels else [above] * rows.num_rows, row["subroot"])

    keys = ["grp", "block"]
    own = blocks.select(*keys, "size", "height", "tree", "steps", "subroot")
    # Both by block: dealt by group alone, a large group would be one task's work.
    return children.repartition(*keys).groupBy(*keys).cogroup(own.repartition(*keys).groupBy(*keys)).applyInArrow(run, schema)


def _steps(rows: pa.Table, steps: list[list[bytes]], subroot: str) -> pa.Table:
    return pa.table({
        "grp": rows["grp"], "block": rows["child"], "own": rows["own"],
        "steps": pa.array([[s.decode() for s in own] for own in steps], pa.list_(pa.string())),
        "subroot": pa.array([subroot] * rows.num_rows, pa.string()),
    })


_STEPS = "grp string, block long, own string, steps array<string>, subroot string"


def _with_steps(tiers: list[DataFrame], last: DataFrame) -> DataFrame:
    """The blocks of the lowest tier with ``steps`` and ``subroot``; ``last`` has these by ``grp``."""
    blocks = None
    for tier in reversed(tiers):
        done = tier.filter("final").join(last, "grp")
        if blocks is not None:
            children = tier.filter("not final")
            nodes = _placed(children.select("grp", F.col("block").alias("child"), F.lit("").alias("own")), "child")
            steps = _climbed(nodes, blocks, _steps, _STEPS).drop("own")
            done = done.unionByName(children.join(steps, ["grp", "block"]))
        blocks = done
    return blocks


def proven(leaves: DataFrame, trees: Manifest, groups: DataFrame) -> DataFrame:
    """``doc_id, leaf, subroot, proof_sha256, folded_root`` of ``grp, position, doc_id, leaf, claimed``.

    ``proof_sha256`` is the digest of the siblings on the way from a leaf to the root, as stored;
    ``folded_root`` is the root that follows from them and the ``claimed`` leaf.
    """
    top = _with_steps(trees.over, leaves.sparkSession.createDataFrame([("", [], "")], "grp string, steps array<string>, subroot string"))
    nodes = _placed(groups.withColumnRenamed("position", "child"), "child")
    by_group = _climbed(nodes, top, _steps, _STEPS).select(F.col("own").alias("grp"), "steps")
    roots = groups.select(F.col("own").alias("grp"), F.col("node").alias("subroot"))
    blocks = _with_steps(trees.tiers, settled(by_group.join(roots, "grp")))

    def finish(rows: pa.Table, steps: list[list[bytes]], subroot: str) -> pa.Table:
        claimed = [c.encode() for c in rows["claimed"].to_pylist()]
        return pa.table({
            "doc_id": rows["doc_id"], "leaf": rows["leaf"], "subroot": pa.array([subroot] * rows.num_rows, pa.string()),
            "proof_sha256": [digest(b"".join(s[1:] for s in own)).decode() for own in steps],
            "folded_root": [folded(c, own).decode() for c, own in zip(claimed, steps, strict=True)],
        })

    rows = _placed(leaves, "position").select("grp", "block", "at", "doc_id", "leaf", "claimed")
    return _climbed(rows, blocks, finish, "doc_id long, leaf string, subroot string, proof_sha256 string, folded_root string")


def verified(
    df: DataFrame, fields: Sequence[str], group: str, claimed: dict[str, Column] | None = None, id_column: str = "doc_id"
) -> DataFrame:
    """Every row's leaf and proof in the manifest of the table, and whether a claim about it holds.

    ``fields`` make the leaf, ``group`` the tree, ``id_column`` (whole numbers) the order within it; ``claimed`` gives
    the columns that a claimed row has in place of the table's (none: rows as they are).
    Columns: ``doc_id, leaf, subroot, root, proof_sha256, folded_root, verified``.

    Nulls are fields of their own kind, so a null and an empty text differ; rows without id come
    first in their group and rows without group are the first group. Repeated rows are leaves of
    their own, next to each other; rows with one id and other fields are ordered by their digest.
    An empty table has no rows and no root. Columns that are not named are left aside.
    """
    claim = {f: (claimed or {}).get(f, F.col(f)) for f in fields}
    rows = df.select(
        F.col(id_column).cast("long").alias("doc_id"), group_key(F.col(group)).alias("grp"),
        leaf([F.col(f) for f in fields]).alias("leaf"), leaf(list(claim.values())).alias("claimed"),
    )
    leaves = settled(positions(rows, ["doc_id", "leaf"]))
    trees, groups = manifest(leaves)
    out = proven(leaves, trees, groups)
    return out.withColumn("root", F.lit(trees.root).cast("string")).withColumn("verified", F.col("folded_root") == F.col("root"))
