"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dossier.llm.common import settled

#: Edges that one task takes, about: every task of a step leaves files, and there are many steps.
TASK_EDGES = 1 << 17


def components(edges: DataFrame) -> DataFrame:
    """``node, component`` for every node of the edges ``a, b`` (long); the least node names it.

    Alternates two steps until nothing changes: every node links its larger neighbours to its
    least one, then its smaller neighbours and itself. Both keep components and turn each into a
    star. Least neighbours are aggregated before the shuffle, so a node of very many edges is
    no single task's work. Nulls are left out; no edges give an empty table.
    """
    stars = settled(
        edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .filter("a is not null and b is not null and a <> b").distinct()
    )
    before = None
    while True:
        mark = stars.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        # Neither step adds edges, so the tasks for the largest table do for all.
        tasks = max(1, -(-mark[0] // TASK_EDGES))
        stars = stars.coalesce(tasks)
        if mark == before:
            break
        before = mark
        stars = settled(_small_star(_large_star(stars, tasks), tasks).coalesce(tasks))
    roots = stars.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return stars.select(F.col("a").alias("node"), F.col("b").alias("component")).unionAll(roots)


def _large_star(edges: DataFrame, tasks: int) -> DataFrame:
    """Each node's larger neighbours, linked to the least of the node and its neighbours."""
    least = edges.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m"))
    larger = edges.select(F.col("b").alias("u"), F.col("a").alias("v"))
    # A node without smaller neighbours is itself the least.
    return (
        larger.join(least, "u", "left")
        .select(F.col("v").alias("a"), F.coalesce("m", "u").alias("b"))
        .coalesce(tasks).distinct().coalesce(tasks)
    )


def _small_star(edges: DataFrame, tasks: int) -> DataFrame:
    """Each node and its smaller neighbours, linked to the least of them."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = edges.join(least, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionAll(least.select("a", F.col("m").alias("b"))).coalesce(tasks).distinct()
