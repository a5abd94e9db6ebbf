"""Joins, numbering and lists that stay balanced when one key holds a large share of rows."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from dossier.session import ensure_checkpoint_dir

# Groups above this size are numbered in ranges instead of in one task.
PLAIN_GROUP_ROWS = 2_000_000
# Members of one group held in one array; longer lists continue in further parts.
PART_SIZE = 1000
# Keys over which rows without a key are spread in a join.
OWN_KEYS = 9973


def lookup_join(
    rows: DataFrame, lookup: DataFrame, on: Sequence[str], spread_by: Sequence[str] = ()
) -> DataFrame:
    """Left join to a table that holds each key once.

    Spark chooses the strategy and splits skewed keys at run time. Rows without a key would all
    meet in one task: where ``spread_by`` names columns that tell rows apart and the first key
    is text, such rows get one of ``OWN_KEYS`` short keys for the join that no text can equal.
    """
    on = list(on)
    first = on[0]
    if not spread_by or dict(rows.dtypes)[first] != "string":
        return rows.join(lookup, on, "left")
    missing = reduce(lambda a, b: a | b, [F.col(c).isNull() for c in on])
    own = F.concat(F.lit("\x00"), F.pmod(F.xxhash64(*spread_by), F.lit(OWN_KEYS)).cast("string"))
    keyed = rows.withColumn("_key", F.when(missing, own).otherwise(F.col(first)))
    table = lookup.withColumnRenamed(first, "_key")
    rest = [c for c in lookup.columns if c not in on]
    # Further keys that are null would join nothing; the first key alone decides then.
    same = [F.col("_a._key") == F.col("_b._key")] + [F.col(f"_a.{c}") == F.col(f"_b.{c}") for c in on[1:]]
    joined = keyed.alias("_a").join(table.alias("_b"), same, "left")
    others = [F.col(f"_a.`{c}`") for c in rows.columns if c not in on]
    return joined.select(*[F.col(f"_a.`{c}`") for c in on], *others, *[F.col(f"_b.`{c}`") for c in rest])


def settled(df: DataFrame) -> DataFrame:
    """The table written once to the shared checkpoint folder.

    For intermediate results that are costly to compute and read more than once.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def settled_with(df: DataFrame, **counts: Column) -> tuple[DataFrame, dict]:
    """``settled``, and aggregates of its rows taken by the pass that writes them."""
    seen = Observation()
    written = settled(df.observe(seen, *[value.alias(name) for name, value in counts.items()]))
    return written, dict(seen.get)


def largest_group(df: DataFrame, group: Sequence[str]) -> int:
    counts = df.groupBy(*group).agg(F.count("*").alias("_n"))
    return counts.agg(F.max("_n")).first()[0] or 0


def numbered(
    df: DataFrame,
    group: Sequence[str],
    order: Sequence[str],
    name: str = "position",
    plain_rows: int = PLAIN_GROUP_ROWS,
) -> DataFrame:
    """Number rows 1, 2, ... within each group in the given order.

    ``group`` may be empty for one numbering over the table. Groups up to ``plain_rows``
    use a window. Otherwise, and without groups, the table is cut into key ranges, each range is numbered on
    its own, and the rows of the ranges before it are added. Only the first group of a
    range can have begun in an earlier one, so the table of offsets has at most one row
    per range. ``group`` and ``order`` together should identify a row.
    """
    group, order = list(group), list(order)
    # One numbering over the whole table is never one task's work.
    if group and largest_group(df, group) <= plain_rows:
        return df.withColumn(
            name, F.row_number().over(Window.partitionBy(*group).orderBy(*order)).cast("bigint")
        )

    ranges = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # The range bounds come from a sample, so the cut is written down before it is used twice.
    cut = settled(
        df.repartitionByRange(ranges, *group, *order).withColumn("_range", F.spark_partition_id())
    )
    sizes = cut.groupBy("_range", *group).agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*(group or [F.lit(0)])).orderBy("_range").rowsBetween(
        Window.unboundedPreceding, -1
    )
    offsets = (
        sizes.withColumn("_before", F.sum("_n").over(before)).where("_before > 0")
        .select(F.col("_range").alias("_r"), *[F.col(c).alias(f"_g_{c}") for c in group], "_before")
    )
    same: Column = F.col("_range") == F.col("_r")
    for column in group:
        same = same & F.col(column).eqNullSafe(F.col(f"_g_{column}"))
    local = F.row_number().over(Window.partitionBy("_range", *group).orderBy(*order))
    return (
        cut.withColumn("_local", local)
        .join(F.broadcast(offsets), same, "left")
        .withColumn(name, (F.col("_local") + F.coalesce(F.col("_before"), F.lit(0))).cast("bigint"))
        .select(*df.columns, name)
    )


def listed_in_parts(
    df: DataFrame,
    group: Sequence[str],
    order: Sequence[str],
    value: Column,
    name: str = "items",
    size: int = PART_SIZE,
    total: str | None = None,
    plain_rows: int = PLAIN_GROUP_ROWS,
) -> DataFrame:
    """Ordered list per group as arrays of at most ``size`` members.

    Returns ``group``, ``part`` (0, 1, ...) and the array. A group of up to ``size`` rows
    is one part; no array grows with the data and no member is left out. ``total`` names a
    column for the size of the whole group. The input is read twice: pass a settled table
    if it is costly.
    """
    group = list(group)
    placed = numbered(df.withColumn("_value", value), group, order, "_pos", plain_rows)
    member = F.struct(F.col("_pos").alias("p"), F.col("_value").alias("v"))
    parts = (
        placed.withColumn("part", F.floor((F.col("_pos") - 1) / size).cast("bigint"))
        .groupBy(*group, "part")
        .agg(F.transform(F.array_sort(F.collect_list(member)), lambda m: m["v"]).alias(name))
    )
    if total is None:
        return parts
    # One row per ``size`` members is left, so the window holds few rows.
    counted = F.sum(F.size(name)).over(Window.partitionBy(*group)).cast("bigint")
    return parts.withColumn(total, counted)


def best_rows(
    df: DataFrame, group: Sequence[str], order: Sequence[Column | str], keep: int = 1
) -> DataFrame:
    """The first ``keep`` rows of each group. The rank filter is applied on the map side
    before the shuffle, so a frequent group sends few rows."""
    rank = F.row_number().over(Window.partitionBy(*group).orderBy(*order))
    return df.withColumn("_rank", rank).where(F.col("_rank") <= keep).drop("_rank")
