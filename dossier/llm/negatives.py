"""Hard negatives by a vertical scan of vectors, dimension by dimension.

Vectors of a block are held by column. For each anchor the columns are read in descending order of
the anchor's magnitude there, so that sums settle early. What the columns not yet read can add lies
between the products with their least and greatest values; a bitmap of candidates loses all whose
bounds show that they cannot be among the rows asked for. Those left at the end have exact scores.
The first scan finds each anchor's positives, the second the rows within the windows of scores that
these set.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dossier.llm.common import settled
from dossier.operators.spread import best_rows

#: Rows and anchors of one block of work.
ROWS = 1 << 14
ANCHORS = 1 << 15
#: Columns read between two looks at the bounds.
STEP = 8
#: Steps of a unit, and the magnitude in these steps from which on a row takes no part.
STEPS = 256
LIMIT = 1 << 24

Keep = Callable[[np.ndarray, np.ndarray], np.ndarray]


class Columns:
    """Vectors of whole numbers by column, with each column's least and greatest value."""

    def __init__(self, vectors: np.ndarray, anchors: np.ndarray):
        """``vectors`` and ``anchors`` have a row for each vector; the numbers' kind is the
        smallest in which no sum over any of the anchors can be rounded."""
        self.n, self.size = vectors.shape
        self.low = vectors.min(axis=0) if self.n else np.zeros(self.size, np.int64)
        self.high = vectors.max(axis=0) if self.n else np.zeros(self.size, np.int64)
        most = np.maximum(np.abs(self.low), np.abs(self.high)).astype(np.float64)
        bound = float((np.abs(anchors).astype(np.float64) @ most).max()) if len(anchors) and self.size else 0.0
        if bound >= 2.0**62:
            raise ValueError("scores of these vectors do not fit 64 bits")
        kind = np.float32 if bound < 2**24 else np.float64 if bound < 2**53 else np.int64
        self.columns = np.ascontiguousarray(vectors.T).astype(kind)

    def scan(self, anchor: np.ndarray, alive: np.ndarray, keep: Keep) -> tuple[np.ndarray, np.ndarray]:
        """Rows of the bitmap ``alive`` that ``keep`` leaves, given bounds of their scores, and
        their exact scores. The bitmap is changed."""
        order = np.argsort(-np.abs(anchor), kind="stable")
        ends = anchor[order] * self.low[order], anchor[order] * self.high[order]
        least = np.append(np.cumsum(np.minimum(*ends)[::-1])[::-1], 0)
        most = np.append(np.cumsum(np.maximum(*ends)[::-1])[::-1], 0)
        at = np.flatnonzero(alive)
        part = np.zeros(len(at), dtype=self.columns.dtype)
        for first in range(0, self.size, STEP):
            last = min(first + STEP, self.size)
            for d in order[first:last]:
                column = self.columns[d]
                part += (column if len(at) == self.n else column[at]) * column.dtype.type(anchor[d])
            kept = keep(part + part.dtype.type(least[last]), part + part.dtype.type(most[last]))
            if not kept.all():
                alive[at[~kept]] = False
                at, part = at[kept], part[kept]
            if not len(at):
                break
        return at, part.astype(np.int64)


def top(k: int) -> Keep:
    """Keeps what can be among the ``k`` highest scores."""

    def keep(lower: np.ndarray, upper: np.ndarray) -> np.ndarray:
        if len(lower) <= k:
            return np.ones(len(lower), dtype=bool)
        return upper >= np.partition(lower, len(lower) - k)[len(lower) - k]

    return keep


def top_within(windows: list[tuple[int, int]], k: int) -> Keep:
    """Keeps what can be among the ``k`` highest scores of any window (both ends belong to it)."""

    def keep(lower: np.ndarray, upper: np.ndarray) -> np.ndarray:
        out = np.zeros(len(lower), dtype=bool)
        for low, high in windows:
            can = (upper >= low) & (lower <= high)
            sure = lower[(lower >= low) & (upper <= high)]
            if len(sure) > k:
                can &= upper >= np.partition(sure, len(sure) - k)[len(sure) - k]
            out |= can
        return out

    return keep


def window_of(positive: int, low: int, high: int) -> tuple[int, int]:
    """Scores that are ``low`` to ``high`` hundredths of a positive's; the first above the last if none are."""
    return -(-low * positive // 100), high * positive // 100


def _matrix(table: pa.Table) -> np.ndarray:
    lists = table["vector"].combine_chunks()
    return lists.flatten().to_numpy().astype(np.int64).reshape(table.num_rows, -1) if table.num_rows else np.zeros((0, 0), np.int64)


def _first(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    return np.lexsort((ids, -scores))[:k]


def rows_of(df: DataFrame, id_column: str, vector: str, label: Column) -> DataFrame:
    """``id, label, vector`` of the rows that take part, one for each id, vectors in whole steps."""
    steps = F.transform(F.col(vector), lambda x: F.floor(F.lit(STEPS) * x.cast("double")))
    # Null is no answer of the comparison, hence the first test; NaN is above every number.
    fits = F.forall(F.col(vector), lambda x: x.isNotNull() & (F.abs(x.cast("double") * F.lit(STEPS)) < F.lit(float(LIMIT))))
    # Only rows that fit are scaled, whatever order the conditions are tried in.
    usable = df.select(
        F.col(id_column).cast("long").alias("id"), label.cast("long").alias("label"),
        F.when(fits, steps).cast("array<int>").alias("vector"),
    ).filter("id is not null and label is not null and vector is not null")
    return usable.groupBy("id").agg(F.min(F.struct("label", "vector")).alias("r")).select("id", "r.label", "r.vector")


def _number(count: Column, size: int) -> Column:
    return F.greatest(F.ceil(count / F.lit(size)), F.lit(1)).cast("long")


def _chunk(count: Column, seed: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(seed), "id"), count)


def _each(count: Column) -> Column:
    return F.explode(F.sequence(F.lit(0).cast("long"), count - 1))


def _searched(rows: DataFrame, anchors: DataFrame, keys: list[str], search, schema: str, parts: int) -> DataFrame:
    """``search`` over the rows and anchors of each block of work. The number of partitions is
    given, since work is in the pairs and not in the bytes by which small partitions are merged."""
    # Both come from the same table; renaming tells their columns apart.
    left, right = (x.toDF(*x.columns).repartition(parts, *keys).groupBy(*keys) for x in (rows, anchors))
    return left.cogroup(right).applyInArrow(search, schema)


def positives(rows: DataFrame, is_anchor: Column, count: int) -> DataFrame:
    """``anchor_id, positive_id, score``: each anchor's first ``count`` other rows of its label."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sizes = rows.groupBy("label").agg(
        _number(F.count("*"), ROWS).alias("chunks"), _number(F.count_if(is_anchor), ANCHORS).alias("turns"),
        F.count_if(is_anchor).alias("anchors"),
    ).filter("anchors > 0").drop("anchors")
    sized = rows.join(sizes, "label").withColumn("dims", F.size("vector"))
    left = sized.select("label", "dims", "id", "vector", _chunk(F.col("chunks"), 1).alias("chunk"), _each(F.col("turns")).alias("turn"))
    right = sized.filter(is_anchor).select(
        "label", "dims", "id", "vector", _chunk(F.col("turns"), 2).alias("turn"), _each(F.col("chunks")).alias("chunk")
    )

    def search(table: pa.Table, asked: pa.Table) -> pa.Table:
        out = ([], [], [])
        if table.num_rows and asked.num_rows:
            vectors, anchors = _matrix(table), _matrix(asked)
            block, ids = Columns(vectors, anchors), table["id"].to_numpy()
            for own, anchor in zip(asked["id"].to_pylist(), anchors, strict=True):
                at, scores = block.scan(anchor, ids != own, top(count))
                best = _first(ids[at], scores, count)
                out[0].extend([own] * len(best))
                out[1].extend(ids[at][best].tolist())
                out[2].extend(scores[best].tolist())
        return pa.table(dict(zip(("anchor_id", "positive_id", "score"), (pa.array(c, pa.int64()) for c in out), strict=True)))

    found = _searched(left, right, ["label", "dims", "chunk", "turn"], search, "anchor_id long, positive_id long, score long", parts)
    return best_rows(found, ["anchor_id"], [F.desc("score"), "positive_id"], count)


def hard_negatives(
    df: DataFrame, is_anchor: Column, label: Column | None = None, positive_rows: int = 5, negative_rows: int = 3,
    low: int = 50, high: int = 95, id_column: str = "vec_id", vector: str = "embedding",
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    A component x counts as ``floor(STEPS * x)``; a score is the inner product with the anchor,
    higher ones come first, then smaller ids. ``is_anchor`` is a condition on ``id``. For each
    anchor and each of its first ``positive_rows`` other rows of its label, the first
    ``negative_rows`` rows of other labels whose score is ``low`` to ``high`` hundredths of the
    positive's; fewer where there are fewer. A negative positive's score leaves no such rows.

    Rows without id, label or vector, with a component that is null or no finite number, or of a
    magnitude of ``LIMIT / STEPS`` and more, take no part. An id counts once: of rows that share
    one, the least by label and then vector. Vectors are compared with those of their own length.
    An empty table gives no rows. Other columns are left aside.
    """
    rows = settled(rows_of(df, id_column, vector, F.col("label") if label is None else label))
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = settled(positives(rows, is_anchor, positive_rows))
    asked = rows.filter(is_anchor).join(
        found.groupBy(F.col("anchor_id").alias("id")).agg(F.collect_list(F.struct("positive_id", "score")).alias("positives")), "id"
    )
    # The scan of all rows: a row's block is fixed, anchors go to the blocks of all rows.
    count, n_anchors = rows.count(), rows.filter(is_anchor).count()
    chunks, turns = (F.lit(max(1, -(-n // size))).cast("long") for n, size in ((count, ROWS), (n_anchors, ANCHORS)))
    left = rows.select(F.size("vector").alias("dims"), "id", "label", "vector", _chunk(chunks, 3).alias("chunk"), _each(turns).alias("turn"))
    right = asked.select(F.size("vector").alias("dims"), "id", "label", "vector", "positives", _chunk(turns, 4).alias("turn"), _each(chunks).alias("chunk"))

    def search(table: pa.Table, asked: pa.Table) -> pa.Table:
        out: list[list[int]] = [[], [], [], [], []]
        if table.num_rows and asked.num_rows:
            vectors, anchors = _matrix(table), _matrix(asked)
            block, ids, labels = Columns(vectors, anchors), table["id"].to_numpy(), table["label"].to_numpy()
            for own, kind, given, anchor in zip(
                asked["id"].to_pylist(), asked["label"].to_pylist(), asked["positives"].to_pylist(), anchors, strict=True
            ):
                windows = [(p["positive_id"], p["score"], *window_of(p["score"], low, high)) for p in given]
                wanted = sorted({(a, b) for _, _, a, b in windows if a <= b})
                if not wanted:
                    continue
                at, scores = block.scan(anchor, labels != kind, top_within(wanted, negative_rows))
                for positive, score, a, b in windows:
                    inside = np.flatnonzero((scores >= a) & (scores <= b))
                    best = inside[_first(ids[at][inside], scores[inside], negative_rows)]
                    for column, values in zip(out, (
                        [own] * len(best), [positive] * len(best), ids[at][best].tolist(), [score] * len(best), scores[best].tolist(),
                    ), strict=True):
                        column.extend(values)
        names = ("anchor_id", "positive_id", "negative_id", "positive_score", "negative_score")
        return pa.table(dict(zip(names, (pa.array(c, pa.int64()) for c in out), strict=True)))

    blocks = -(-count // ROWS) * -(-n_anchors // ANCHORS)
    near = _searched(
        left, right, ["dims", "chunk", "turn"], search,
        "anchor_id long, positive_id long, negative_id long, positive_score long, negative_score long", max(parts, blocks),
    )
    by_pair = Window.partitionBy("anchor_id", "positive_id").orderBy(F.desc("negative_score"), "negative_id")
    ranked = near.withColumn("rank", F.row_number().over(by_pair)).filter(F.col("rank") <= negative_rows)
    return ranked.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
