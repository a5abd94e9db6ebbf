"""Hard negatives against all scores, and the scan on its own."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from dossier.llm import negatives

SCHEMA = "vec_id long, embedding array<float>, label int"


def plain(rows, low=50, high=95, n_positive=5, n_negative=3, every=5):
    """All pairs. ``rows`` have one row an id."""
    kept = [
        (i, [math.floor(256 * float(np.float32(x))) for x in v], k) for i, v, k in rows
        if i is not None and v is not None and k is not None and all(x is not None and math.isfinite(x) and abs(x) < 65536 for x in v)
    ]
    out = []
    for a, va, la in kept:
        if a % every:
            continue
        scores = sorted((-sum(x * y for x, y in zip(va, v)), i, k) for i, v, k in kept if i != a and len(v) == len(va))
        for p, positive, _ in [s for s in scores if s[2] == la][:n_positive]:
            fit = [(i, -s) for s, i, k in scores if k != la and low * -p <= 100 * -s <= high * -p]
            out += [(a, positive, r + 1, i, -p, s) for r, (i, s) in enumerate(fit[:n_negative])]
    return out


def found(spark, rows, every=5, **options):
    df = spark.createDataFrame(rows, SCHEMA).select("*", *[F.lit("own").alias(c) for c in ("id", "vector", "chunk", "turn", "dims", "score")])
    return sorted(map(tuple, negatives.hard_negatives(df, F.col("id") % every == 0, **options).collect()))


def vectors(n, size, seed, spread=1.0):
    random = np.random.default_rng(seed)
    centres = random.normal(0, 1, (4, size))
    return [(i, (centres[i % 4] * spread + random.normal(0, 1, size)).astype(np.float32).tolist(), int(random.integers(0, 4))) for i in range(n)]


@pytest.mark.parametrize("rows_in_block,anchors_in_block", [(1 << 14, 1 << 15), (17, 4)])
def test_equals_all_pairs(spark, monkeypatch, rows_in_block, anchors_in_block):
    monkeypatch.setattr(negatives, "ROWS", rows_in_block)
    monkeypatch.setattr(negatives, "ANCHORS", anchors_in_block)
    rows = vectors(150, 20, 1)
    # Ties, a common vector, other lengths, nothing, and parts that take no part.
    rows += [(200 + i, rows[0][1], i % 3) for i in range(40)]
    rows += [(300, [], 1), (301, [], 2), (305, [], 1), (310, [1.0, 2.0], 1), (311, [2.0, 0.5], 2), (312, [1.0, 1.5], 1), (315, [0.0, 0.0], 1)]
    rows += [(None, rows[1][1], 1), (320, None, 1), (325, rows[2][1], None), (330, [None] * 20, 1), (331, [float("nan")] * 20, 1),
             (335, [float("inf")] * 20, 1), (340, [1e30] * 20, 1), (-5, rows[3][1], 2)]
    want = plain(rows)
    assert len(want) > 100 and found(spark, rows) == sorted(want)


def test_other_windows_and_numbers(spark):
    rows = vectors(120, 9, 2, 3.0)
    got = found(spark, rows, low=0, high=110, positive_rows=2, negative_rows=7)
    assert got == sorted(plain(rows, 0, 110, 2, 7))


def test_large_components_are_exact(spark):
    rows = [(i, [60_000.0 + i, -50_000.0 + 3 * i, 7.0 * i], i % 2) for i in range(30)]
    assert found(spark, rows, low=0, high=100) == sorted(plain(rows, 0, 100))


def test_repeated_ids_count_once(spark):
    rows = vectors(60, 6, 3)
    assert found(spark, rows + rows[:20]) == sorted(plain(rows))
    # Of rows that share an id and differ, the least by label counts.
    i, vector, label = rows[10]
    assert found(spark, [*rows, (i, vector[::-1], label + 5)]) == sorted(plain(rows))


def test_an_empty_table(spark):
    assert found(spark, []) == []
    assert found(spark, vectors(4, 3, 1), every=1000) == []


def test_scan_drops_candidates_and_keeps_the_best():
    random = np.random.default_rng(5)
    rows, anchor = random.integers(-100, 100, (4000, 64)), random.integers(-3, 4, 64)
    anchor[:4] = [200, -220, 180, 250]
    block = negatives.Columns(rows, anchor[None])
    exact = rows @ anchor
    seen = []

    def keep(lower, upper):
        kept = negatives.top(7)(lower, upper)
        seen.append(int(kept.sum()))
        return kept

    alive = np.ones(4000, dtype=bool)
    at, scores = block.scan(anchor, alive, keep)
    assert set(np.argsort(-exact, kind="stable")[:7]) <= set(at.tolist()) and (scores == exact[at]).all()
    assert seen[0] < 2000 and seen == sorted(seen, reverse=True) and alive.sum() == len(at)
    windows = [(1000, 3000), (2500, 20_000), (10**6, 10**6)]
    at, scores = block.scan(anchor, np.ones(4000, dtype=bool), negatives.top_within(windows, 3))
    for low, high in windows:
        inside = np.sort(exact[(exact >= low) & (exact <= high)])[::-1][:3]
        assert np.sort(scores[(scores >= low) & (scores <= high)])[::-1][:3].tolist() == inside.tolist()
