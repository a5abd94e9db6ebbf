"""Merkle manifest against a plain version, with blocks small enough for several tiers."""

import hashlib
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from dossier.llm import merkle

FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return h(*["-" if row[f] is None else f"{len(str(row[f]).encode())}:{row[f]}" for f in FIELDS])


def levels_of(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([h(*levels[-1][i: i + 2]) for i in range(0, len(levels[-1]), 2)])
    return levels


def way(levels, i):
    """Pairs of left and right siblings on the way up, where there are any."""
    out = []
    for nodes in levels[:-1]:
        out.append((nodes[i - 1], "") if i % 2 else ("", nodes[i + 1] if i + 1 < len(nodes) else ""))
        i //= 2
    return out


def plain(rows, change):
    by_group = {}
    for row in rows:
        by_group.setdefault(row["lang"], []).append(row)
    groups = sorted(by_group, key=lambda g: (g is not None, (g or "").encode()))
    trees = {}
    for g in groups:
        by_group[g].sort(key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf(r)))
        trees[g] = levels_of([leaf(r) for r in by_group[g]])
    top = levels_of([trees[g][-1][0] for g in groups])
    out = []
    for k, g in enumerate(groups):
        for i, row in enumerate(by_group[g]):
            steps = way(trees[g], i) + way(top, k)
            node = leaf(change(dict(row)))
            for left, right in steps:
                node = h(left, node, right)
            proof = h(*[a + b for a, b in steps])
            out.append((row["doc_id"], leaf(row), trees[g][-1][0], top[-1][0], proof, node, node == top[-1][0]))
    return out


def rows_of(n, languages=("en", "de", None, "", "日本")):
    rows = [
        {"doc_id": i, "text": f"text {i} é" * (i % 5), "lang": languages[(i * i) % len(languages)],
         "source": [None, "", "a"][i % 3], "n_chars": None if i % 11 == 0 else i}
        for i in range(n)
    ]
    rows.append({"doc_id": None, "text": None, "lang": None, "source": None, "n_chars": None})
    rows.append({"doc_id": 10**12, "text": "long " * 100_000, "lang": "en", "source": "b", "n_chars": 500_000})
    return rows + rows[3:5]


@pytest.mark.parametrize("height", range(9))
def test_addresses_keep_subtrees_together(height):
    places = [merkle.address(d, np.arange(1 << d), height) for d in range(height + 1)]
    assert sorted(np.concatenate(places).tolist()) == list(range((2 << height) - 1))
    top = (height + 1) // 2
    if top:
        # The top half first, then every bottom half in one run.
        assert max(int(p.max()) for p in places[:top]) == (1 << top) - 2
        for number in range(1 << top):
            own = np.concatenate([p[number << (d - top): (number + 1) << (d - top)] for d, p in enumerate(places) if d >= top])
            assert own.max() - own.min() == len(own) - 1


@pytest.mark.parametrize("count", [1, 2, 3, 5, 8, 13])
def test_blocks_hold_the_tree(count):
    nodes = [h(str(i)) for i in range(count)]
    height = merkle.tree_height(count)
    store = merkle.build([n.encode() for n in nodes], height)
    levels = levels_of(nodes)
    assert len(levels) == height + 1 and store[0].tobytes().hex() == levels[-1][0]
    steps = merkle.siblings(store, height, count, np.arange(count))
    for i in range(count):
        assert [(s[i][1:].decode() if s[i] else "") for s in steps] == [a + b for a, b in way(levels, i)]


@pytest.mark.parametrize("height,n", [(1, 60), (2, 90), (12, 90)])
def test_equals_plain_version(spark, monkeypatch, height, n):
    monkeypatch.setattr(merkle, "HEIGHT", height)
    rows = rows_of(n)
    df = spark.createDataFrame([tuple(r[c] for c in ("doc_id", "text", "lang", "source", "n_chars")) for r in rows], SCHEMA)
    df = df.select("*", *[F.lit("own").alias(c) for c in ("grp", "leaf", "position", "block", "at", "root", "tree")])

    def hit(doc):
        return doc is not None and zlib.crc32(str(doc).encode()) % 7 == 0

    def change(row):
        if hit(row["doc_id"]) and row["n_chars"] is not None:
            row["n_chars"] += 1
        return row

    tampered = F.when(F.crc32(F.col("doc_id").cast("string")) % 7 == 0, F.col("n_chars") + 1).otherwise(F.col("n_chars"))
    got = merkle.verified(df, FIELDS, "lang", {"n_chars": tampered}).select(
        "doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"
    ).collect()
    want = plain(rows, change)
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    assert {r[6] for r in want} == {True, False}


def test_a_single_row_and_an_empty_table(spark):
    df = spark.createDataFrame([(1, "x", None, None, None)], SCHEMA)
    row = merkle.verified(df, FIELDS, "lang").first()
    assert row["leaf"] == row["subroot"] == row["root"] == row["folded_root"] and row["verified"]
    assert row["proof_sha256"] == h()
    nothing = merkle.verified(df.filter("false"), FIELDS, "lang")
    assert nothing.count() == 0 and nothing.columns[-1] == "verified"
