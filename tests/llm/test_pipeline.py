"""The stages one by one and the whole pipeline."""

import os
from collections import Counter

import pytest
from pyspark.sql import functions as F

pytest.importorskip("public_tokenizers")
import corpus_pipeline  # noqa: E402

from dossier.llm import mixing, packing, quality, toxicity  # noqa: E402

SMALL = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables")


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


def test_stages_keep_columns_and_whole_rows(spark, documents):
    before = documents
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, before, SMALL)
        assert after.columns == documents.columns, name
        if name != "mixing":
            assert after.exceptAll(before).isEmpty() and 0 < after.count() <= before.count()
    packed = corpus_pipeline.STAGES[-1][1](spark, documents, SMALL)
    assert packed.agg(F.sum("length")).first()[0] == packed.select("doc_id", "doc_tokens").distinct().agg(F.sum("doc_tokens")).first()[0]


def test_results_of_stages_can_be_compared(spark, documents):
    """Set operations between a stage's result and its input, and rows that differ in one column."""
    for name, stage in corpus_pipeline.STAGES[:3]:
        after = stage(spark, documents, SMALL)
        assert after.exceptAll(documents).isEmpty(), name
        assert documents.intersectAll(after).count() == after.count(), name
    text = " ".join(f"w{i}" for i in range(50))
    rows = [(1, text, "b"), (1, text, "a"), (1, text, "a"), (2, text, "c"), (3, "", "d"), (3, "", "d")]
    df = spark.createDataFrame(rows, "doc_id long, text string, `odd.name` string").withColumn("m", F.create_map(F.lit("k"), F.lit(1)))
    kept = [sorted(map(str, corpus_pipeline.near_duplicate_stage(spark, df.repartition(n), SMALL).collect())) for n in (1, 3)]
    assert kept[0] == kept[1] and len(kept[0]) == 3


def test_stages_with_clashing_columns(spark):
    names = ["score", "size", "key", "node", "row", "sign", "n", "number", "label", "shard", "words", "whole", "own", "turn", "first"]
    rows = [(i, f"some words of text {i} " * (i % 7 + 1), "en", "ab"[i % 2], 10) for i in range(30)] + [(None, None, None, None, None), (4, "", "", "", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    df = df.select("*", *[F.lit(f"own {c}").alias(c) for c in names])
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, df, SMALL)
        assert after.columns == df.columns, name
        assert {tuple(r[c] for c in names) for r in after.collect()} <= {tuple(f"own {c}" for c in names)}, name
    assert corpus_pipeline.packing_stage(spark, df, SMALL).count() >= len(rows)


def test_decisions_take_effect(spark, documents):
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    model = toxicity.train(documents, labels)
    scores = {r[0]: r[1]["score"] for r in documents.select("doc_id", toxicity.toxicity(documents, model)).collect()}
    kept = {r[0] for r in corpus_pipeline.toxicity_stage(spark, documents, SMALL).select("doc_id").collect()}
    assert kept == {d for d, s in scores.items() if s < 0.5}
    scorer = quality.train(documents, labels)
    scores = {r[0]: r[1] for r in documents.select("doc_id", quality.quality(documents, scorer)).collect()}
    kept = {r[0] for r in corpus_pipeline.quality_stage(spark, documents, SMALL).select("doc_id").collect()}
    assert kept == {d for d, s in scores.items() if s >= 0.3}


def test_near_duplicates_keep_one_of_each_group(spark):
    base = " ".join(f"w{i}" for i in range(100))
    rows = [
        (1, "", "en", "a", 0), (2, None, None, None, None), (3, base, "en", "a", 1), (4, base, "en", "b", 1),
        (5, base + " more", "en", "a", 1), (5, base + " more", "en", "a", 1), (None, "no id", None, None, None), (6, "other text", "en", "c", 1),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumn("number", F.lit("own"))
    kept = corpus_pipeline.near_duplicate_stage(spark, df, SMALL)
    assert kept.columns == df.columns
    assert sorted(r["doc_id"] or -1 for r in kept.collect()) == [-1, 1, 2, 3, 6]
    assert corpus_pipeline.near_duplicate_stage(spark, df.filter("false"), SMALL).count() == 0


def test_near_duplicates_of_repeated_and_missing_ids(spark):
    x, y, z = (" ".join(f"{c}{i}" for i in range(100)) for c in "xyz")
    rows = [(1, x), (2, x + " more"), (2, y), (7, y + " more"), (None, x), (None, z), (None, z + " more"), (3, ""), (3, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    kept = corpus_pipeline.near_duplicate_stage(spark, df, SMALL).collect()
    assert Counter(map(tuple, kept)) == Counter([(1, x), (2, y), (None, z + " more"), (3, ""), (3, None)])


def test_stages_on_an_empty_table(spark, documents):
    nothing = documents.filter("false")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, nothing, SMALL).count() == 0


def test_run_equals_its_stages(spark, documents):
    rows = corpus_pipeline.run(spark, SMALL).collect()
    given = documents
    for _, stage in corpus_pipeline.STAGES[:4]:
        given = stage(spark, given, SMALL)
    words = given.agg(F.sum(mixing.words())).first()[0]
    assert words > 0 and {r["doc_id"] for r in rows} == {r[0] for r in given.select("doc_id").collect()}
    filled = {}
    for row in rows:
        filled[row["sequence_id"]] = filled.get(row["sequence_id"], 0) + row["length"]
    assert max(filled.values()) <= packing.WINDOW
