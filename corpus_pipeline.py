"""Five stages that turn the documents table into packed training sequences.

Every stage takes the rows that the one before kept, as a written table, and all but the last
return the columns of documents.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from dossier.llm import jaccard, mixing, packing, quality, toxicity
from dossier.llm.common import settled
from dossier.session import ensure_checkpoint_dir

#: Scores from which a document is toxic, and good enough.
TOXIC_FROM = 0.5
GOOD_FROM = 0.3

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents below the toxicity at which a text is rejected; empty texts stay.

    The classifier is fitted on the labelled documents among those given.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.train(docs, labels)
    return docs.filter(toxicity.toxicity(docs, model)["score"] < TOXIC_FROM)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of sufficient quality, by a scorer fitted on those given; empty texts are scored too."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = quality.train(docs, labels)
    return docs.filter(quality.quality(docs, model) >= GOOD_FROM)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that links of at least 0.8 over five-word shingles connect.

    The one with the least id stays; of those that share that id the one with the longest text,
    then the one with the least hash of id and text, then of the whole row, so reruns agree. Rows
    without id take part and come after all others. Rows without words (null, empty, blank texts)
    are linked with nothing and all stay. An empty table stays empty; further columns are kept.
    """
    # Rows take part by a hash of id and text, since ids may repeat or be missing; a hash of all
    # columns tells rows apart that share both.
    key = F.xxhash64("doc_id", "text")
    whole = F.xxhash64(*[F.col(f"`{f.name}`") for f in docs.schema if "map<" not in f.dataType.simpleString()])
    found = settled(jaccard.near_duplicates(docs.select(key.alias("doc_id"), "text"), jaccard.Rule(words=5, part=4, whole=5)))
    named = found.filter("n_shingles > 0").select(F.col("doc_id").alias("key"), "component_id").distinct()
    small = docs.select(key.alias("key"), whole.alias("whole"), "doc_id", F.length("text").alias("length"))
    first = F.struct(F.col("doc_id").isNull(), "doc_id", -F.col("length"), "key", "whole")
    # Each group's first row, and how many rows are alike in everything.
    kept = (
        small.groupBy("key", "whole").agg(F.first("doc_id").alias("doc_id"), F.first("length").alias("length"), F.count("*").alias("n"))
        .join(named, "key").groupBy("component_id").agg(F.min(F.struct(first.alias("first"), "n")).alias("kept"))
        .select("kept.first.key", "kept.first.whole", "kept.n")
    )
    bare = found.filter("n_shingles = 0").select(F.col("doc_id").alias("key")).distinct()
    wanted = settled(kept.unionByName(bare.select("key", F.lit(None).cast("long").alias("whole"), F.lit(0).cast("long").alias("n"))))
    # The row travels as one struct, so its columns may have any names.
    rows = docs.select(key.alias("key"), whole.alias("own"), F.struct("*").alias("row")).join(
        wanted, "key"
    ).filter(F.col("whole").isNull() | (F.col("whole") == F.col("own")))
    # Of rows alike in everything one stays; the join has sorted by key, so this moves nothing.
    turn = F.row_number().over(Window.partitionBy("key").orderBy("key"))
    one = rows.withColumn("turn", turn).filter("n < 2 or turn = 1")
    return one.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources by weight takes them, by shard and shuffled there.

    The last document of a source is cut where its quota ends. Rows without words are not taken;
    rows alike in id and text are merged into one that is taken as often as all of them. Rows
    without source are one source. An empty table stays empty; further columns are kept.
    """
    return mixing.mixed_texts(docs, mixing.mix(docs))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of tokens, without their other columns.

    Null and empty texts are the end of a document alone; repeated rows are packed again; an empty
    table has no pieces.
    """
    return packing.packed(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", toxicity_stage),
    ("quality", quality_stage),
    ("near_duplicates", near_duplicate_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]

#: The first stages are trained classifiers, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to ``documents``, each result written and read again."""
    folder = f"{ensure_checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{number}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
