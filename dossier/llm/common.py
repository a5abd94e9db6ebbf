"""Helpers that several operators of this package share."""

from __future__ import annotations

import gc

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dossier.session import ensure_checkpoint_dir

#: Labelled rows that a classifier is fitted on, about; larger sets are thinned by hash.
FIT_ROWS = 30_000


def settled(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept in the folder that all executors share."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def freed(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files and checkpoints of tables that are out of use.

    It does so once the driver's JVM has collected them, which alone may come much later.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def remainder(column: str, divisor: int) -> Column:
    """Remainder of the CRC-32 of an id written as text."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % divisor


def unit(*columns: Column | str, seed: int) -> Column:
    """A number from 0 up to 1 that depends on the columns and the seed only."""
    bits = F.shiftrightunsigned(F.xxhash64(F.lit(seed), *columns), 11)
    return bits / F.lit(float(1 << 53))


def thinned(df: DataFrame, rows: int, *columns: str, seed: int = 11) -> DataFrame:
    """About ``rows`` rows of ``df`` chosen by hash of the columns; all of them if fewer."""
    share = rows / max(rows, df.count())
    return df if share == 1 else df.filter(unit(*columns, seed=seed) < share)


def fit_labels(labels: DataFrame, label: str, folds: int = 5, id_column: str = "doc_id") -> DataFrame:
    """``doc_id, label`` of the rows to learn from: fold 0 by CRC-32 of the id is held out.

    Rows without id or label are left out; an id labelled several times has its highest label.
    """
    rows = labels.select(F.col(id_column).cast("long").alias("doc_id"), F.col(label).cast("int").alias("label"))
    return (
        rows.na.drop().filter(remainder("doc_id", folds) != 0)
        .groupBy("doc_id").agg(F.max("label").alias("label"))
    )


def unused(df: DataFrame, name: str) -> str:
    """``name``, with underscores before it until no column of ``df`` has that name."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name
