"""Question sheets: one id column, every other header is a question."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dossier.functions.text import strip


def to_long(sheet: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, question, answer): one row per cell."""
    questions = [name for name in sheet.columns if name not in keys]
    text = sheet.select(*keys, *[F.col(f"`{q}`").cast("string").alias(q) for q in questions])
    return text.unpivot(list(keys), [F.col(f"`{q}`") for q in questions], "question", "answer")


def is_blank(answer: Column) -> Column:
    return answer.isNull() | (strip(answer) == "")


def open_questions(long: DataFrame, id_column: str) -> DataFrame:
    """Cells still to be asked: blank, on a row with an id."""
    return long.where(F.col(id_column).isNotNull() & is_blank(F.col("answer")))


def expected_calls(long: DataFrame, id_column: str) -> DataFrame:
    """Number of requests a run will make: one per blank cell."""
    return long.where(F.col(id_column).isNotNull()).groupBy("question").agg(
        F.count_if(is_blank(F.col("answer"))).alias("calls"), F.count("*").alias("cells")
    )


def to_wide(long: DataFrame, keys: Sequence[str], questions: Sequence[str]) -> DataFrame:
    return long.groupBy(*keys).pivot("question", list(questions)).agg(
        F.first("answer", ignorenulls=True)
    )
