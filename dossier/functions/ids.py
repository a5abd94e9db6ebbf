"""Ids inside names and parts of ids."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: length of an id that stands alone in a folder name.
EMBEDDED_ID_LENGTH = 10


def embedded_ids(name: Column, length: int = EMBEDDED_ID_LENGTH) -> Column:
    """Distinct runs of exactly ``length`` letters or digits, upper case, in order."""
    runs = F.split(F.upper(name), "[^A-Z0-9]+")
    return F.array_distinct(F.filter(runs, lambda run: F.length(run) == length))


def fragments(c: Column, minimum: int = 6) -> Column:
    """All distinct contiguous parts of an id down to ``minimum`` characters, longest
    first and from left to right."""
    size = F.length(c)
    lengths = F.when(size >= minimum, F.sequence(size, F.lit(minimum), F.lit(-1))).otherwise(
        F.expr("array()").cast("array<int>")
    )
    return F.array_distinct(
        F.flatten(
            F.transform(
                lengths,
                lambda n: F.transform(
                    F.sequence(F.lit(1), size - n + 1), lambda start: F.substring(c, start, n)
                ),
            )
        )
    )


def parts_of_lengths(c: Column, lengths: Sequence[int]) -> Column:
    """All distinct contiguous parts of the given lengths."""
    size = F.length(c)
    usable = F.filter(F.array(*[F.lit(int(n)) for n in lengths]), lambda n: n <= size)
    return F.array_distinct(
        F.flatten(
            F.transform(
                usable,
                lambda n: F.transform(
                    F.sequence(F.lit(1), size - n + 1), lambda start: F.substring(c, start, n)
                ),
            )
        )
    )
