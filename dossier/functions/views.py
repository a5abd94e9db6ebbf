"""Viewing directions of a CAD screenshot as a bit mask."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column
from pyspark.sql import functions as F

from dossier.functions.paths import stem
from dossier.functions.text import fold

# Directions in naming order, their words, and the letter of each in a
# compact three-letter code (vertical, side, depth).
DIRECTIONS = ("top", "bottom", "left", "right", "front", "back")
DIRECTION_WORDS = {
    "top": ("top", "oben"),
    "bottom": ("bottom", "unten"),
    "left": ("left", "links", "linke", "linker"),
    "right": ("right", "rechts", "rechte", "rechter"),
    "front": ("front", "vorne", "vorn", "vorder"),
    "back": ("back", "rear", "hinten", "rueck", "ruck", "rück"),
}
CODE_LETTER = {
    "top": (1, "T"), "bottom": (1, "B"), "left": (2, "L"),
    "right": (2, "R"), "front": (3, "F"), "back": (3, "B"),
}
COMPACT_CODE = r"(?:^|[^A-Z0-9])([TB][LR][FB])(?:$|[^A-Z0-9])"

BIT = {name: 1 << position for position, name in enumerate(DIRECTIONS)}


def view_code(name: Column) -> Column:
    """Compact three-letter code in a file name, blank for none."""
    return F.regexp_extract(F.upper(stem(name)), COMPACT_CODE, 1)


def view_words(name: Column) -> Column:
    return F.split(fold(stem(name)), "[^a-zäöüß]+")


def view_mask(code: Column, words: Column) -> Column:
    """Six-bit mask of the directions named by a file; a compact code wins over words."""

    def bit(direction: str) -> Column:
        place, letter = CODE_LETTER[direction]
        by_code = F.substring(code, place, 1) == letter
        aliases = F.array(*[F.lit(word) for word in DIRECTION_WORDS[direction]])
        hit = F.when(code != "", by_code).otherwise(F.arrays_overlap(words, aliases))
        return F.when(hit, F.lit(BIT[direction])).otherwise(F.lit(0))

    return reduce(add, (bit(direction) for direction in DIRECTIONS))


def view_name(mask: Column) -> Column:
    return F.concat_ws(
        "_", *[F.when(mask.bitwiseAND(F.lit(BIT[d])) != 0, F.lit(d)) for d in DIRECTIONS]
    )
