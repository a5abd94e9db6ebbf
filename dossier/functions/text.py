"""Text normalisation. Each named mode gives different keys, so they are kept apart."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Every code point that counts as white space when text is stripped.
WHITESPACE = "".join(
    chr(code)
    for code in (
        *range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B),
        0x2028, 0x2029, 0x202F, 0x205F, 0x3000,
    )
)

# Cell texts that mean "empty".
EMPTY_WORDS = ("nan", "none")

# Text of a number as a spreadsheet or a float parser accepts it.
NUMBER = r"^[+-]?((\d+(_\d+)*)(\.(\d+(_\d+)*)?)?|\.\d+(_\d+)*)([eE][+-]?\d+)?$"


NUMBER_STARTS = tuple("+-.0123456789")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is evaluated once, however often ``body`` names it.

    A filter on a long rule chain is pushed below the projection that defines it, and there
    common parts are not shared; this keeps such a chain small.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(WHITESPACE))


def fold(c: Column) -> Column:
    """Lower case that also maps the sharp s to ``ss``."""
    return F.replace(F.lower(c), F.lit("ß"), F.lit("ss"))


def text_or_blank(c: Column) -> Column:
    return strip(F.coalesce(c.cast("string"), F.lit("")))


def master_id(c: Column) -> Column:
    """Id of the master list: stripped and upper case, null becomes blank."""
    return F.upper(text_or_blank(c))


def plain_id(c: Column) -> Column:
    """Id for comparison: integral numbers lose sign, zeros and ``.0``; then only letters
    and digits, lower case. ``0804.0`` -> ``804``, ``AB-12`` -> ``ab12``.

    Numbers go through a double as in a spreadsheet, so exponents are read and digits past
    2**53 are rounded; from 2**63 on the digits are kept as written.
    """
    raw = text_or_blank(c)
    # Most numbers are short runs of digits, some with ``.0``: these only lose zeros.
    base = F.when(raw.endswith(".0"), F.substring(raw, F.lit(1), F.length(raw) - 2)).otherwise(raw)
    digits = (F.translate(base, "0123456789", "") == "") & F.length(base).between(1, 15)
    without_zeros = F.coalesce(F.nullif(F.ltrim(base, F.lit("0")), F.lit("")), F.lit("0"))
    number = F.replace(raw, F.lit("_"), F.lit("")).try_cast("double")
    is_whole = F.left(raw, F.lit(1)).isin(*NUMBER_STARTS) & raw.rlike(NUMBER) & (number == F.floor(number))
    repaired = F.when(digits, without_zeros).when(is_whole, number.try_cast("bigint").cast("string"))
    return F.lower(F.regexp_replace(F.coalesce(repaired, raw), "[^A-Za-z0-9]+", ""))


def cell_text(c: Column) -> Column:
    """Stripped cell; null and the words for "empty" become blank."""
    return known_text(text_or_blank(c))


def known_text(stripped: Column) -> Column:
    """Stripped text as it is, the words for "empty" as blank."""
    return F.when(fold(stripped).isin(*EMPTY_WORDS), F.lit("")).otherwise(stripped)


def cell_id(c: Column) -> Column:
    """Upper-case letters and digits of a cell, without numeric repair."""
    return F.regexp_replace(F.upper(cell_text(c)), "[^A-Z0-9]", "")


def search_cell(c: Column) -> Column:
    """Stripped cell with ``123.0`` repaired to ``123``; only ``nan`` counts as empty."""
    text = text_or_blank(c)
    return F.when(F.lower(text) == "nan", F.lit("")).otherwise(
        F.regexp_replace(text, r"^(\d+)\.0$", "$1")
    )


def search_id(c: Column) -> Column:
    return F.regexp_replace(F.upper(search_cell(c)), "[^A-Z0-9]", "")


def sheet_key(c: Column, numeric: bool = False) -> Column:
    """Key of a form row: stripped text, case kept. ``numeric`` is for columns read as
    numbers: integral values become integer text."""
    if numeric:
        whole = F.when(c == F.floor(c), c.try_cast("bigint").cast("string"))
        return F.coalesce(whole, c.cast("string"), F.lit(""))
    return text_or_blank(c)


def label_text(c: Column) -> Column:
    """Stripped label, case kept."""
    return text_or_blank(c)


def header_key(c: Column) -> Column:
    """Header reduced to lower-case ASCII letters and digits."""
    return F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9]", "")


def spaced(folded: Column) -> Column:
    """``_``, ``-`` and blanks reduced to single spaces."""
    return strip(F.regexp_replace(folded, r"(?U)[_\-\s]+", " "))


def search_text(c: Column) -> Column:
    return spaced(fold(c))


def contains_any(text: Column, words: Sequence[str]) -> Column:
    """True when any word occurs in the text. One pattern keeps the expression small."""
    return text.rlike("|".join(re.escape(word) for word in words))


def safe_name(c: Column, max_len: int = 90) -> Column:
    """Name usable as a file name on every system."""
    cleaned = F.btrim(F.regexp_replace(c, r"(?U)[^\w.\-]+", "_"), F.lit("._ "))
    return F.substring(F.coalesce(F.nullif(cleaned, F.lit("")), F.lit("unnamed")), 1, max_len)


def safe_model_name(c: Column) -> Column:
    cleaned = F.btrim(F.regexp_replace(c, "[^A-Za-z0-9_.-]+", "_"), F.lit("_"))
    return F.coalesce(F.nullif(cleaned, F.lit("")), F.lit("model"))


def model_from_file(file_name: Column, prefix: str = "classification_all_files_") -> Column:
    """Model name in a result file's name: between the prefix and the time stamp."""
    stem = F.regexp_replace(file_name, r"\.[^.]+$", "")
    rest = F.regexp_replace(
        F.substr(stem, F.lit(len(prefix) + 1)), r"_\d{4}-\d{2}-\d{2}_\d{2}-\d{2}-\d{2}$", ""
    )
    return F.when(stem.startswith(prefix), rest).otherwise(stem)


def stamp_text(ts: Column) -> Column:
    """Time of a run to the second, as text in the session's zone."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")


def utc_stamp_text(ts: Column) -> Column:
    """The same moment in UTC, with its offset."""
    utc = F.to_utc_timestamp(ts, F.current_timezone())
    return F.concat(F.date_format(utc, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("+00:00"))


def participant_from_file(file_name: Column, prefix: str) -> Column:
    """Participant in a form's file name: the part after the prefix."""
    stem = F.regexp_replace(file_name, r"\.[^.]+$", "")
    rest = F.when(stem.startswith(prefix), F.substr(stem, F.lit(len(prefix) + 1))).otherwise(stem)
    return F.coalesce(F.nullif(F.btrim(rest, F.lit(" _-")), F.lit("")), stem)
