"""Document type and send priority of a file, from its path text and suffix."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from dossier.functions.text import fold, let

# Suffix groups.
IMAGES = (".png", ".jpg", ".jpeg")
RAW_CAD = (".iam", ".ipt", ".stp", ".step")
SHEETS = (".xlsx", ".xls", ".csv")

# Words searched in the lower-case relative path, parents included.
ACCESS_WORDS = ("cad-zugriff", "cad_zugriff", "cad zugriff")
BOM_WORDS = ("stückliste", "stueckliste", "bom", "teileliste", "part list", "parts list")
DATASHEET_WORDS = ("datenblatt", "datasheet", "data sheet")
DRAWING_WORDS = ("zeichnung", "drawing", "technical drawing", "technische zeichnung")
SCREENSHOT_WORDS = ("screenshot", "view", "ansicht", "cad")
STRUCTURE_WORDS = ("struktur", "strucktur", "structure", "strukturbaum", "baugruppenstruktur")
STRONG_STRUCTURE_WORDS = ("strukturbaum", "baugruppenstruktur")
STRUCTURE_SOURCE = "dfc"

# Document type to send priority, today's table and the older one.
PRIORITY = {
    "Technische_Zeichnung": "priority_1_candidate",
    "DFC_structure_screenshot": "priority_2_candidate",
    "BOM": "priority_2_candidate",
    "Datenblatt": "priority_2_candidate",
    "Excel_unknown": "priority_2_candidate",
}
PRIORITY_OLDER = {
    "CAD_screenshot": "ja_candidate",
    "BOM": "ja_candidate",
    "Datenblatt": "maybe",
    "Technische_Zeichnung": "maybe",
    "Excel_unknown": "maybe",
    "PDF_unknown": "maybe",
}
NOT_SENT = "nein"
PRIORITY_VALUES = ("priority_1_candidate", "priority_2_candidate", "nein")


def _holds_any(path: Column, words: Sequence[str]) -> Column:
    """True when any word occurs in the path. Plain searches take a fraction of the time of one
    pattern of alternatives; words that hold another word of the list are found by that one."""
    least = [word for word in words if not any(other != word and other in word for other in words)]
    return reduce(or_, [path.contains(word) for word in least])


def is_structure_screenshot(path: Column, ext: Column) -> Column:
    """``path`` is folded already. The words hold no blank, ``_`` or ``-``, so it makes no difference
    to them whether those are reduced to single spaces."""
    from_source = path.contains(STRUCTURE_SOURCE) & _holds_any(path, STRUCTURE_WORDS)
    return ext.isin(*IMAGES) & (from_source | _holds_any(path, STRONG_STRUCTURE_WORDS))


def _rules(path: Column, ext: Column, older: bool) -> list[tuple[Column, str]]:
    """(condition, type) in order of precedence."""
    newer_only = [
        (is_structure_screenshot(path, ext), "DFC_structure_screenshot"),
        (ext == ".idw", "IDW_drawing"),
    ]
    return [
        (_holds_any(path, ACCESS_WORDS), "CAD_access_ignore"),
        *([] if older else newer_only),
        (_holds_any(path, BOM_WORDS), "BOM"),
        (_holds_any(path, DATASHEET_WORDS), "Datenblatt"),
        (_holds_any(path, DRAWING_WORDS), "Technische_Zeichnung"),
        (ext.isin(*RAW_CAD), "CAD_raw_ignore_first" if older else "CAD_raw"),
        (ext.isin(*IMAGES) | _holds_any(path, SCREENSHOT_WORDS), "CAD_screenshot"),
        (ext.isin(*SHEETS), "Excel_unknown"),
        (ext == ".pdf", "PDF_unknown" if older else "Technische_Zeichnung"),
    ]


def type_of(folded: Column, ext: Column, older: bool = False) -> Column:
    """Type of a file by its folded path and its suffix: the first rule that holds."""
    first, *rest = _rules(folded, ext, older)
    return reduce(lambda acc, rule: acc.when(*rule), rest, F.when(*first)).otherwise("unknown")


def doc_type(rel_path: Column, ext: Column, older: bool = False) -> Column:
    return let(
        F.struct(fold(rel_path).alias("path"), ext.alias("ext")),
        lambda file: type_of(file["path"], file["ext"], older),
    )


def send_priority(type_col: Column, older: bool = False) -> Column:
    table = PRIORITY_OLDER if older else PRIORITY
    lookup = F.create_map(*[F.lit(x) for pair in table.items() for x in pair])
    return F.coalesce(lookup[type_col], F.lit(NOT_SENT))
