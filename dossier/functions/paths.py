"""Parts of file paths. Separators are ``/``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from dossier.functions.text import fold, let

# File suffix to media type of what a request may carry.
MEDIA_TYPES = {
    ".pdf": "application/pdf",
    ".png": "image/png",
    ".jpg": "image/jpeg",
    ".jpeg": "image/jpeg",
}
SUPPORTED_SUFFIXES = tuple(MEDIA_TYPES)

# What the all-readable-files run accepts.
READABLE_SUFFIXES = (
    ".pdf", ".txt", ".md", ".csv", ".json", ".xml", ".jpg", ".jpeg", ".png", ".webp",
)
SPREADSHEET_SUFFIXES = (".xlsx", ".xls", ".xlsm", ".xlsb")
MAX_FILE_BYTES = 20 * 1024 * 1024

# Fixed value: directory whose files are never sent, compared without case.
IGNORE_DIRECTORY = "_llm_ignore"
LOCK_PREFIX = "~$"


def file_name(rel_path: Column) -> Column:
    return F.substring_index(rel_path, "/", -1)


def parent_dir(rel_path: Column) -> Column:
    """Directory of a path, blank for a file at the top."""
    return F.substring(rel_path, F.lit(1), F.length(rel_path) - F.length(file_name(rel_path)) - 1)


def suffix(name: Column) -> Column:
    """Lower-case suffix with its dot; blank for none and for dot files."""
    shown = F.ltrim(name, F.lit("."))
    last = F.substring_index(shown, ".", -1)
    has_one = (F.length(last) < F.length(shown)) & (last != "")
    return F.when(has_one, F.lower(F.concat(F.lit("."), last))).otherwise("")


def stem(name: Column) -> Column:
    return F.substring(name, F.lit(1), F.length(name) - F.length(suffix(name)))


def size_mb(length: Column) -> Column:
    """Mebibytes to three decimals, halves to even."""
    return F.bround(length / F.lit(1048576.0), 3)


def media_type(suffix_col: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in MEDIA_TYPES.items() for x in pair])
    return table[suffix_col]


def is_lock_file(name: Column) -> Column:
    return name.startswith(LOCK_PREFIX)


def in_ignore_dir(rel_path: Column, directory: str = IGNORE_DIRECTORY) -> Column:
    """True when any directory of the path, not the file name, is the ignore directory."""
    return F.array_contains(F.split(fold(parent_dir(rel_path)), "/"), directory)


# Names of the reasons.
LOCK_FILE = "Temporaere Datei"
HIDDEN = "Versteckte Datei"
SPREADSHEET = "Excel uebersprungen"
UNSUPPORTED = "Dateityp nicht unterstuetzt"
EMPTY = "Leere Datei"
TOO_LARGE = "Datei zu gross"


def skip_reason(rel_path: Column, length: Column) -> Column:
    """First reason that keeps a file out of a request, null when it may be sent."""

    def reason(path: Column, name: Column, ext: Column) -> Column:
        return (
            F.when(is_lock_file(name), LOCK_FILE)
            .when(path.rlike(r"(^|/)\."), HIDDEN)
            .when(ext.isin(*SPREADSHEET_SUFFIXES), SPREADSHEET)
            .when(~ext.isin(*READABLE_SUFFIXES), UNSUPPORTED)
            .when(length == 0, EMPTY)
            .when(length > MAX_FILE_BYTES, TOO_LARGE)
        )

    return let(rel_path, lambda path: let(file_name(path), lambda name: let(suffix(name), lambda ext: reason(path, name, ext))))


def current_path(root: Column, folder: Column, subfolder: Column, name: Column) -> Column:
    """Path of an inventory row below today's root; blank and dot subfolders are left out."""
    used = F.when(~F.coalesce(subfolder, F.lit("")).isin("", ".", "./", ".\\"), subfolder)
    return F.concat_ws("/", root, folder, used, name)


def directory_prefixes(directory: Column) -> Column:
    """Every directory on the way down to ``directory``: ``a/b`` -> ``[a, a/b]``."""
    parts = F.filter(F.split(directory, "/"), lambda part: part != "")
    return F.when(
        F.size(parts) > 0,
        F.transform(
            F.sequence(F.lit(1), F.size(parts)),
            lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"),
        ),
    ).otherwise(F.expr("array()").cast("array<string>"))
