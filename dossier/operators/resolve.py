"""Resolution of inventory rows to files that exist today."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dossier.functions.paths import current_path
from dossier.functions.text import fold, known_text, strip, text_or_blank
from dossier.operators.spread import best_rows, listed_in_parts

# Where a resolved path came from, and the marks for existence.
FROM_CURRENT, FROM_INVENTORY = "current_folder", "inventory_full_path_fallback"
SENT_PRIORITIES = ("priority_1_candidate", "priority_2_candidate")


def with_priority(inventory: DataFrame, priorities: Sequence[str] = SENT_PRIORITIES) -> DataFrame:
    wanted = [value.casefold() for value in priorities]
    return inventory.where(fold(strip(F.col("priority"))).isin(*wanted))


def resolve_files(
    inventory: DataFrame, listing: DataFrame, root: str,
    priorities: Sequence[str] = SENT_PRIORITIES,
) -> DataFrame:
    """One row per selected file and resolved path.

    ``inventory(assembly, relative_subfolder, file_name, file_path, priority)`` and
    ``listing(path)`` of existing files. The path below ``root`` comes first, then the
    path noted in the inventory, else the file is missing under its current path.
    """
    # Cells are stripped in a projection of their own, so each is stripped once.
    cells = ("relative_subfolder", "file_name", "file_path")
    rows = (
        with_priority(inventory, priorities)
        .withColumns({f"_{c}": text_or_blank(F.col(c)) for c in cells})
        .withColumns({f"_{c}": known_text(F.col(f"_{c}")) for c in cells})
        .withColumn("current", current_path(F.lit(root), F.col("assembly"), F.col("_relative_subfolder"), F.col("_file_name")))
        .withColumn("noted", F.nullif(F.col("_file_path"), F.lit("")))
        .withColumn("_hash", F.xxhash64("current"))
    )
    # Paths begin alike, so sorts would compare them to the end: their hash comes first as a key.
    existing = listing.select(F.xxhash64("path").alias("_hash"), "path").distinct()
    # Rows that need no second look have no path to look for and, so that they do not all meet
    # in one task, the hash of the first.
    found = (
        rows.join(existing.select("_hash", F.col("path").alias("current"), F.lit(True).alias("_now")),
                  ["_hash", "current"], "left")
        .withColumn("_look", F.when(F.col("_now").isNull(), F.col("noted")))
        .withColumn("_hash", F.xxhash64(F.coalesce("_look", "current")))
        .join(existing.select("_hash", F.col("path").alias("_look"), F.lit(True).alias("_old")),
              ["_hash", "_look"], "left")
    )
    use_old = F.coalesce(F.col("_old"), F.lit(False))
    resolved = found.select(
        "assembly", "file_name", "relative_subfolder", "priority",
        F.when(use_old, F.col("_look")).otherwise(F.col("current")).alias("resolved_path"),
        F.when(use_old, FROM_INVENTORY).otherwise(FROM_CURRENT).alias("path_source"),
        (F.coalesce(F.col("_now"), F.lit(False)) | use_old).alias("exists"),
    )
    order = [fold(F.col("file_name")), "file_name", "relative_subfolder", "priority"]
    return best_rows(resolved, ["assembly", "resolved_path"], order).withColumn(
        "exists_mark", F.when(F.col("exists"), "ja").otherwise("nein")
    )


def file_counts(resolved: DataFrame) -> DataFrame:
    """Existing and missing files per assembly."""
    return resolved.groupBy("assembly").agg(
        F.count_if("exists").alias("existing"), F.count_if(~F.col("exists")).alias("missing")
    )


def file_lists(resolved: DataFrame) -> DataFrame:
    """Selected file names, existing ones first, and missing paths per assembly as text."""
    rows = resolved.withColumn("_gone", (~F.col("exists")).cast("int")).withColumn(
        "_fold", fold(F.col("file_name"))
    )
    parts = listed_in_parts(
        rows, ["assembly"], ["_gone", "_fold", "file_name", "resolved_path"],
        F.struct("file_name", "resolved_path", "exists"), "members",
    )
    gone = F.filter("members", lambda m: ~m["exists"])
    return parts.select(
        "assembly", "part",
        F.array_join(F.transform("members", lambda m: m["file_name"]), "\n").alias("files"),
        F.array_join(F.transform(gone, lambda m: m["resolved_path"]), "\n").alias("missing_files"),
    )
