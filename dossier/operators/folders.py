"""Match of folders to the master list by ids standing alone in folder names, and every
conflict that match can have.

``items(row_no, sap, teamcenter)``: master list. ``folders(category, folder, path)``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dossier.functions.ids import embedded_ids
from dossier.functions.text import fold, master_id
from dossier.operators.spread import listed_in_parts, lookup_join, numbered

MATCHED, UNMATCHED, AMBIGUOUS = "MATCHED", "UNMATCHED", "AMBIGUOUS"
# Names of the id columns and kinds of a match in the reports.
SAP_NAME, TC_NAME = "SAP-Nummer", "Teamcenter ID"
EXACT_KIND, CONTAINED_KIND = "exact folder name", "ID contained in folder name"


def master_items(items: DataFrame) -> DataFrame:
    """Ids stripped and upper case; rows without any id are dropped."""
    return items.select(
        "row_no", master_id(F.col("sap")).alias("sap"),
        master_id(F.col("teamcenter")).alias("teamcenter"),
    ).where("sap <> '' or teamcenter <> ''")


def id_rows(items: DataFrame) -> DataFrame:
    """Long index: one row per id and list row."""
    ids = F.explode(F.array_distinct(F.array("sap", "teamcenter"))).alias("id")
    return master_items(items).select(ids, "row_no", "sap", "teamcenter").where("id <> ''")


def id_index(items: DataFrame) -> DataFrame:
    """Per id the number of list rows and its first row (the only one when ``n`` is 1)."""
    return id_rows(items).groupBy("id").agg(
        F.count("*").alias("n"), F.min(F.struct("row_no", "sap", "teamcenter")).alias("item")
    )


def _shared_rows(items: DataFrame) -> DataFrame:
    """Number of list rows per pair of different ids."""
    return (
        master_items(items).where("sap <> '' and teamcenter <> '' and sap <> teamcenter")
        .groupBy(F.least("sap", "teamcenter").alias("low"),
                 F.greatest("sap", "teamcenter").alias("high"))
        .agg(F.count("*").alias("shared"))
    )


def folder_matches(items: DataFrame, folders: DataFrame) -> DataFrame:
    """One row per folder: matched to one list row, unmatched, or ambiguous.

    The number of list rows behind a folder is counted from per-id and per-pair counts, so
    an id on many rows named by many folders never multiplies out. A list row has at most
    two ids, so it is counted twice exactly when both were found.
    """
    named = folders.withColumn("ids", embedded_ids(master_id(F.col("folder"))))
    none = F.lit(None).cast("string")
    singles = F.transform(
        "ids", lambda x, at: F.struct(at.alias("pos"), x.alias("id"), none.alias("low"), none.alias("high"))
    )
    pairs = F.flatten(F.transform("ids", lambda x: F.transform(
        F.filter("ids", lambda y: x < y),
        lambda y: F.struct(F.lit(None).cast("int").alias("pos"), none.alias("id"), x.alias("low"), y.alias("high")),
    )))
    entries = named.select(
        "category", "folder", "path", F.explode_outer(F.concat(singles, pairs)).alias("e")
    ).select("category", "folder", "path", "e.*")
    looked = lookup_join(entries, id_index(items), ["id"], ["path"])
    looked = lookup_join(looked, _shared_rows(items), ["low", "high"], ["path"])
    known = F.when(F.col("n").isNotNull(), F.struct("pos", "id"))
    joined = (
        looked.groupBy("category", "folder", "path").agg(
            F.array_sort(F.collect_list(known)).alias("placed"),  # ids within one name
            F.sum("n").alias("n_sum"), F.sum("shared").alias("twice"), F.min("item").alias("item"),
        )
        .withColumn("n_rows", F.coalesce("n_sum", F.lit(0)) - F.coalesce("twice", F.lit(0)))
        .withColumn("found_ids", F.when(F.size("placed") > 0, F.transform("placed", lambda x: x["id"])))
    )
    one = F.col("n_rows") == 1
    by = F.concat_ws(
        " + ",
        F.when(F.array_contains("found_ids", F.col("item.sap")), SAP_NAME),
        F.when(F.array_contains("found_ids", F.col("item.teamcenter")), TC_NAME),
    )
    exact = F.array_contains("found_ids", master_id(F.col("folder")))
    return joined.select(
        "category", "folder", "path",
        F.when(one, MATCHED).when(F.col("n_rows") == 0, UNMATCHED).otherwise(AMBIGUOUS).alias("status"),
        "n_rows", F.array_join("found_ids", ", ").alias("found_ids"),
        F.when(one, F.col("item.row_no")).alias("row_no"),
        F.when(one, F.col("item.sap")).alias("sap"),
        F.when(one, F.col("item.teamcenter")).alias("teamcenter"),
        F.when(one, by).alias("matched_by"),
        F.when(one, F.when(exact, EXACT_KIND).otherwise(CONTAINED_KIND)).alias("match_kind"),
    )


def _members(rows: DataFrame, keys: list[str], total: str) -> DataFrame:
    """Rows whose keys are on more than one row, with their number. Counts are made before the
    join, which adaptive execution splits where a key is frequent."""
    several = rows.groupBy(*keys).agg(F.count("*").alias(total)).where(F.col(total) > 1)
    return rows.join(several, keys)


def ambiguous_id_rows(items: DataFrame) -> DataFrame:
    """Ids on more than one list row: a row for each, with their number."""
    return _members(id_rows(items).select("id", "row_no"), ["id"], "n_rows")


def ambiguous_ids(items: DataFrame) -> DataFrame:
    """``ambiguous_id_rows`` as lists (long ones continue in further parts)."""
    parts = listed_in_parts(
        ambiguous_id_rows(items), ["id", "n_rows"], ["row_no"], F.col("row_no").cast("string"), "rows"
    )
    return parts.withColumn("rows", F.array_join("rows", ", "))


def _scan_ordered(matched: DataFrame) -> DataFrame:
    return matched.withColumn("_cat", fold(F.col("category"))).withColumn("_name", fold(F.col("folder")))


def duplicate_name_rows(matched: DataFrame) -> DataFrame:
    """Matched folders that share their name with others, over all categories, a row for each."""
    named = matched.select(master_id(F.col("folder")).alias("name"), "category", "folder", "path")
    return _members(named, ["name"], "n_folders")


def duplicate_names(matched: DataFrame) -> DataFrame:
    """``duplicate_name_rows`` as lists."""
    parts = listed_in_parts(
        _scan_ordered(duplicate_name_rows(matched)), ["name", "n_folders"], ["_cat", "_name", "path"],
        F.struct("category", "path"), "members",
    )
    return parts.select(
        "name", "n_folders", "part",
        F.array_join(F.transform("members", lambda m: m["category"]), " | ").alias("categories"),
        F.array_join(F.transform("members", lambda m: m["path"]), " | ").alias("paths"),
    )


def several_folder_rows(matched: DataFrame) -> DataFrame:
    """Folders that matched the same list row as others, a row for each."""
    placed = matched.select("row_no", "sap", "teamcenter", "category", "folder", "path")
    return _members(placed, ["row_no"], "n_folders")


def several_folders(matched: DataFrame) -> DataFrame:
    """``several_folder_rows`` as lists."""
    parts = listed_in_parts(
        _scan_ordered(several_folder_rows(matched)), ["row_no", "sap", "teamcenter", "n_folders"],
        ["_cat", "_name", "path"], F.struct("folder", "path"), "members",
    )
    return parts.select(
        "row_no", "sap", "teamcenter", "n_folders", "part",
        F.array_join(F.transform("members", lambda m: m["folder"]), " | ").alias("folders"),
        F.array_join(F.transform("members", lambda m: m["path"]), " | ").alias("paths"),
    )


def missing_items(items: DataFrame, matched: DataFrame) -> DataFrame:
    """List rows without a uniquely matched folder."""
    return master_items(items).join(matched.select("row_no").distinct(), "row_no", "left_anti")


def conflict_counts(items: DataFrame, matches: DataFrame) -> DataFrame:
    """One row: size of each conflict set, and whether any blocks the copy."""
    matched = matches.where(F.col("status") == MATCHED)

    def groups(df: DataFrame, *keys) -> DataFrame:
        return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")

    def counted(df: DataFrame, name: str) -> DataFrame:
        return df.agg(F.count("*").alias("n")).select(F.lit(name).alias("kind"), "n")

    kinds = ["ambiguous_folders", "ambiguous_ids", "duplicate_names", "several_folders"]
    long = (
        counted(matches.where(F.col("status") == AMBIGUOUS), kinds[0])
        .union(counted(id_index(items).where("n > 1"), kinds[1]))
        .union(counted(groups(matched, master_id(F.col("folder"))), kinds[2]))
        .union(counted(groups(matched, "row_no"), kinds[3]))
    )
    sums = long.agg(*[F.sum(F.when(F.col("kind") == kind, F.col("n"))).alias(kind) for kind in kinds])
    total = F.col(kinds[0]) + F.col(kinds[1]) + F.col(kinds[2]) + F.col(kinds[3])
    return sums.withColumn("conflicts", total).withColumn("blocked", total > 0)


def require_no_conflicts(items: DataFrame, matches: DataFrame) -> None:
    counts = conflict_counts(items, matches).first()
    if counts.blocked:
        raise RuntimeError(
            f"There are conflicts of ids or folders, so nothing is copied; see the reports: {counts.asDict()}"
        )


def require_empty_target(existing: DataFrame) -> None:
    """``existing`` lists what the target folder holds; a copy into a used folder is refused."""
    if not existing.isEmpty():
        raise FileExistsError("The target folder is not empty, so nothing is copied.")


def copy_plan(matched: DataFrame, target: str, blocked_reason: str | None = None) -> DataFrame:
    """Source and destination of every matched folder, in scan order."""
    plan = numbered(_scan_ordered(matched), [], ["_cat", "_name", "path"], "n")
    return plan.select(
        "n", "folder", F.col("path").alias("source"),
        F.concat(F.lit(target.rstrip("/") + "/"), F.col("folder")).alias("destination"),
        F.lit(blocked_reason).cast("string").alias("blocked_reason"),
    )
