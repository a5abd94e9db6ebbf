"""Look-up of form rows by two keys whose hits must agree, and the annotator overview.

Rows are counted per key and per key pair before the join, so a key on many rows costs
one count and never multiplies out.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dossier.functions.text import sheet_key
from dossier.operators.spread import lookup_join

BOTH, ONE_SAP, ONE_TC = "BOTH", "SAP", "TEAMCENTER"
NONE, DIFFERENT, SEVERAL = "NONE", "DIFFERENT_ROWS", "AMBIGUOUS"
ERRORS = (DIFFERENT, SEVERAL)


def find_rows(
    target: DataFrame, source: DataFrame, payload: Sequence[str], within: Sequence[str] = (),
    spread_by: Sequence[str] = ("row_no",), numeric: bool = False,
) -> DataFrame:
    """``target`` with the outcome and the payload of its row in ``source``.

    Both have ``sap`` and ``teamcenter``; ``source`` also has ``row_no``. ``within`` names
    columns that both share and that separate independent sources. If both keys hit, the
    rows hit by both must be exactly one; none is an error. Otherwise a single hit of the
    first key, then of the second, is taken; several are an error. With ``numeric`` ids that a
    sheet stored as numbers (``123.0``) are read as whole numbers on both sides.
    """
    within = list(within)

    def key(name: str) -> Column:
        value = F.col(name).cast("string")
        if numeric:
            value = F.regexp_replace(value, r"^(\s*\d+)\.0+(\s*)$", "$1$2")
        return F.nullif(sheet_key(value), F.lit(""))

    none = F.lit(None).cast("string")
    rows = source.select(*within, key("sap").alias("_sap"), key("teamcenter").alias("_tc"),
                         F.struct("row_no", *payload).alias("_row"))
    kinds = F.explode(F.array(*[
        F.struct(F.lit(tag).alias("tag"), sap.alias("sap"), tc.alias("tc"))
        for tag, sap, tc in (("s", F.col("_sap"), none), ("t", none, F.col("_tc")),
                             ("b", F.col("_sap"), F.col("_tc")))
    ]))
    needed = {"s": "k.sap is not null", "t": "k.tc is not null",
              "b": "k.sap is not null and k.tc is not null"}
    usable = " or ".join(f"(k.tag = '{tag}' and {test})" for tag, test in needed.items())
    # One pass over the source counts it by the first key, the second and both.
    lookups = (
        rows.select(*within, "_row", kinds.alias("k")).where(usable)
        .groupBy(*within, "k.tag", F.col("k.sap").alias("_sap"), F.col("k.tc").alias("_tc"))
        .agg(F.count("*").alias("_n"), F.min("_row").alias("_row"))
    )
    found = target.withColumn("_sap", key("sap")).withColumn("_tc", key("teamcenter"))
    for tag, keys in (("s", ["_sap"]), ("t", ["_tc"]), ("b", ["_sap", "_tc"])):
        lookup = lookups.where(F.col("tag") == tag).select(
            *within, *keys, F.col("_n").alias(f"_n{tag}"), F.col("_row").alias(f"_row_{tag}")
        )
        found = lookup_join(found, lookup, [*within, *keys], spread_by)
    found = found.na.fill(0, ["_ns", "_nt", "_nb"])
    both_hit = (F.col("_ns") > 0) & (F.col("_nt") > 0)
    outcome = (
        F.when(both_hit & (F.col("_nb") == 1), BOTH)
        .when(both_hit & (F.col("_nb") == 0), DIFFERENT)
        .when(F.col("_ns") == 1, ONE_SAP).when(F.col("_nt") == 1, ONE_TC)
        .when((F.col("_ns") == 0) & (F.col("_nt") == 0), NONE).otherwise(SEVERAL)
    )
    row = (
        F.when(outcome == BOTH, F.col("_row_b")).when(outcome == ONE_SAP, F.col("_row_s"))
        .when(outcome == ONE_TC, F.col("_row_t"))
    )
    return found.select(
        *target.columns, outcome.alias("outcome"), row["row_no"].alias("found_row"),
        *[row[name].alias(f"found_{name}") for name in payload],
    )


def require_clean(found: DataFrame, source_name: str) -> None:
    bad = found.where(F.col("outcome").isin(*ERRORS)).orderBy("row_no").limit(1).collect()
    if bad:
        what = "belong to different rows" if bad[0].outcome == DIFFERENT else "are on several rows"
        raise ValueError(f"{source_name}: the ids {bad[0].sap!r} and {bad[0].teamcenter!r} {what}")


def annotations_long(
    order: DataFrame, forms: DataFrame, participants: Sequence[str]
) -> DataFrame:
    """Label of every participant for every row of the order form.

    ``order(row_no, sap, teamcenter)``; ``forms(participant, row_no, sap, teamcenter,
    label)``. Each participant is one column of the later overview.
    """
    keyed = order.where(
        (sheet_key(F.col("sap")) != "") | (sheet_key(F.col("teamcenter")) != "")
    ).withColumn("participant", F.explode(F.array(*[F.lit(p) for p in participants])))
    return find_rows(keyed, forms, ["label"], within=["participant"],
                     spread_by=["row_no", "participant"])


def annotation_overview(
    order: DataFrame, truth: DataFrame, forms: DataFrame, participants: Sequence[str],
    info: Sequence[str] = (),
) -> DataFrame:
    """Wide table in the order form's order: information columns and truth of the row's
    truth entry, then one label column per participant."""
    return overview_of(
        find_rows(order, truth, ["label", *info]), annotations_long(order, forms, participants), participants, info
    )


def overview_of(
    entries: DataFrame, labels: DataFrame, participants: Sequence[str], info: Sequence[str] = ()
) -> DataFrame:
    """The overview from the look-ups of the truth and of the forms."""
    entries = entries.select(
        "row_no", "sap", "teamcenter", F.col("outcome").alias("truth_outcome"),
        *[F.col(f"found_{name}").alias(name) for name in info],
        F.col("found_label").alias("ground_truth"),
    )
    wide = labels.groupBy("row_no").pivot("participant", list(participants)).agg(
        F.first("found_label", ignorenulls=True)
    )
    return entries.join(wide, "row_no", "left")
