"""Ground-truth lookups and the match of predictions to them by id with fallback."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dossier.functions.text import label_text, plain_id
from dossier.operators.spread import lookup_join

# How a prediction found its truth.
BY_SAP, BY_TEAMCENTER, NOT_MATCHED = "SAP", "TEAMCENTER", "NOT_MATCHED"
ID_TYPES = {"sap": "SAP", "teamcenter": "Teamcenter"}


def _blank_to_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def _keyed_truth(truth: DataFrame, id_columns: Sequence[str]) -> DataFrame:
    """(id_type, key, label, row_no) of rows with both an id and a label, in one pass."""
    ids = F.explode(F.array(*[
        F.struct(F.lit(ID_TYPES.get(c, c)).alias("id_type"), plain_id(F.col(c)).alias("key"))
        for c in id_columns
    ]))
    return (
        truth.select(label_text(F.col("label")).alias("label"), "row_no", ids.alias("id"))
        .where("id.key <> '' and label <> ''").select("id.id_type", "id.key", "label", "row_no")
    )


def truth_lookups(truth: DataFrame, id_columns: Sequence[str] = ("sap", "teamcenter")) -> DataFrame:
    """One row per id type and id: its label and the last row that names it."""
    return _keyed_truth(truth, id_columns).groupBy("id_type", "key").agg(
        F.max_by("label", "row_no").alias("label"), F.max("row_no").alias("row_no")
    )


def truth_conflicts(truth: DataFrame, id_columns: Sequence[str] = ("sap", "teamcenter")) -> DataFrame:
    """Ids with more than one label: each of their labels and the row where it starts."""
    key = ["id_type", "key"]
    per_label = _keyed_truth(truth, id_columns).groupBy(*key, "label").agg(
        F.min("row_no").alias("first_row")
    )
    several = per_label.groupBy(*key).agg(F.count("*").alias("n_labels")).where("n_labels > 1")
    return several.join(per_label, key).select(*key, "n_labels", "label", "first_row")


def require_consistent_truth(truth: DataFrame, id_columns: Sequence[str] = ("sap", "teamcenter")) -> None:
    found = truth_conflicts(truth, id_columns).orderBy("id_type", "key", "first_row").limit(2).collect()
    if found:
        labels = "; ".join(f"{c.label!r} from row {c.first_row}" for c in found)
        raise ValueError(
            f"The truth gives {found[0].n_labels} labels to the {found[0].id_type} id {found[0].key!r}: {labels}"
        )


def match_predictions(predictions: DataFrame, truth: DataFrame) -> DataFrame:
    """Every prediction row with its truth: by the first id, else by the second.

    ``predictions(model, row_no, sap, teamcenter, predicted)`` and
    ``truth(row_no, sap, teamcenter, label)``. Unmatched rows and rows without a
    prediction stay in, with nulls.
    """
    rows = predictions.select(
        "model", F.col("row_no").alias("prediction_row"), "sap", "teamcenter",
        _blank_to_null(label_text(F.col("predicted"))).alias("predicted_label"),
        _blank_to_null(plain_id(F.col("sap"))).alias("sap_key"),
        _blank_to_null(plain_id(F.col("teamcenter"))).alias("tc_key"),
    )

    def lookup(column: str, tag: str) -> DataFrame:
        # Grouped by the key alone, the look-up lies as the join needs it. It grows with the truth, so
        # it is not sent whole to every task.
        return _keyed_truth(truth, [column]).groupBy(F.col("key").alias(f"{tag}_key")).agg(
            F.max_by("label", "row_no").alias(f"{tag}_label"), F.max("row_no").alias(f"{tag}_row")
        ).hint("merge")

    by_sap, by_tc = lookup("sap", "sap"), lookup("teamcenter", "tc")
    spread = ["model", "prediction_row"]
    joined = lookup_join(rows, by_sap, ["sap_key"], spread)
    # A row decided by the first id needs no second look-up.
    joined = joined.withColumn("tc_key", F.when(F.col("sap_label").isNull(), F.col("tc_key")))
    joined = lookup_join(joined, by_tc, ["tc_key"], spread)
    truth_label = F.coalesce("sap_label", "tc_label")
    return joined.select(
        "model", "prediction_row", F.coalesce("sap_row", "tc_row").alias("truth_row"),
        "sap", "teamcenter", truth_label.alias("ground_truth"), "predicted_label",
        F.when(F.col("sap_label").isNotNull(), BY_SAP)
        .when(F.col("tc_label").isNotNull(), BY_TEAMCENTER)
        .otherwise(NOT_MATCHED).alias("match_method"),
        F.coalesce(truth_label == F.col("predicted_label"), F.lit(False)).alias("correct"),
    )
