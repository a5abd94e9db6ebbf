"""Classification metrics of many models at once, all from one count per label pair."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dossier.functions.answers import ERROR_LABELS
from dossier.operators.spread import settled
from dossier.operators.truth import NOT_MATCHED


def evaluable(matched: DataFrame) -> DataFrame:
    """Rows that have both a truth and a prediction."""
    return matched.where("ground_truth is not null and predicted_label is not null")


def require_evaluable(matched: DataFrame) -> None:
    if evaluable(matched).isEmpty():
        raise ValueError("Nothing to evaluate: no row has both a truth and a prediction.")


def outcomes(matched: DataFrame) -> DataFrame:
    """The one count that all metrics come from: rows by model, truth, prediction and match method,
    nulls included, with the first row of each. It has few rows, whatever the number of predictions."""
    return matched.groupBy("model", "ground_truth", "predicted_label", "match_method").agg(
        F.count("*").alias("n"), F.min("prediction_row").alias("first_row")
    )


def confusion(matched: DataFrame) -> DataFrame:
    """Counts per model, truth and prediction in long form."""
    return evaluable(matched).groupBy("model", "ground_truth", "predicted_label").agg(
        F.count("*").alias("n")
    )


def confusion_of(counts: DataFrame) -> DataFrame:
    """``confusion`` from ``outcomes``."""
    return evaluable(counts).groupBy("model", "ground_truth", "predicted_label").agg(F.sum("n").alias("n"))


def confusion_square(counts: DataFrame) -> DataFrame:
    """Each model's whole matrix over its own ordered labels, from ``outcomes``, zeros included.

    ``model, truth_ord, ground_truth, predicted_ord, predicted_label, n``: a row for each pair of
    labels that the model's evaluable rows have as truth or prediction, in the order of
    ``label_order``. The labels come from the data; the sum of ``n`` is the number of evaluable rows.
    """
    order = settled(label_order_of(counts))
    truths = order.select("model", F.col("label").alias("ground_truth"), F.col("ord").alias("truth_ord"))
    predictions = order.select("model", F.col("label").alias("predicted_label"), F.col("ord").alias("predicted_ord"))
    # As many rows as cells of the matrices, which is what is asked for.
    cells = truths.join(predictions, "model")
    return cells.join(confusion_of(counts), ["model", "ground_truth", "predicted_label"], "left").select(
        "model", "truth_ord", "ground_truth", "predicted_ord", "predicted_label", F.coalesce("n", F.lit(0)).cast("bigint").alias("n")
    )


def confusion_ranked(square: DataFrame) -> DataFrame:
    """``confusion_square`` as a row for each truth label: columns ``n_1``, ``n_2``, ... hold the
    counts of the model's labels by rank, null beyond its own labels; ``label`` names a rank's label
    by the row of that rank."""
    most = square.agg(F.max("predicted_ord")).first()[0] or 0
    ranks = list(range(1, most + 1))
    wide = square.groupBy("model", "truth_ord", "ground_truth").pivot("predicted_ord", ranks).agg(F.sum("n"))
    return wide.select(
        "model", F.col("truth_ord").alias("ord"), F.col("ground_truth").alias("label"), *[F.col(str(r)).alias(f"n_{r}") for r in ranks]
    )


def confusion_wide(counts: DataFrame, labels: Sequence[str]) -> DataFrame:
    """Square matrix per model over an ordered label list, zeros filled in.

    A counted label that the list lacks is an error, so no count is left out.
    """
    listed = F.col("ground_truth").isin(*labels) & F.col("predicted_label").isin(*labels)
    unlisted = F.raise_error(F.concat(
        F.lit("Not in the label list: "), F.col("ground_truth"), F.lit(" / "), F.col("predicted_label")))
    counts = counts.withColumn("n", F.when(listed, F.col("n")).otherwise(unlisted.cast("bigint")))
    rows = counts.select("model").distinct().withColumn(
        "ground_truth", F.explode(F.array(*[F.lit(label) for label in labels]))
    )
    pivoted = counts.groupBy("model", "ground_truth").pivot("predicted_label", list(labels)).agg(
        F.sum("n")
    )
    return rows.join(pivoted, ["model", "ground_truth"], "left").na.fill(0, list(labels))


def label_order(matched: DataFrame) -> DataFrame:
    """Labels of each model in order of first appearance: truth labels, then those that
    were only predicted."""
    return label_order_of(outcomes(matched))


def label_order_of(counts: DataFrame) -> DataFrame:
    """``label_order`` from ``outcomes``."""
    sides = F.explode(
        F.array(
            F.struct(F.col("ground_truth").alias("label"), F.lit(0).alias("only_predicted")),
            F.struct(F.col("predicted_label").alias("label"), F.lit(1).alias("only_predicted")),
        )
    )
    as_truth = F.when(F.col("s.only_predicted") == 0, F.col("first_row"))
    first = (
        evaluable(counts).select("model", "first_row", sides.alias("s"))
        .groupBy("model", F.col("s.label").alias("label"))
        .agg(F.min(as_truth).alias("as_truth"), F.min("first_row").alias("any"))
        .withColumn("only_predicted", F.col("as_truth").isNull())
    )
    order = Window.partitionBy("model").orderBy("only_predicted", F.coalesce("as_truth", "any"))
    return first.select(
        "model", "label", "only_predicted", F.row_number().over(order).alias("ord")
    )


def _ratio(numerator: Column, denominator: Column) -> Column:
    return F.when(denominator == 0, F.lit(0.0)).otherwise(numerator / denominator)


def per_class(counts: DataFrame) -> DataFrame:
    """TP, FP, FN, TN, support, precision, recall and F1 per model and class."""
    hit = F.when(F.col("ground_truth") == F.col("predicted_label"), F.col("n")).otherwise(F.lit(0))
    zero = F.lit(0).cast("bigint")
    sides = F.explode(
        F.array(
            F.struct(F.col("ground_truth").alias("label"), F.col("n").alias("support"),
                     hit.cast("bigint").alias("tp"), zero.alias("predicted")),
            F.struct(F.col("predicted_label").alias("label"), zero.alias("support"),
                     zero.alias("tp"), F.col("n").alias("predicted")),
        )
    )
    sums = (
        counts.select("model", sides.alias("s")).groupBy("model", F.col("s.label").alias("class"))
        .agg(F.sum("s.support").alias("support"), F.sum("s.tp").alias("tp"),
             F.sum("s.predicted").alias("predicted"))
    )
    # The window sees one row per model and distinct label, not per prediction.
    total = F.sum("support").over(Window.partitionBy("model"))
    precision = _ratio(F.col("tp"), F.col("predicted"))
    recall = _ratio(F.col("tp"), F.col("support"))
    return (
        sums.select(
            "model", "class", "support", "tp",
            (F.col("predicted") - F.col("tp")).alias("fp"),
            (F.col("support") - F.col("tp")).alias("fn"),
            (total - F.col("support") - F.col("predicted") + F.col("tp")).alias("tn"),
            precision.alias("precision"), recall.alias("recall"),
        )
        .withColumn("f1", _ratio(2 * F.col("precision") * F.col("recall"),
                                 F.col("precision") + F.col("recall")))
    )


def summary(classes: DataFrame) -> DataFrame:
    """Accuracy and macro and weighted averages per model. Averages leave out classes
    that only occur as predictions."""
    has_support = F.col("support") > 0

    def macro(name: str) -> Column:
        return F.avg(F.when(has_support, F.col(name)))

    def weighted(name: str) -> Column:
        return F.sum(F.col(name) * F.col("support")) / F.sum("support")

    return classes.groupBy("model").agg(
        F.sum("support").alias("evaluated_rows"), F.sum("tp").alias("correct_rows"),
        (F.sum("tp") / F.sum("support")).alias("accuracy"),
        macro("precision").alias("macro_precision"), macro("recall").alias("macro_recall"),
        macro("f1").alias("macro_f1"), weighted("precision").alias("weighted_precision"),
        weighted("recall").alias("weighted_recall"), weighted("f1").alias("weighted_f1"),
    )


def run_counts(matched: DataFrame) -> DataFrame:
    """Coverage per model, to be read beside the accuracy."""
    return run_counts_of(outcomes(matched))


def run_counts_of(counts: DataFrame) -> DataFrame:
    """``run_counts`` from ``outcomes``."""
    unmatched = F.col("match_method") == NOT_MATCHED

    def rows(where: Column) -> Column:
        return F.sum(F.when(where, F.col("n")).otherwise(0)).cast("bigint")

    return counts.groupBy("model").agg(
        F.sum("n").alias("prediction_rows"),
        rows(~unmatched).alias("matched_rows"),
        rows(unmatched).alias("unmatched_rows"),
        rows(F.col("predicted_label").isNull()).alias("missing_prediction_rows"),
        rows(F.col("predicted_label").isin(*ERROR_LABELS)).alias("unrecognised_or_error_rows"),
    )


def model_summary(matched: DataFrame) -> DataFrame:
    """Coverage and metrics of each model with evaluable rows; the rows are read once."""
    return summary_of(settled(outcomes(matched)))


def summary_of(counts: DataFrame) -> DataFrame:
    """``model_summary`` from ``outcomes``."""
    return run_counts_of(counts).join(summary(per_class(confusion_of(counts))), "model")


def model_ranking(summaries: DataFrame) -> DataFrame:
    """Best model first: by macro F1, then accuracy, then name."""
    return summaries.orderBy(F.desc("macro_f1"), F.desc("accuracy"), "model")
