import random

import pytest
from pyspark.sql import functions as F

from dossier.operators import metrics, truth

TRUTH = [(2, "A", "T1", "x"), (3, "B", "T2", "y"), (4, "C", None, "y"), (5, "D", None, "Roboter"), (6, "E", None, "x"),
         (9, "e", "", " x "), (10, None, "T9", " "), (11, "F.0", "T8", "z")]
CASES = {  # row: (sap, tc, predicted) -> (method, truth label, truth row, correct)
    1: (("A", None, "x"), ("SAP", "x", 2, True)),
    2: (("unknown", "T1", "y"), ("TEAMCENTER", "x", 2, False)),
    3: (("A", "T2", "y"), ("SAP", "x", 2, False)),
    4: (("Z", None, "x"), ("NOT_MATCHED", None, None, False)),
    5: (("B", None, None), ("SAP", "y", 3, False)),
    6: (("C", None, "UNRECOGNISED_RESPONSE"), ("SAP", "y", 4, False)),
    7: (("D", None, "roboter"), ("SAP", "Roboter", 5, False)),
    8: (("E", None, "x"), ("SAP", "x", 9, True)),
    9: ((None, " ", "x"), ("NOT_MATCHED", None, None, False)),
    10: ((None, "T9", "x"), ("NOT_MATCHED", None, None, False)),
    11: (("f-0", None, " z "), ("SAP", "z", 11, True)),
}


@pytest.fixture(scope="module")
def matched(spark):
    preds = spark.createDataFrame([("m", n, *c[0]) for n, c in CASES.items()],
                                  "model string, row_no bigint, sap string, teamcenter string, predicted string")
    return truth.match_predictions(preds, spark.createDataFrame(TRUTH, "row_no bigint, sap string, teamcenter string, label string"))


def test_match_with_fallback(matched):
    got = {r.prediction_row: (r.match_method, r.ground_truth, r.truth_row, r.correct) for r in matched.collect()}
    assert got == {n: c[1] for n, c in CASES.items()}


def test_summary(matched):
    s = metrics.model_summary(matched).first()
    assert (s.prediction_rows, s.matched_rows, s.unmatched_rows, s.missing_prediction_rows, s.unrecognised_or_error_rows) == (11, 8, 3, 1, 1)
    assert (s.evaluated_rows, s.correct_rows) == (7, 3) and s.accuracy == pytest.approx(3 / 7)
    assert s.weighted_recall == pytest.approx(s.accuracy)
    # Classes x, y, Roboter and z have support; the two predicted-only ones stay out.
    assert s.macro_recall == pytest.approx((2 / 4 + 0 + 0 + 1) / 4)


def test_label_order(matched):
    got = [(r.label, r.only_predicted) for r in metrics.label_order(matched).orderBy("ord").collect()]
    assert got == [("x", False), ("y", False), ("Roboter", False), ("z", False), ("UNRECOGNISED_RESPONSE", True), ("roboter", True)]


def test_conflicting_truth(spark):
    rows = spark.createDataFrame([(2, "F", "T", "x"), (3, "F", "T", "x"), (4, "f", "U", "y")], "row_no bigint, sap string, teamcenter string, label string")
    found = truth.truth_conflicts(rows).collect()
    assert sorted((c.id_type, c.key, c.n_labels, c.label, c.first_row) for c in found) == [("SAP", "f", 2, "x", 2), ("SAP", "f", 2, "y", 4)]
    three = rows.union(spark.createDataFrame([(9, "F", None, "z")], rows.schema))
    assert {c.label for c in truth.truth_conflicts(three).collect()} == {"x", "y", "z"}
    with pytest.raises(ValueError, match="2 labels to the SAP id 'f'"):
        truth.require_consistent_truth(rows)
    truth.require_consistent_truth(rows.where("row_no < 4"))


def test_nothing_to_evaluate(spark):
    empty = spark.createDataFrame([("m", 1, None, "x", "SAP")], "model string, prediction_row bigint, ground_truth string, predicted_label string, match_method string")
    with pytest.raises(ValueError, match="Nothing to evaluate"):
        metrics.require_evaluable(empty)


def test_metrics_equal_brute_force_and_do_not_depend_on_partitions(spark):
    rng = random.Random(3)
    pairs = [(rng.choice("ab"), n, rng.choice("xyz"), rng.choice("xyzw") if n % 11 else None, "SAP") for n in range(400)]
    df = spark.createDataFrame(pairs, "model string, prediction_row bigint, ground_truth string, predicted_label string, match_method string")
    results = []
    for frame in (df, df.repartition(7), df.orderBy(F.desc("prediction_row"))):
        counts = metrics.confusion(frame)
        results.append((sorted(map(tuple, metrics.per_class(counts).collect())), sorted(map(tuple, metrics.summary(metrics.per_class(counts)).collect())),
                        sorted(map(tuple, metrics.label_order(frame).collect()))))
    for model in "ab":
        rows = [(t, p) for m, _, t, p, _ in pairs if m == model and p]
        classes = {r["class"]: r for r in metrics.per_class(metrics.confusion(df)).where(F.col("model") == model).collect()}
        assert set(classes) == {v for pair in rows for v in pair}
        for label, r in classes.items():
            tp = sum(t == p == label for t, p in rows)
            predicted, support = sum(p == label for _, p in rows), sum(t == label for t, _ in rows)
            assert (r.tp, r.fp, r.fn, r.support) == (tp, predicted - tp, support - tp, support)
            assert r.tp + r.fp + r.fn + r.tn == len(rows)
            assert r.precision == pytest.approx(tp / predicted if predicted else 0) and r.recall == pytest.approx(tp / support if support else 0)
    for other in results[1:]:
        assert other[2] == results[0][2]
        for a, b in zip(results[0][0] + results[0][1], other[0] + other[1]):
            assert a == pytest.approx(b)


def test_ranking(spark):
    df = spark.createDataFrame([("a", 0.5, 0.5), ("b", 0.5, 0.6), ("c", 0.7, 0.1), ("d", 0.5, 0.5)], "model string, macro_f1 double, accuracy double")
    assert [r.model for r in metrics.model_ranking(df).collect()] == ["c", "b", "a", "d"]


def test_wide_confusion_loses_no_label(spark):
    counts = spark.createDataFrame([("m", "x", "y", 3), ("m", "y", "y", 4), ("n", "x", "x", 2)], "model string, ground_truth string, predicted_label string, n bigint")
    wide = metrics.confusion_wide(counts, ["x", "y"]).collect()
    assert sum(r["x"] + r["y"] for r in wide) == 9
    with pytest.raises(Exception, match="Not in the label list"):
        metrics.confusion_wide(counts, ["x"]).collect()


def test_metrics_match_once_and_in_proportion(spark, tmp_path, monkeypatch):
    """The truth's look-ups lie as the joins need them, and tables of a run share one count."""
    from dossier.plans import table_queries

    preds = spark.createDataFrame([("m", 1, "A", None, "x")], "model string, row_no bigint, sap string, teamcenter string, predicted string")
    rows = spark.createDataFrame(TRUTH, "row_no bigint, sap string, teamcenter string, label string")
    found = truth.match_predictions(preds, rows)
    plan = found._jdf.queryExecution().executedPlan().toString()
    # One exchange for each look-up and one for the predictions in each of two joins.
    assert "Broadcast" not in plan and plan.count("Exchange hashpartitioning") == 4
    calls = []
    monkeypatch.setattr(metrics, "outcomes", lambda m, own=metrics.outcomes: calls.append(1) or own(m))
    monkeypatch.setattr(table_queries, "_matched", lambda *_: found)
    assert {(r.ground_truth, r.n) for r in table_queries.tables_round_trip(spark, "").collect()} == {("x", 1), (None, 1)}
    assert calls == [1]
