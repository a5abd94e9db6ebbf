import random

from pyspark.sql import functions as F

from dossier.operators.spread import best_rows, listed_in_parts, lookup_join, numbered


def skewed(spark, n=3000):
    """A third of all rows carries one key, another part none."""
    rng = random.Random(5)
    rows = [(i, "hot" if i % 3 == 0 else None if i % 7 == 0 else f"k{rng.randrange(400)}") for i in range(n)]
    return rows, spark.createDataFrame(rows, "row_no bigint, k string").repartition(7)


def test_lookup_join_keeps_every_row(spark):
    rows, df = skewed(spark)
    table = {f"k{n}": n for n in range(0, 400, 2)} | {"hot": 999}
    lookup = spark.createDataFrame(list(table.items()), "k string, v int")
    expected = sorted((i, k or "", table.get(k)) for i, k in rows)
    for spread_by in ([], ["row_no"]):
        got = lookup_join(df, lookup, ["k"], spread_by)
        assert got.columns == ["k", "row_no", "v"]
        assert sorted((r.row_no, r.k or "", r.v) for r in got.collect()) == expected


def test_lookup_join_spreads_rows_without_key_and_runs_no_job(spark):
    _, df = skewed(spark)
    lookup = spark.createDataFrame([("hot", 1)], "k string, v int")
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("lookup", "no job while a join is built")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = lookup_join(df, lookup, ["k"], ["row_no"])
        assert not tracker.getJobIdsForGroup("lookup")
        per_task = joined.where("k is null").groupBy(F.spark_partition_id()).count().collect()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(per_task) > 3


def test_lookup_join_on_two_columns(spark):
    left = spark.createDataFrame([(n, "a", "x" if n % 2 else None) for n in range(200)], "row_no int, p string, q string")
    right = spark.createDataFrame([("a", "x", 7)], "p string, q string, v int")
    for spread_by in ([], ["row_no"]):
        got = lookup_join(left, right, ["p", "q"], spread_by).collect()
        assert len(got) == 200 and sum(r.v or 0 for r in got) == 700


def test_numbering_in_ranges_equals_window(spark):
    rows, df = skewed(spark)
    for group in (["k"], []):
        plain = {r.row_no: r.position for r in numbered(df, group, ["row_no"]).collect()}
        ranged = {r.row_no: r.position for r in numbered(df, group, ["row_no"], plain_rows=0).collect()}
        assert plain == ranged and len(plain) == len(rows)
    assert sorted(ranged.values()) == list(range(1, len(rows) + 1))


def test_lists_in_parts_lose_nothing(spark):
    rows, df = skewed(spark)
    for limit in (0, 10**6):
        parts = listed_in_parts(df, ["k"], ["row_no"], F.col("row_no"), "ids", size=50, total="n", plain_rows=limit).collect()
        assert all(len(p.ids) <= 50 for p in parts)
        hot = [i for p in sorted((p for p in parts if p.k == "hot"), key=lambda p: p.part) for i in p.ids]
        assert hot == list(range(0, 3000, 3)) and all(p.n == 1000 for p in parts if p.k == "hot")
        assert sorted(i for p in parts for i in p.ids) == list(range(len(rows)))


def test_best_rows_limits_before_the_shuffle(spark):
    _, df = skewed(spark)
    best = best_rows(df.where("k is not null"), ["k"], [F.desc("row_no")], 2)
    assert [r.row_no for r in best.where("k = 'hot'").orderBy("row_no").collect()] == [2994, 2997]
    plan = best._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2
