import pytest
from pyspark.sql import functions as F

from lattica.functions.ranks import value_rank
from lattica.operators import splits as S
from lattica.operators import windows as N


def ids(spark, n):
    return spark.range(n).withColumnRenamed("id", "trial_id")


def test_trial_split_sizes(spark):
    s = S.trial_split(ids(spark, 100), "trial_id", 0.8)
    assert {r["role"]: r["count"] for r in s.groupBy("role").count().collect()} == {"train": 80, "test": 20}
    assert S.trial_split(ids(spark, 2), "trial_id", 0.999).filter("role = 'test'").count() == 1
    assert s.collect() == S.trial_split(ids(spark, 100).repartition(3), "trial_id", 0.8).orderBy("trial_id").collect() or sorted(s.collect()) == sorted(S.trial_split(ids(spark, 100).repartition(3), "trial_id", 0.8).collect())


def test_loso(spark):
    df = spark.createDataFrame([(i, s) for i, s in enumerate([1, 1, 1, 2, 2, 2, 3, 3, 3])], "trial_id long, subject_id int")
    assert [r["trial_id"] for r in S.loso_holdout(df, "subject_id", 2).filter("role = 'test'").orderBy("trial_id").collect()] == [3, 4, 5]
    f = S.loso_folds(df, "subject_id")
    assert f.count() == 9 and f.filter("role = 'test'").count() == 3


@pytest.mark.parametrize("n,k,sizes", [(10, 3, [4, 3, 3]), (3, 3, [1, 1, 1]), (2, 3, []), (10, 1, [])])
def test_kfold_sizes(spark, n, k, sizes):
    f = S.kfold(ids(spark, n), "trial_id", k).groupBy("fold").count().orderBy("fold").collect()
    assert [r["count"] for r in f] == sizes


def test_stratified_folds_are_even(spark):
    df = ids(spark, 103).withColumn("label", (F.col("trial_id") % 4).cast("int"))
    c = S.stratified_kfold(df, "trial_id", "label", 5).groupBy("label", "fold").count()
    r = c.groupBy("label").agg((F.max("count") - F.min("count")).alias("d")).collect()
    assert len(r) == 4 and all(x["d"] <= 1 for x in r)


def test_group_folds_keep_subjects_together(spark):
    df = ids(spark, 90).withColumn("subject_id", F.floor(F.sqrt("trial_id")).cast("int"))
    for g in (S.group_kfold(df, "subject_id", 3), S.hashed_group_kfold(df, "subject_id", 3)):
        assert g.groupBy("subject_id").count().filter("count > 1").count() == 0 and g.select("fold").distinct().count() == 3


def test_guards(spark):
    base = ids(spark, 10).withColumn("subject_id", F.col("trial_id") % 5)
    good = base.withColumn("role", F.when(F.col("subject_id") == 4, "test").otherwise("train"))
    assert S.check(good, "trial_id", "subject_id") is good
    bad = base.withColumn("role", F.when(F.col("trial_id") == 4, "test").otherwise("train"))
    with pytest.raises(ValueError, match="subjects_in_both"):
        S.check(bad, "trial_id", "subject_id")
    with pytest.raises(ValueError, match="in_order"):
        S.check(good, "trial_id", None, "trial_id")
    with pytest.raises(ValueError, match="ids_in_both"):
        S.check(good.unionByName(good.withColumn("role", F.lit("test"))), "trial_id")


def test_value_rank_spans_buckets(spark):
    df = spark.createDataFrame([(float(v),) for v in [5, -3, 5, 1e9, 0.5, 2, 2]], "v double")
    assert sorted((r["r"], r["v"]) for r in value_rank(df, "v", "r").collect()) == list(enumerate(sorted([5, -3, 5, 1e9, 0.5, 2, 2]), 1))
    assert [r["v"] for r in value_rank(df, "v", "r", ascending=False).orderBy("r").limit(1).collect()] == [1e9]


def test_sliding_windows(spark):
    df = spark.createDataFrame([(1, list(range(100))), (2, [1, 2])], "trial_id int, x array<int>")
    w = N.sliding(df, "x", 20, 0.5).orderBy("start").collect()
    assert [(r["start"], r["stop"]) for r in w] == [(s, s + 20) for s in range(0, 81, 10)] and w[0]["window"] == list(range(20))
    assert N.seconds_step(250, 1.0, 0.5) == (250, 125) and N.step_of(10, 1.0) == 1


def test_segments_equal_a_plain_range_join(spark):
    s = spark.range(1000).select(F.lit(1).alias("u"), F.col("id").alias("idx"))
    e = spark.createDataFrame([(1, 5), (1, 7), (1, 990)], "u int, start long")
    got = N.segments(e, s, ["u"], "start", "idx", 30).groupBy("start").count().orderBy("start").collect()
    assert [(r["start"], r["count"]) for r in got] == [(5, 30), (7, 30), (990, 10)]
