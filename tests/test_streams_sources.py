import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from lattica.sources import datasets as S
from lattica.streaming import streams as R


def as_stream(spark, df, path, files=3):
    df.repartition(files).write.parquet(str(path))
    return R.replay(spark, str(path), schema=df.schema)


def test_drift_stream_equals_table(spark, tmp_path):
    df = spark.range(600).select((F.col("id") % 3).alias("subject_id"), F.col("id").alias("event_id"), F.when((F.col("id") % 7 < 3) & (F.col("id") > 200), 0.0).otherwise(1.0).alias("correct"))
    got = R.run_once(R.drift(as_stream(spark, df, tmp_path / "e"), window=12, at_least=5, run=3))
    want = R.drift_table(df, window=12, at_least=5, run=3)
    key = lambda rows: sorted((r["subject_id"], r["event_id"], r["accuracy"] and round(r["accuracy"], 9), r["drift"]) for r in rows)
    assert key(got.collect()) == key(want.collect()) and want.filter("drift").count() > 0


def test_windows_of_a_stream_equal_a_table(spark, tmp_path):
    df = spark.range(500).select(F.timestamp_seconds(F.col("id") * 1000).alias("ts"), (F.col("id") % 4).alias("kind"))
    aggs = [F.count(F.lit(1)).alias("n")]
    got = R.run_once(R.sliding(as_stream(spark, df, tmp_path / "w"), "ts", "1 hour", "30 minutes", ["kind"], aggs), "complete")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, R.sliding(df, "ts", "1 hour", "30 minutes", ["kind"], aggs).collect()))
    assert R.sessions(df, "ts", "20 minutes", [], aggs).first()["n"] == 500


def test_ring_windows(spark, tmp_path):
    df = spark.range(100).select(F.lit(1).cast("long").alias("subject_id"), F.col("id").alias("idx"), F.col("id").cast("double").alias("value")).coalesce(1)
    got = R.run_once(R.ring_windows(as_stream(spark, df, tmp_path / "r", 1), 20, 10)).orderBy("start").collect()
    assert [(r["start"], r["total"]) for r in got] == [(s, float(sum(range(s, s + 20)))) for s in range(0, 81, 10)]


def test_online_selector_learns_then_predicts(spark, tmp_path):
    df = spark.range(60).select(F.lit(1).cast("long").alias("subject_id"), F.col("id").alias("trial_id"), F.when(F.col("id") % 10 == 9, None).otherwise((F.col("id") % 2).cast("int")).alias("label"), F.array((F.col("id") % 2).cast("double"), F.lit(0.5)).alias("features")).coalesce(1)
    got = R.run_once(R.online_selector(as_stream(spark, df, tmp_path / "o", 1), 10, 2))
    p = got.filter("phase = 'predict'")
    assert p.filter("label IS NOT NULL").agg(F.avg(F.col("correct").cast("int"))).first()[0] == 1 and p.filter("predicted IS NULL").count() == 0
    assert got.filter("phase = 'calibrate' AND label IS NOT NULL").count() == 10


def test_topics_reach_their_subscribers(spark, tmp_path):
    df = spark.createDataFrame([("a", 1), ("b", 2), ("a", 3)], "topic string, v int")
    seen = {}
    q = R.publish(as_stream(spark, df, tmp_path / "p", 1), {"a": lambda d, _: seen.setdefault("a", []).extend(r["v"] for r in d.collect())}, str(tmp_path / "log"))
    q.awaitTermination()
    assert sorted(seen["a"]) == [1, 3]


def test_npy_source(spark, tmp_path):
    np.save(tmp_path / "1_x.npy", np.arange(24.0).reshape(2, 3, 4))
    np.save(tmp_path / "1_y.npy", np.array([1, -1]))
    np.save(tmp_path / "2_x.npy", np.ones((1, 3, 4)))
    np.save(tmp_path / "2_y.npy", np.array([0]))
    rows = S.npy(spark, str(tmp_path)).orderBy("subject_id", "trial_id").collect()
    assert [(r["subject_id"], r["label"]) for r in rows] == [(1, 1), (1, None), (2, 0)] and rows[0]["signal"][1] == [4.0, 5.0, 6.0, 7.0]
    assert S.npy(spark, str(tmp_path), subjects="2").count() == 1


def test_synthetic_is_reproducible(spark):
    a, b = (S.load("synthetic", spark, subjects=2, trials=3, channels=2, n=50, unknown=1).orderBy("trial_id").collect() for _ in range(2))
    assert a == b and len(a) == 6


def test_cut_by_events(spark):
    s = spark.range(100).select(F.lit(1).alias("subject_id"), F.explode(F.array(F.lit(0), F.lit(1))).alias("channel"), F.col("id").alias("sample_idx"), F.col("id").cast("double").alias("value"))
    e = spark.createDataFrame([(1, 10, 769), (1, 95, 770), (1, 98, 771), (1, 50, 1)], "subject_id int, start long, code int")
    rows = S.cut_by_events(s, e, {769: 0, 770: 1, 771: 2}, 10, 5).orderBy("trial_id").collect()
    assert [r["label"] for r in rows] == [0, 1] and rows[1]["signal"][0] == [95.0, 96.0, 97.0, 98.0, 99.0] + [99.0] * 5
    assert S.cut_unlabelled(s, 30).count() == 3


def test_sinks_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, 0.5), (2, None)], "subject_id long, accuracy double")
    S.write_json_table(df, str(tmp_path / "j"), {"seed": 1})
    assert sorted(r["subject_id"] for r in S.read_json_table(spark, str(tmp_path / "j")).collect()) == [1, 2]
    (tmp_path / "bare.json").write_text(json.dumps([{"subject_id": 3}]))
    assert S.read_json_table(spark, str(tmp_path / "bare.json")).first()["subject_id"] == 3
    S.write_csv(df, str(tmp_path / "c"))
    assert spark.read.option("header", True).csv(str(tmp_path / "c")).count() == 2
    assert S.latex_rows(df, ["subject_id", "accuracy"]).first()["value"] == r"1 & 0.500 \\"


def test_config_and_planning(spark):
    c = S.Config({"a": {"x": 1, "y": 2}, "b": 3}).merged({"a": {"y": 5}})
    assert c.values == {"a": {"x": 1, "y": 5}, "b": 3} and len(c.digest()) == 16
    able = S.capabilities(["EEG1", "EEG2"])
    assert S.spatial_method("laplacian_auto", able) == "car"
    with pytest.raises(ValueError, match="laplacian"):
        S.spatial_method("laplacian_strict", able)
    assert S.run_metadata(spark, "d", 1, c).first()["config_hash"] == c.digest()


def test_models_round_trip(spark, tmp_path):
    arrays = {"filters": np.arange(6.0).reshape(2, 3), "bias": np.array(0.5)}
    S.write_model(spark, str(tmp_path / "m"), arrays)
    back = S.read_model(spark, str(tmp_path / "m"))
    assert all(np.array_equal(back[k], v) for k, v in arrays.items())
