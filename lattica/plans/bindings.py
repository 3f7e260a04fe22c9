"""The driver's tables in the roles of the library's: trials, samples, predictions, events, pipeline metrics; and the same roles as SQL for the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.functions.metrics import argmax
from lattica.functions.ranks import seeded

SUBJECTS = 9
CLASSES = 10


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def features(spark, sf) -> DataFrame:
    """(trial_id, subject_id, label, features)."""
    e = table(spark, sf, "embeddings")
    return e.select(F.col("vec_id").alias("trial_id"), (F.col("vec_id") % SUBJECTS).alias("subject_id"), "label", F.transform("embedding", lambda x: x.cast("double")).alias("features"))


def trials(spark, sf) -> DataFrame:
    """The same vectors as signals of 8 channels by 8 samples."""
    f = features(spark, sf)
    return f.select("subject_id", "trial_id", "label", F.transform(F.sequence(F.lit(0), F.lit(7)), lambda c: F.slice("features", c * 8 + 1, 8)).alias("signal"))


def long_trials(spark, sf, n: int = 32) -> DataFrame:
    """Runs of up to n trials of a subject end to end, by id: 8 channels by 8 n samples. A run of fewer trials goes on from its first again, so every trial is in a run and all runs have one length."""
    t = trials(spark, sf).withColumn("run", F.floor(F.col("trial_id") / (SUBJECTS * n)))
    g = t.groupBy("subject_id", "run").agg(F.array_sort(F.collect_list(F.struct("trial_id", "label", "signal"))).alias("r"))  # n rows at most
    g = g.withColumn("r", F.slice(F.flatten(F.array_repeat("r", F.ceil(F.lit(n) / F.size("r")).cast("int"))), 1, n))
    whole = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda c: F.flatten(F.transform("r", lambda x: F.element_at(x["signal"], (c + 1).cast("int")))))
    return g.select("subject_id", (F.col("run") * SUBJECTS + F.col("subject_id")).alias("trial_id"), F.col("r")[0]["label"].alias("label"), whole.alias("signal"))


def samples(spark, sf) -> DataFrame:
    """(subject_id, trial_id, channel, sample_idx, value)."""
    f = features(spark, sf).select("subject_id", "trial_id", F.posexplode("features").alias("_i", "value"))
    return f.select("subject_id", "trial_id", F.floor(F.col("_i") / 8).cast("int").alias("channel"), (F.col("_i") % 8).cast("long").alias("sample_idx"), "value")


def predictions(spark, sf) -> DataFrame:
    """(pipeline, subject_id, trial_id, y_true, y_pred, proba): three pipelines, each ten components as scores of ten classes."""
    f = features(spark, sf)
    runs = F.array(*[F.struct(F.lit(f"p{k}").alias("pipeline"), F.slice("features", 10 * k + 1, CLASSES).alias("proba")) for k in range(3)])
    p = f.select("subject_id", "trial_id", F.col("label").alias("y_true"), F.explode(runs).alias("r"))
    return p.select("r.pipeline", "subject_id", "trial_id", "y_true", argmax(F.col("r.proba")).alias("y_pred"), "r.proba")


def outcomes(spark, sf) -> DataFrame:
    """(subject_id, event_id, ts, correct): events as trials in time, wrong where they are errors."""
    e = table(spark, sf, "events")
    return e.select(F.col("user_id").alias("subject_id"), "event_id", "ts", F.when(F.col("event_type") != "error", 1.0).otherwise(0.0).alias("correct"))


def pipeline_metrics(spark, sf) -> DataFrame:
    """A row per supplier in the role of a pipeline."""
    l = table(spark, sf, "lineitem")  # noqa: E741
    share = lambda c: F.avg(F.when(c, 1.0).otherwise(0.0))
    g = l.groupBy(F.concat(F.lit("pipe_"), F.col("l_suppkey").cast("string")).alias("pipeline")).agg(
        F.round(share(F.col("l_returnflag") == "N"), 9).alias("accuracy"), F.round(5.0 * F.avg("l_discount"), 9).alias("kappa"), F.round(1.0 - F.var_pop("l_tax"), 9).alias("stability"),
        F.round(10.0 * F.avg("l_quantity"), 9).alias("latency_ms"), F.round(share(F.col("l_linestatus") == "O"), 9).alias("train_accuracy"),
    )
    return g.withColumn("cv_accuracy", F.round(F.col("accuracy") * 0.98, 9)).withColumn("failed", F.lit(False))


def folded(spark, sf, k: int = 5) -> DataFrame:
    from lattica.operators.splits import stratified_kfold

    return stratified_kfold(features(spark, sf), "trial_id", "label", k)


def key(seed: int, column: str):
    return seeded(seed, column)


#: SQL for the roles above.
EMB = "emb AS (SELECT vec_id AS trial_id, vec_id % 9 AS subject_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS f FROM embeddings)"
SAMPLES = EMB + ", smp AS (SELECT subject_id, trial_id, CAST(i // 8 AS INTEGER) AS channel, CAST(i % 8 AS BIGINT) AS sample_idx, f[i + 1] AS value FROM emb, range(64) t(i))"
PRED = EMB + """, runs AS (SELECT 'p' || k AS pipeline, subject_id, trial_id, label AS y_true, list_slice(f, 10 * k + 1, 10 * k + 10) AS proba FROM emb, range(3) t(k)),
pred AS (SELECT *, CAST(list_position(proba, list_max(proba)) - 1 AS INTEGER) AS y_pred FROM runs)"""
OUT = "outc AS (SELECT user_id AS subject_id, event_id, ts, CASE WHEN event_type <> 'error' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS correct FROM events)"
PIPES = """pm0 AS (SELECT 'pipe_' || l_suppkey AS pipeline, round(avg(CASE WHEN l_returnflag = 'N' THEN 1.0::DOUBLE ELSE 0 END), 9) AS accuracy, round(5.0::DOUBLE * avg(l_discount), 9) AS kappa,
  round(1.0::DOUBLE - var_pop(l_tax), 9) AS stability, round(10.0::DOUBLE * avg(l_quantity), 9) AS latency_ms, round(avg(CASE WHEN l_linestatus = 'O' THEN 1.0::DOUBLE ELSE 0 END), 9) AS train_accuracy FROM lineitem GROUP BY 1),
pm AS (SELECT *, round(accuracy * 0.98::DOUBLE, 9) AS cv_accuracy, false AS failed FROM pm0)"""


def hash_key(seed: int, column: str) -> str:
    return f"md5('{seed}:' || CAST({column} AS VARCHAR))"


def rounded(df: DataFrame, places: int = 9) -> DataFrame:
    """Doubles rounded, so that the last digit of a sum in another order doesn't count as a difference."""
    return df.select(*[F.round(c, places).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])
