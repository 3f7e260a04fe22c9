import math

import numpy as np
import pytest

from lattica.functions import metrics as M
from pyspark.sql import functions as F

TRUE, PRED = [0, 1, 2, 1, 0], [0, 1, 1, 1, 0]


def table(spark, y_true, y_pred, proba=None):
    rows = [(1, a, b, list(map(float, proba[i])) if proba is not None else []) for i, (a, b) in enumerate(zip(y_true, y_pred, strict=True))]
    return spark.createDataFrame(rows, "run int, y_true int, y_pred int, proba array<double>")


def one(df, name):
    return df.first()[name]


def test_accuracy_and_unlabelled(spark):
    df = table(spark, [*TRUE, None], [*PRED, 1])
    assert one(M.accuracy(df, ["run"]), "accuracy") == pytest.approx(0.8)


def test_kappa(spark):
    assert one(M.kappa(table(spark, [0, 1, 0, 1], [0, 1, 1, 1]), ["run"]), "kappa") == pytest.approx(0.5)
    assert one(M.kappa(table(spark, [1, 1], [1, 1]), ["run"]), "kappa") == 0


def test_f1_and_balanced(spark):
    df = table(spark, TRUE, PRED)
    assert one(M.f1_macro(df, ["run"]), "f1_macro") == pytest.approx((1 + 0.8 + 0) / 3)
    assert one(M.balanced_accuracy(df, ["run"]), "balanced_accuracy") == pytest.approx(2 / 3)


def test_auc_with_ties_and_binary(spark):
    proba = [[0.9, 0.1], [0.4, 0.6], [0.4, 0.6], [0.2, 0.8]]
    df = table(spark, [0, 0, 1, 1], [0, 1, 1, 1], proba)
    assert one(M.roc_auc_macro(df, ["run"]), "roc_auc_macro") == pytest.approx(0.875)
    assert one(M.roc_auc_macro(table(spark, [0, 0], [0, 0], [[1, 0]] * 2), ["run"]), "roc_auc_macro") == 0


@pytest.mark.parametrize("p,k,want", [(0.25, 4, 0), (0.0, 4, 0), (1.0, 4, 2), (0.8, 4, 2 + 0.8 * math.log2(0.8) + 0.2 * math.log2(0.2 / 3))])
def test_itr(spark, p, k, want):
    r = spark.range(1).select(M.itr_bits_per_trial(F.lit(p), k).alias("b"), M.itr_bits_per_minute(F.lit(p), k, 3.0).alias("m"), M.itr_bits_per_minute(F.lit(p), k, 0).alias("z")).first()
    assert (r["b"], r["m"], r["z"]) == (pytest.approx(want, abs=1e-12), pytest.approx(want * 20, abs=1e-9), 0)


def test_mutual_information_of_equal_and_free_labels(spark):
    assert one(M.mutual_information(table(spark, [0, 1] * 4, [0, 1] * 4), ["run"], "y_true", "y_pred"), "mutual_information") == pytest.approx(math.log(2))
    assert one(M.mutual_information(table(spark, [0, 0, 1, 1], [0, 1, 0, 1]), ["run"], "y_true", "y_pred"), "mutual_information") == pytest.approx(0)


def test_all_metrics_have_eight_values(spark):
    rng = np.random.RandomState(0)
    y = rng.randint(0, 4, 20)
    p = np.eye(4)[(y + (np.arange(20) % 4 == 0)) % 4]
    r = M.all_metrics(table(spark, y.tolist(), p.argmax(1).tolist(), p), ["run"], 4, 3.0).first().asDict()
    assert len(r) == 9 and all(v is not None for v in r.values())


def test_published_subject_means(spark):
    # Accuracies of nine subjects, published with their mean and population deviation.
    a = [0.2426, 0.2673, 0.4455, 0.3490, 0.2574, 0.2574, 0.4530, 0.4381, 0.3416]
    from lattica.operators.aggregates import summary

    r = summary(spark.createDataFrame([(1, x) for x in a], "t int, accuracy double"), ["t"], "accuracy").first()
    assert r["mean"] == pytest.approx(0.339109, abs=1e-4) and r["std"] == pytest.approx(0.083010, abs=1e-4)
