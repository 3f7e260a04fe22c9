import pytest

from lattica.operators import experiments as E
from lattica.operators import selection as L
from lattica.sources import datasets as S
from pyspark.sql import functions as F


@pytest.fixture(scope="module")
def trials(spark):
    return S.synthetic(spark, 2, 24, 4, 128, classes=2, snr=1.0).repartition(4).cache()


def test_loso_predicts_every_trial_once(spark, trials):
    p = E.loso(trials, [E.PRESETS["csp_lda"], E.Spec("covariance", "mdm", "riemann_transport")]).cache()
    assert p.count() == 2 * 48 and p.select("pipeline", "trial_id").distinct().count() == 96
    t = E.subject_table(p, 2, 3.0).collect()
    assert len(t) == 4 and all(r["n_trials_test"] == 24 for r in t) and max(r["accuracy"] for r in t) > 0.8


def test_calibrate_records_failures_and_selects(spark, trials):
    m = E.calibrate(trials, [E.PRESETS["csp_lda"], E.Spec("no_such_feature", "lda")], k=2)
    rows = {r["pipeline"]: r for r in m.collect()}
    assert rows["baseline_no_such_feature_lda"]["failed"] and rows["baseline_csp_lda"]["cv_accuracy"] > 0.8
    assert L.best(m).first()["pipeline"] == "baseline_csp_lda"


def test_shuffled_labels_are_not_learnt(spark, trials):
    score, alarm = E.leakage_sanity(trials, E.PRESETS["csp_lda"])
    assert 0.1 < score < 0.9 and alarm == (score > 0.7)


def test_adapter_needs_a_target(trials):
    with pytest.raises(ValueError, match="target"):
        E.Pipeline(E.Spec("covariance", "lda", "coral")).fit(trials)


def test_diagnostics(spark, trials):
    d = E.alignment_diagnostics(trials)
    assert d["after"] < d["before"] and E.alignment_diagnostics(trials, 100) == {"before": None, "after": None}
    assert set(E.class_spread(trials)) == {0, 1}
    w = E.outlier_weights(spark.createDataFrame([(1, 0.1), (2, 0.2)], "subject_id long, distance double"))
    assert w.agg(F.sum("weight")).first()[0] == pytest.approx(1)
    f = spark.createDataFrame([(i % 2, [float(i % 2), float(i % 7)]) for i in range(70)], "label int, features array<double>")
    b = {r["band"]: r["weight"] for r in E.band_weights(f, 2).collect()}
    assert b[0] > 0.6 > b[1]


def test_few_shot_curve(spark, trials):
    c = E.few_shot(trials, E.PRESETS["csp_lda"], 1, [0.25]).collect()
    assert len(c) == 1 and c[0]["accuracy"] > 0.7


def test_loso_query_evaluates_every_trial_of_the_table(spark, tmp_path):
    from lattica.plans.q_models import q_loso_evaluation

    rows = [(9 * k + s, k % 10, [float((7 * k + 3 * s + i * i * (k % 10 + 1)) % 11) / 11 for i in range(64)]) for k in range(20) for s in (0, 1)]
    spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = q_loso_evaluation(spark, str(tmp_path)).collect()
    assert sorted((r["pipeline"], r["subject_id"], r["n_trials_test"]) for r in got) == [(p, s, 20) for p in ("baseline_covariance_mdm", "baseline_csp_lda") for s in (0, 1)]
