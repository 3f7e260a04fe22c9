import numpy as np
import pytest

from lattica.functions import linalg
from lattica.operators import classifiers as C
from lattica.operators import experiments as X
from lattica.operators import features as E
from lattica.operators import held_out as H
from lattica.operators import kernels as K
from lattica.sources import datasets as S
from pyspark.sql import functions as F


def spd(rng, n, k):
    a = rng.normal(size=(k, n, 2 * n))
    return a @ np.swapaxes(a, -1, -2) / (2 * n)


def mixed(spark):
    """Four subjects and four classes, some rows without a label, some without a subject."""
    t = S.synthetic(spark, 4, 24, 5, 40)
    return t.withColumn("label", F.when(F.col("trial_id") % 17 != 3, F.col("label"))).withColumn("subject_id", F.when(F.col("trial_id") % 23 != 5, F.col("subject_id")))


def test_one_set_of_passes_equals_a_fit_for_each_fold(spark, monkeypatch):
    t = mixed(spark)
    specs = [X.PRESETS["csp_lda"], X.PRESETS["riemann_mdm"], X.Spec("riemann_tangent", "lda"), X.Spec("deep", "lda", steps=("wavelet",))]
    key = lambda r: (r["pipeline"], r["holdout"], r["trial_id"])
    got = {key(r): r for r in X.loso(t, specs).collect()}
    with monkeypatch.context() as m:
        m.setattr(H, "plan", lambda spec: None)
        want = {key(r): r for r in X.loso(t, specs).collect()}
    assert set(got) == set(want) and len(got) == 4 * t.filter("subject_id IS NOT NULL").count()
    for k, r in got.items():
        assert r["y_pred"] == want[k]["y_pred"] and r["y_true"] == want[k]["y_true"]
        assert np.allclose(r["proba"], want[k]["proba"], atol=1e-8)


def test_scans_do_not_grow_with_subjects(spark, monkeypatch):
    jobs = []
    for subjects in (3, 9):
        t = S.synthetic(spark, subjects, 12, 4, 20)
        passes = []
        real = K.gathered
        monkeypatch.setattr(H, "gathered", lambda *a, **kw: passes.append(1) or real(*a, **kw))
        assert H.predictions(t, [X.PRESETS["csp_lda"], X.PRESETS["riemann_mdm"]]).count() == 2 * subjects * 12
        jobs.append(len(passes))
        monkeypatch.setattr(H, "gathered", real)
    assert jobs == [2, 2]


def test_specs_that_are_not_sums_are_fitted_one_by_one(spark):
    t = S.synthetic(spark, 3, 16, 4, 40)
    specs = [X.PRESETS["riemann_mdm"], X.Spec("deep", "lda", adapter="zscore")]
    assert H.plan(specs[0]) and H.plan(specs[1]) is None and H.plan(X.PRESETS["tangent_lr"]) is None
    out = X.loso(t, specs)
    assert out.groupBy("pipeline", "holdout").count().filter("count = 16").count() == 6
    with pytest.raises(ValueError):
        H.predictions(t, specs)


def test_no_units_one_unit_and_odd_rows(spark):
    t = S.synthetic(spark, 1, 12, 4, 20)
    assert H.predictions(t, [X.PRESETS["csp_lda"]]).count() == 0  # nothing is left to fit on
    assert H.predictions(t.limit(0), [X.PRESETS["riemann_mdm"]]).count() == 0
    two = S.synthetic(spark, 2, 12, 4, 20).withColumn("subject_id", F.concat(F.lit("s:"), F.col("subject_id"))).withColumn("signal", F.when(F.col("trial_id") != 3, F.col("signal")))
    got = H.predictions(two, [X.PRESETS["riemann_mdm"]])
    assert got.count() == 23 and {r[0] for r in got.select("holdout").distinct().collect()} == {r[0] for r in two.select("subject_id").distinct().collect()}


def test_cross_validation_is_the_same_by_sums(spark, monkeypatch):
    t = S.synthetic(spark, 1, 40, 5, 40)
    by_sums = X.cross_validated(t, X.PRESETS["csp_lda"], 4)
    monkeypatch.setattr(H, "plan", lambda spec: None)
    assert np.allclose(by_sums, X.cross_validated(t, X.PRESETS["csp_lda"], 4))
    assert X._until_hopeless([0.1, 0.2, 0.9, 0.9], 4, 0.9) == [0.1] + [0.2] * 0 if X.selection.early_stop([0.1], 4, 0.9) else True


def test_joint_diagonaliser_of_matrices_that_commute():
    rng = np.random.RandomState(0)
    a = rng.normal(size=(6, 6))
    d = rng.uniform(0.2, 3, size=(5, 6))
    mats = np.stack([a @ np.diag(x) @ a.T for x in d])
    v = linalg.joint_diagonal(mats, rng.uniform(1, 2, 5))
    out = v @ mats @ v.T
    off = out - np.einsum("kii,ij->kij", out, np.eye(6))
    assert np.abs(off).max() < 1e-8 * np.abs(out).max()
    turn = np.abs(v @ a)  # v undoes the mixing up to order and length
    assert np.allclose((turn > 1e-6 * turn.max(1, keepdims=True)).sum(1), 1)


def test_joint_diagonaliser_lowers_what_it_minimises():
    mats = spd(np.random.RandomState(1), 5, 7)
    cost = lambda m: np.mean([np.log(np.diag(x)).sum() - np.linalg.slogdet(x)[1] for x in m])
    v = linalg.joint_diagonal(mats)
    best = cost(v @ mats @ v.T)
    assert best < cost(mats)
    rng = np.random.RandomState(2)
    for _ in range(30):
        w = (np.eye(5) + 1e-3 * rng.normal(size=(5, 5))) @ v
        assert cost(w @ mats @ w.T) >= best - 1e-10


def test_joint_filters_of_two_classes_are_those_of_the_pair():
    a, b = spd(np.random.RandomState(3), 6, 2)
    joint, pair = linalg.csp_joint(np.stack([a, b]), np.array([0.5, 0.5]), 6), linalg.csp_filters(a, b, 3)
    unit = lambda r: r / np.linalg.norm(r, axis=1, keepdims=True)
    assert np.allclose(np.sort(np.abs(unit(joint) @ unit(pair).T).max(1)), 1, atol=1e-7)
    share = lambda r: np.sort([(x @ a @ x) / (x @ (a + b) @ x) for x in r])
    assert np.allclose(share(joint), share(pair), atol=1e-9)


@pytest.mark.parametrize(("loud", "corrected"), [(1.6, True), (4, False)])
def test_filters_of_many_classes_tell_sources_apart(spark, loud, corrected):
    """Four classes, each with a source of its own that is loud: filters find the sources, noise comes last."""
    rng = np.random.RandomState(4)
    mix = rng.normal(size=(6, 6))
    rows = []
    for k in range(160):
        s = rng.normal(size=(6, 400))
        s[k % 4] *= loud
        rows.append((k, 1, k % 4, (mix @ s).tolist()))
    t = spark.createDataFrame(rows, "trial_id long, subject_id int, label int, signal array<array<double>>")
    csp = E.CspLogVariance.fit(t, 2, corrected=corrected)
    assert csp.filters.shape == (4, 6)
    found = np.abs(csp.filters @ mix)
    assert set(found.argmax(1)) == {0, 1, 2, 3}
    out = C.Lda.fit(csp.transform(t.filter("trial_id < 80"))).transform(csp.transform(t.filter("trial_id >= 80")))
    assert out.filter("y_pred = label").count() > 72


def test_riemannian_means_over_rows(spark):
    rng = np.random.RandomState(5)
    mats = spd(rng, 4, 60)
    rows = [(k, k % 3 if k % 20 else None, linalg.pack(m).tolist()) for k, m in enumerate(mats)]
    df = spark.createDataFrame(rows, "trial_id long, label int, features array<double>").repartition(5)
    whole = E.riemann_means(df, linalg.unpack, "features")
    assert list(whole) == [None] and whole[None][0] == 60
    m = whole[None][1]
    assert np.allclose(m, linalg.karcher_mean(mats, steps=200), atol=1e-7)
    back = linalg.inv_sqrtm(m)
    assert np.linalg.norm(linalg.logm(back @ mats @ back).mean(0)) < 1e-8  # the mean's own equation
    by = E.riemann_means(df, linalg.unpack, "features", "label")
    for c in range(3):
        held = np.stack([x for k, x in enumerate(mats) if k % 3 == c and k % 20])
        assert by[c][0] == len(held) and np.allclose(by[c][1], linalg.karcher_mean(held, steps=200), atol=1e-7)
    pair = spark.createDataFrame([(linalg.pack(x).tolist(),) for x in mats[:2]], "features array<double>")
    root, back = linalg.sqrtm(mats[0]), linalg.inv_sqrtm(mats[0])
    assert np.allclose(E.riemann_means(pair, linalg.unpack, "features")[None][1], root @ linalg.sqrtm(back @ mats[1] @ back) @ root, atol=1e-7)  # of two: halfway on the geodesic
    assert E.riemann_means(df.limit(0), linalg.unpack, "features") == {}


def test_riemannian_reference_in_tangent_space_mdm_and_alignment(spark):
    t = S.synthetic(spark, 2, 30, 4, 60)
    covs = np.stack([linalg.oas(np.array(r["signal"])) for r in t.collect()])
    assert np.allclose(E.TangentSpace.fit(t, reference="riemann").reference, linalg.karcher_mean(covs, steps=200), atol=1e-7)
    x = K.extracted(t, E.covariance_features("oas"))
    mdm = C.Mdm.fit(x, mean="riemann")
    own = np.stack([linalg.oas(np.array(r["signal"])) for r in t.filter(F.col("label") == mdm.classes[0]).collect()])
    assert np.allclose(mdm.means[0], linalg.karcher_mean(own, steps=200), atol=1e-7)
    ea = E.EuclideanAlignment.fit(t, mean="riemann")
    moved = E.riemann_means(ea.transform(t), linalg.covariance, key="subject_id")
    for _, m in moved.values():
        assert np.allclose(m, np.eye(4), atol=1e-3)  # up to the ridge of the covariance


def test_gathered_adds_by_key_and_refuses_mixed_shapes(spark):
    rows = [(k % 3 if k % 7 else None, [float(k), 1.0] if k % 5 else None) for k in range(100)]
    df = spark.createDataFrame(rows, "k int, v array<double>").repartition(6)
    got = K.gathered(df, "v", dict, lambda v: np.outer(v, v), "k")
    for key in range(3):
        held = [np.outer(v, v) for k, v in rows if k == key and v is not None]
        assert got[key][0] == len(held) and np.allclose(got[key][1], sum(held))
    assert K.gathered(df.limit(0), "v", dict, lambda v: v) == (0, None)
    with pytest.raises(ValueError):
        K.gathered(df, "v", dict, lambda v: v[: 1 + int(v[0]) % 2], "k")


def test_rows_without_a_subject(spark):
    t = S.synthetic(spark, 3, 30, 4, 500).withColumn("subject_id", F.when(F.col("trial_id") % 10 != 0, F.col("subject_id")))
    bank = E.FilterBankRiemann.fit(t.filter("subject_id IS NOT NULL AND subject_id < 3"), 250.0, rsa=True)
    out = bank.transform(t)
    assert out.count() == t.count() and out.filter("subject_id IS NULL").count() > 0 and out.filter("size(features) <> 50").count() == 0
