import numpy as np
import pytest
from pyspark.sql import functions as F

from lattica.functions import dsp, linalg
from lattica.operators import adapters as D
from lattica.operators import classifiers as C
from lattica.operators import features as E
from lattica.operators import kernels as K
from lattica.operators import signal as G
from lattica.sources import datasets as S

T = np.arange(1000) / 250


def gain(y, x):
    return np.sqrt((y[200:-200] ** 2).mean() / (x[200:-200] ** 2).mean())


def test_bandpass_and_notch_attenuate():
    b, a = dsp.butter_bandpass(5, 8, 30, 250)
    for f, low, high in ((2, 0, 0.01), (15, 0.98, 1.02), (60, 0, 0.01)):
        x = np.sin(2 * np.pi * f * T)
        assert low <= gain(dsp.filtfilt(b, a, x), x) <= high
    b, a = dsp.notch(50, 30, 250)
    assert gain(dsp.filtfilt(b, a, np.sin(2 * np.pi * 50 * T)), np.sin(2 * np.pi * 50 * T)) < 0.15
    assert gain(dsp.filtfilt(b, a, np.sin(2 * np.pi * 20 * T)), np.sin(2 * np.pi * 20 * T)) > 0.98


def test_filter_state_continues_a_stream():
    b, a = dsp.butter_bandpass(3, 8, 30, 250)
    x = np.random.RandomState(0).normal(size=(2, 300))
    whole = dsp.lfilter(b, a, x)[0]
    first, z = dsp.lfilter(b, a, x[:, :120])
    assert np.allclose(np.concatenate((first, dsp.lfilter(b, a, x[:, 120:], z)[0]), 1), whole)


def test_wavelets_invert_and_mirror_borders():
    rng = np.random.RandomState(1)
    for n, levels in ((128, 3), (127, 3), (50, 4)):
        x = rng.normal(size=(3, n))
        parts = dsp.dwt(x, levels)
        sizes = [n]
        for _ in range(levels):
            sizes.append((sizes[-1] + 7) // 2)
        assert [p.shape[-1] for p in parts] == [sizes[-1], *sizes[:0:-1]] and np.allclose(dsp.idwt(parts, n), x)
    quiet = np.zeros(256)  # silent borders: mirroring adds nothing, so the transform is orthogonal
    quiet[100:156] = rng.normal(size=56)
    assert np.isclose(sum((p**2).sum() for p in dsp.dwt(quiet, 3)), (quiet**2).sum())
    flat = dsp.dwt(np.full(32, 3.0), 1)  # a mirrored constant stays one
    assert np.allclose(flat[0], 3.0 * np.sqrt(2)) and np.allclose(flat[1], 0)


def test_wavelets_remove_noise():
    noisy = np.sin(2 * np.pi * 3 * np.arange(512) / 512) + 0.2 * np.random.RandomState(2).normal(size=512)
    clean = np.sin(2 * np.pi * 3 * np.arange(512) / 512)
    assert ((dsp.wavelet_denoise(noisy) - clean) ** 2).mean() < ((noisy - clean) ** 2).mean()


def test_welch_finds_the_peak():
    f, p = dsp.welch(np.sin(2 * np.pi * 12 * T), 250.0)
    assert abs(f[p.argmax()] - 12) < 1
    bands = dsp.band_powers(np.sin(2 * np.pi * 10 * T)[None], 250.0)
    assert bands["alpha"] > 10 * bands["beta"]


def test_matrix_functions():
    rng = np.random.RandomState(0)
    x = rng.normal(size=(6, 4, 50))
    c = linalg.covariance(x)
    assert np.allclose(linalg.expm(linalg.logm(c)), c) and np.allclose(linalg.sqrtm(c) @ linalg.sqrtm(c), c)
    assert np.allclose(linalg.inv_sqrtm(c) @ c @ linalg.inv_sqrtm(c), np.eye(4))
    assert np.allclose(linalg.unpack(linalg.pack(c)), c) and linalg.side(5) is None
    assert np.isclose(linalg.riemann_distance(np.diag([1.0, np.e]), np.eye(2)), 1)
    assert np.allclose(linalg.karcher_mean(np.stack([np.diag([1.0, 4.0]), np.diag([4.0, 1.0])])), 2 * np.eye(2))
    m = linalg.karcher_mean(c)
    assert np.allclose(linalg.tangent(c, m).mean(0), 0, atol=1e-6)
    assert np.allclose(linalg.transport(c[:1], c[0], c[1])[0], c[1])
    assert np.linalg.eigvalsh(linalg.oas(x[0])).min() > 0


def test_independent_components_separate():
    rng = np.random.RandomState(0)
    s = np.stack([np.sign(np.sin(T * 9)), rng.uniform(-1, 1, len(T))], 1)
    unmix, mix, mean = linalg.fast_ica(s @ np.array([[1.0, 0.5], [0.3, 1.0]]).T, 2)
    y = (s @ np.array([[1.0, 0.5], [0.3, 1.0]]).T - mean) @ unmix.T
    assert (np.abs(np.corrcoef(s.T, y.T)[:2, 2:]).max(1) > 0.95).all() and np.allclose(mix @ unmix, np.eye(2))


@pytest.fixture(scope="module")
def trials(spark):
    return S.synthetic(spark, 3, 24, 4, 256, classes=2, snr=1.0).cache()


def test_kernels_in_one_pass_equal_steps(spark, trials):
    a = K.mapped(trials, [K.notch(250), K.bandpass(250), K.car()]).orderBy("trial_id").first()["signal"]
    x = np.array(trials.orderBy("trial_id").first()["signal"])
    for k in K.mandatory(250):
        x = k(x)
    assert np.allclose(a, x)


def test_sql_car_equals_the_kernel(spark, trials):
    few = trials.filter("trial_id < 3").select("subject_id", "trial_id", "signal")
    sql = {r["trial_id"]: np.array(r["signal"]) for r in G.to_trials(G.car(G.to_samples(few))).collect()}
    for r in K.mapped(few, [K.car()]).collect():
        assert np.allclose(sql[r["trial_id"]], r["signal"])


def test_models_tell_synthetic_classes(spark, trials):
    train, test = trials.filter("trial_id % 2 = 0 OR trial_id % 4 = 1"), trials.filter("trial_id % 4 = 3 OR trial_id % 4 = 2")
    csp = E.CspLogVariance.fit(train, 1)
    lda = C.Lda.fit(csp.transform(train))
    acc = lambda m, d: m.transform(d).filter("y_pred = label").count() / d.count()
    assert acc(lda, csp.transform(test)) > 0.9
    cov = lambda d: K.extracted(d, E.covariance_features("oas"))
    assert acc(C.Mdm.fit(cov(train)), cov(test)) > 0.9
    space = E.TangentSpace.fit(train, zscore=True)
    assert acc(C.MlModel.fit(space.transform(train), "logistic", maxIter=10), space.transform(test)) > 0.9


def test_alignment_whitens_and_guards(spark, trials):
    ea = E.EuclideanAlignment.fit(trials.filter("subject_id <> 3"), target=3)
    done = ea.transform(trials.filter("subject_id = 1"))
    mean = np.mean([linalg.covariance(np.array(r["signal"])) for r in done.collect()], 0)
    assert np.allclose(mean, np.eye(4), atol=0.05)
    with pytest.raises(ValueError, match="held out"):
        E.EuclideanAlignment.fit(trials, target=3)


def test_adapters(spark):
    rng = np.random.RandomState(0)
    a = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rng.normal(size=(60, 6)))], "trial_id long, features array<double>")
    b = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rng.normal(size=(80, 6)) * [1, 2, 3, 1, 1, 1] + 5)], "trial_id long, features array<double>")
    z = np.array([r["features"] for r in D.ZScore.fit(a, b).transform(a).collect()])
    t = np.array([r["features"] for r in b.collect()])
    assert np.allclose(z.mean(0), t.mean(0)) and np.allclose(z.std(0), t.std(0))
    c = np.array([r["features"] for r in D.Coral.fit(a, b, eps=1e-9).transform(a).collect()])
    assert np.allclose(np.cov(c.T), np.cov(t.T), atol=1e-4)
    assert D.Coral.fit(a, b, most=3).transform(a).collect() == a.collect()
    wide = a.select("trial_id", F.slice("features", 1, 5).alias("features"))
    assert D.RiemannTransport.fit(wide, wide).transform(wide).collect() == wide.collect()


def test_ensemble_and_platt(spark):
    df = spark.createDataFrame([(1, 0, [0.6, 0.4]), (1, 0, [0.1, 0.9]), (2, 1, [0.2, 0.8])], "trial_id int, label int, proba array<double>")
    got = {r["trial_id"]: (r["y_pred"], [round(x, 3) for x in r["proba"]]) for r in C.ensemble(df, ["trial_id"]).collect()}
    assert got == {1: (1, [0.35, 0.65]), 2: (1, [0.2, 0.8])}
    assert all(abs(sum(r["proba"]) - 1) < 1e-9 for r in C.platt(df).collect())
