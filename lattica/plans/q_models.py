"""Kernels, models and streams over the driver's tables: rows-only checks, as SQL can't express them."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from lattica.functions import linalg
from lattica.functions.dsp import DB4
from lattica.functions.metrics import accuracy, kappa
from lattica.operators import adapters as D
from lattica.operators import classifiers as C
from lattica.operators import features as E
from lattica.operators import kernels as K
from lattica.plans import bindings as B
from lattica.session import shared_path
from lattica.sources import datasets as S
from lattica.streaming import stateful as T
from lattica.streaming import streams as R


def _scored(model, train, test, column="features"):
    out = model.transform(test, column) if column != "features" else model.transform(test)
    p = out.withColumnRenamed("label", "y_true").withColumn("run", F.lit(1))
    return accuracy(p, ["run"]).join(kappa(p, ["run"]), "run")


def _by_dim(df):
    """A row for each component of each vector, rounded."""
    return df.select("trial_id", F.posexplode("features").alias("dim", "value")).withColumn("value", F.round("value", 7))


def _halves(df):
    return df.filter("trial_id % 2 = 0"), df.filter("trial_id % 2 = 1")


def q_bandpass_power(spark, sf):
    """The table's trials, 32 of a subject end to end, through notch, bandpass and reference, then band powers: one Arrow pass."""
    return K.extracted(B.long_trials(spark, sf), E.band_powers(250.0), kernels=K.chain(250.0))


def q_denoised(spark, sf):
    t = K.mapped(B.trials(spark, sf), [K.car(), K.wavelet_denoise(1)])
    return t.select("trial_id", F.aggregate(F.flatten("signal"), F.lit(0.0), lambda a, v: a + v * v).alias("energy"))


def q_psd(spark, sf):
    return _by_dim(K.extracted(B.trials(spark, sf), E.psd(8.0, 8)))


def q_wavelet(spark, sf):
    return _by_dim(K.extracted(B.trials(spark, sf), E.wavelet_energy(1)))


def q_oas(spark, sf):
    return _by_dim(K.extracted(B.trials(spark, sf), E.covariance_features("oas")))


def q_csp_lda(spark, sf):
    train, test = _halves(B.trials(spark, sf))
    csp = E.CspLogVariance.fit(train, 2)
    return _scored(C.Lda.fit(csp.transform(train)), None, csp.transform(test))


def q_tangent_mdm(spark, sf):
    train, test = _halves(B.trials(spark, sf))
    cov = lambda d: K.extracted(d, E.covariance_features("oas"))
    return _scored(C.Mdm.fit(cov(train)), None, cov(test))


def q_tangent_logistic(spark, sf):
    train, test = _halves(B.trials(spark, sf))
    space = E.TangentSpace.fit(train, zscore=True)
    return _scored(C.MlModel.fit(space.transform(train), "logistic", maxIter=20), None, space.transform(test))


def q_ea(spark, sf):
    t = B.trials(spark, sf)
    ea = E.EuclideanAlignment.fit(t.filter("subject_id <> 3"), target=3)
    return ea.transform(t).select("subject_id", "trial_id", F.aggregate(F.flatten("signal"), F.lit(0.0), lambda a, v: a + v * v).alias("energy"))


def q_lda(spark, sf):
    train, test = _halves(B.features(spark, sf))
    return _scored(C.Lda.fit(train, 0.1), None, test)


def q_forest(spark, sf):
    train, test = _halves(B.features(spark, sf))
    return _scored(C.MlModel.fit(train, "random_forest"), None, test)


def q_coral(spark, sf):
    f = B.features(spark, sf)
    c = D.Coral.fit(f.filter("subject_id <> 3"), f.filter("subject_id = 3"))
    return c.transform(f.filter("subject_id <> 3"))


def q_transport(spark, sf):
    t = K.extracted(B.trials(spark, sf), E.covariance_features("oas"))
    r = D.RiemannTransport.fit(t.filter("subject_id <> 3"), t.filter("subject_id = 3"))
    return r.transform(t.filter("subject_id <> 3"))


def q_filter_bank(spark, sf):
    t = B.long_trials(spark, sf)
    return E.FilterBankRiemann.fit(t, 250.0, with_temporal=True).transform(t)


def _streamed(spark, sf, name):
    """A table's files as a stream, one micro-batch. A table that is one file is named by a filter on its folder, which a stream needs; Spark says which it is, so any store will do."""
    path = f"{sf}/{name}.parquet"
    table = spark.read.parquet(path)
    reader = spark.readStream.schema(table.schema)
    if any(f.endswith(f"/{name}.parquet") for f in table.inputFiles()[:1]):
        return reader.option("pathGlobFilter", f"{name}.parquet").parquet(sf)
    return reader.parquet(path)


def _events(spark, sf):
    return _streamed(spark, sf, "events")


def _outcomes(df):
    return df.select(F.col("user_id").alias("subject_id"), "event_id", F.when(F.col("event_type") != "error", 1.0).otherwise(0.0).alias("correct"))


def q_drift_stream(spark, sf):
    """Drift by subject from a stream with state."""
    return R.run_once(R.drift(_outcomes(_events(spark, sf))))


def q_drift_table(spark, sf):
    return B.rounded(R.drift_table(_outcomes(B.table(spark, sf, "events"))))


def q_window_stream(spark, sf):
    e = R.timed(_events(spark, sf))
    w = R.sliding(e, "ts", "1 day", "12 hours", ["event_type"], [F.count(F.lit(1)).alias("n")])
    t = R.run_once(w, "complete")
    return t.select(F.date_format("start", "yyyy-MM-dd HH:mm").alias("start"), F.date_format("end", "yyyy-MM-dd HH:mm").alias("end"), "event_type", "n")


def q_ordered_windows(spark, sf):
    """Windows of eight events, four apart, of each user in order of time: the share of errors in each. Events in the last hour wait for the watermark."""
    e = R.timed(_events(spark, sf)).select("user_id", "event_id", "ts", F.array(F.when(F.col("event_type") == "error", 1.0).otherwise(0.0)).alias("x"))
    w = T.run_once(T.windows(e, 8, 4, lambda x: x.mean(1), key="user_id", number="event_id", values="x", watermark="1 hour"))
    return w.select("user_id", "start", "stop", F.col("scores")[0].alias("share"))


def q_selector_stream(spark, sf):
    """Each subject's trials, one a second, through online calibration among three candidates, prediction and drift."""
    whole = _streamed(spark, sf, "embeddings")
    t = whole.select((F.col("vec_id") % B.SUBJECTS).alias("subject_id"), F.col("vec_id").alias("trial_id"), F.timestamp_seconds(F.col("vec_id")).alias("ts"), "label", F.transform("embedding", lambda x: x.cast("double")).alias("features"))
    candidates = [T.Candidate("all", None, 1.0), T.Candidate("first", list(range(8)), 0.5), T.Candidate("all_shrunk", None, 0.5)]
    return T.run_once(T.selector(t, candidates, calibrate=20, tick=200)).withColumn("rolling_accuracy", F.round("rolling_accuracy", 9))


def q_synthetic(spark, sf):
    return S.synthetic(spark, 2, 20, 4, 100).select("subject_id", "trial_id", "label", F.size("signal").alias("channels"))


def q_ica(spark, sf):
    t = B.long_trials(spark, sf)
    x = np.concatenate([np.array(r["signal"]).T for r in t.filter("subject_id = 0").orderBy("trial_id").limit(8).collect()])  # fitted on eight runs of a subject, applied to all
    return K.mapped(t, [K.ica_clean(x, 4, (0,))]).select("trial_id", F.size("signal").alias("channels"), F.size(F.col("signal")[0]).alias("samples"))


def q_loso_evaluation(spark, sf):
    """Two pipelines over every subject of the table held out in turn: a row of metrics each. Trials and predictions are written once."""
    from lattica.operators import experiments as X

    def stored(df, tag):
        path = shared_path(spark, tag)
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    t = B.trials(spark, sf)
    t = stored(t.repartition(max(t.rdd.getNumPartitions(), 2 * spark.sparkContext.defaultParallelism)), "loso-trials")  # every fit reads them, in as many tasks as there are cores
    return X.subject_table(X.loso(t, [X.PRESETS["csp_lda"], X.PRESETS["riemann_mdm"]]), B.CLASSES, 3.0)


def q_loso_pair(spark, sf):
    """A linear discriminant of two components, every subject held out in turn: trials predicted right, by subject."""
    from lattica.operators import experiments as X

    pair = B.features(spark, sf).select("subject_id", "trial_id", "label", F.array(F.slice("features", 1, 2)).alias("signal"))
    p = X.loso(pair, [X.Spec("raw", "lda")])
    return p.groupBy("holdout").agg(F.count("*").alias("n"), F.sum((F.col("y_pred") == F.col("y_true")).cast("long")).alias("n_right"))


def q_karcher_mean(spark, sf):
    """The affine-invariant mean of each class's covariances, a row an entry."""
    means = E.riemann_means(B.trials(spark, sf), linalg.oas, key="label")
    rows = [(int(k), n, i, j, round(float(m[i, j]), 7)) for k, (n, m) in sorted(means.items()) for i in range(len(m)) for j in range(len(m))]  # a matrix a class
    return spark.createDataFrame(rows, "label long, n long, i int, j int, value double")


def q_csp_joint(spark, sf):
    """Log variances behind the filters of all classes at once."""
    train, test = _halves(B.trials(spark, sf))
    return _by_dim(E.CspLogVariance.fit(train, 2).transform(test))


def q_calibrate(spark, sf):
    """Cross-validated metrics of two pipelines on the table's trials."""
    from lattica.operators import experiments as X

    return X.calibrate(B.trials(spark, sf), [X.PRESETS["csp_lda"], X.PRESETS["riemann_mdm"]])


def q_diagnostics(spark, sf):
    """Distances between subjects before and after alignment."""
    from lattica.operators import experiments as X

    d = X.alignment_diagnostics(B.trials(spark, sf))
    return spark.createDataFrame([(d["before"], d["after"])], "before double, after double")


def q_band_weights(spark, sf):
    from lattica.operators import experiments as X

    return B.rounded(X.band_weights(B.features(spark, sf), 8), 7)


QUERIES = {
    "loso_evaluation": q_loso_evaluation,
    "loso_pair": q_loso_pair,
    "karcher_mean": q_karcher_mean,
    "csp_joint": q_csp_joint,
    "calibrate": q_calibrate,
    "alignment_diagnostics": q_diagnostics,
    "band_weights": q_band_weights,
    "bandpass_power": q_bandpass_power,
    "denoised_energy": q_denoised,
    "psd_bins": q_psd,
    "wavelet_energy": q_wavelet,
    "oas_covariance": q_oas,
    "csp_lda": q_csp_lda,
    "tangent_mdm": q_tangent_mdm,
    "tangent_logistic": q_tangent_logistic,
    "euclidean_alignment": q_ea,
    "lda": q_lda,
    "random_forest": q_forest,
    "coral": q_coral,
    "riemann_transport": q_transport,
    "filter_bank_riemann": q_filter_bank,
    "drift_stream": q_drift_stream,
    "drift_table": q_drift_table,
    "window_stream": q_window_stream,
    "ordered_windows": q_ordered_windows,
    "selector_stream": q_selector_stream,
    "synthetic_trials": q_synthetic,
    "ica": q_ica,
}

ROLL = "(PARTITION BY subject_id ORDER BY event_id ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)"
DRIFT = f"""WITH o AS (SELECT user_id AS subject_id, event_id, CASE WHEN event_type <> 'error' THEN 1.0::DOUBLE ELSE 0 END AS correct FROM events),
r AS (SELECT *, CASE WHEN count(*) OVER {ROLL} >= 10 THEN avg(correct) OVER {ROLL} END AS accuracy FROM o)
SELECT subject_id, event_id, round(accuracy, 9) AS accuracy, 0.8::DOUBLE AS baseline,
 coalesce((count(accuracy) OVER w = 2 AND max(accuracy) OVER w < 0.35::DOUBLE) OR 0.8::DOUBLE - accuracy >= 0.15::DOUBLE, false) AS drift
FROM r WINDOW w AS (PARTITION BY subject_id ORDER BY event_id ROWS BETWEEN 1 PRECEDING AND CURRENT ROW)"""

WINDOWS = """WITH w AS (SELECT event_type, time_bucket(INTERVAL '12 hours', ts, TIMESTAMP '1970-01-01') - k * INTERVAL '12 hours' AS s FROM events, range(2) t(k))
SELECT strftime(s, '%Y-%m-%d %H:%M') AS start, strftime(s + INTERVAL '1 day', '%Y-%m-%d %H:%M') AS "end", event_type, count(*) AS n FROM w GROUP BY ALL"""

ORDERED = """WITH e AS (SELECT user_id, event_id, epoch_ms(ts) AS ms, CASE WHEN event_type = 'error' THEN 1.0::DOUBLE ELSE 0 END AS x FROM events),
n AS (SELECT user_id, x, row_number() OVER (PARTITION BY user_id ORDER BY ms, event_id) - 1 AS k FROM e WHERE ms <= (SELECT max(ms) - 3600000 FROM e)),
c AS (SELECT user_id, count(*) AS n FROM n GROUP BY 1),
w AS (SELECT user_id, 4 * i AS start FROM c, range(1000000) t(i) WHERE i <= (SELECT max(n) FROM c) // 4 AND 4 * i + 8 <= n)
SELECT w.user_id, start, start + 8 AS stop, avg(x) AS share FROM w JOIN n ON n.user_id = w.user_id AND k >= start AND k < start + 8 GROUP BY ALL"""

LOSO_PAIR = f"""WITH {B.EMB}, e AS (SELECT trial_id, subject_id AS s, label AS c, f[1] AS x, f[2] AS y FROM emb),
a AS (SELECT s, c, count(*) AS n, sum(x) AS sx, sum(y) AS sy, sum(x * x) AS xx, sum(x * y) AS xy, sum(y * y) AS yy FROM e GROUP BY ALL),
t AS (SELECT h.s, a.c, sum(n) AS n, sum(sx) AS sx, sum(sy) AS sy, sum(xx) AS xx, sum(xy) AS xy, sum(yy) AS yy FROM (SELECT DISTINCT s FROM e) h JOIN a ON a.s <> h.s GROUP BY ALL),
p AS (SELECT s, sum(n) AS m, (sum(xx - sx * sx / n)) / (sum(n) - count(*)) + 1e-9 AS p, sum(xy - sx * sy / n) / (sum(n) - count(*)) AS q, sum(yy - sy * sy / n) / (sum(n) - count(*)) + 1e-9 AS r FROM t GROUP BY s),
w AS (SELECT t.s, c, sx / n AS mx, sy / n AS my, (r * sx / n - q * sy / n) / (p * r - q * q) AS wx, (p * sy / n - q * sx / n) / (p * r - q * q) AS wy, n / m AS prior FROM t JOIN p USING (s)),
d AS (SELECT e.s, e.trial_id, e.c, w.c AS guess, row_number() OVER (PARTITION BY e.trial_id ORDER BY wx * x + wy * y + ln(prior) - 0.5 * (wx * mx + wy * my) DESC, w.c) AS k FROM e JOIN w USING (s))
SELECT s AS holdout, count(*) AS n, CAST(sum(CASE WHEN guess = c THEN 1 ELSE 0 END) AS BIGINT) AS n_right FROM d WHERE k = 1 GROUP BY s"""

#: The scaling filter of the wavelet, as SQL.
_LOW = "[" + ", ".join(f"{v!r}::DOUBLE" for v in DB4.tolist()) + "]"
_HIGH_SQL = "[" + ", ".join(f"{v!r}::DOUBLE" for v in (DB4[::-1] * ([1, -1] * 4)).tolist()) + "]"
#: Trials' channels as lists, and a border that is mirrored: place p of eight samples, from -7 to 14.
CHANNELS = B.EMB + ", ch AS (SELECT trial_id, c, list_slice(f, 8 * c + 1, 8 * c + 8) AS x FROM emb, range(8) t(c))"
MIRROR = "x[1 + CASE WHEN 2 * k + j - 6 < 0 THEN 5 - 2 * k - j WHEN 2 * k + j - 6 > 7 THEN 21 - 2 * k - j ELSE 2 * k + j - 6 END]"

ORACLES = {
    "ordered_windows": ORDERED, "loso_pair": LOSO_PAIR, "window_stream": WINDOWS, "drift_table": DRIFT, "drift_stream": DRIFT.replace("round(accuracy, 9)", "accuracy"),
    "synthetic_trials": "SELECT 1 + k // 20 AS subject_id, k AS trial_id, CAST(k % 20 % 4 AS INTEGER) AS label, CAST(4 AS INTEGER) AS channels FROM range(40) t(k)",
    "ica": "WITH g AS (SELECT vec_id % 9 AS s, vec_id // 288 AS r FROM embeddings GROUP BY ALL) SELECT r * 9 + s AS trial_id, CAST(8 AS INTEGER) AS channels, CAST(256 AS INTEGER) AS samples FROM g",
    "psd_bins": f"WITH {CHANNELS}, d AS (SELECT trial_id, c, k, sum(x[i + 1] * cos(2 * pi() * k * i / 8)) AS re, sum(x[i + 1] * sin(2 * pi() * k * i / 8)) AS im FROM ch, range(1, 5) t(k), range(8) u(i) GROUP BY ALL) SELECT trial_id, CAST(4 * c + k - 1 AS INTEGER) AS dim, round(re * re + im * im, 7) AS value FROM d",
    "wavelet_energy": f"WITH {CHANNELS}, w AS (SELECT trial_id, c, h, k, sum({MIRROR} * (CASE WHEN h = 0 THEN {_LOW} ELSE {_HIGH_SQL} END)[j + 1]) AS y FROM ch, range(2) t(h), range(7) u(k), range(8) v(j) GROUP BY ALL) SELECT trial_id, CAST(2 * c + h AS INTEGER) AS dim, round(sum(y * y), 7) AS value FROM w GROUP BY ALL",
    "oas_covariance": f"WITH {CHANNELS}, z AS (SELECT trial_id, c, list_transform(x, lambda v: v - list_avg(x)) AS z FROM ch), s AS (SELECT a.trial_id, a.c AS i, b.c AS j, list_dot_product(a.z, b.z) / 8 AS s FROM z a JOIN z b USING (trial_id)), m AS (SELECT trial_id, sum(CASE WHEN i = j THEN s END) / 8 AS mu, avg(s * s) AS p FROM s GROUP BY 1), q AS (SELECT *, CASE WHEN 9 * (p - mu * mu / 8) = 0 THEN 1.0::DOUBLE ELSE least(1.0::DOUBLE, (p + mu * mu) / (9 * (p - mu * mu / 8))) END AS q FROM m) SELECT trial_id, CAST(8 * i - i * (i - 1) // 2 + j - i AS INTEGER) AS dim, round((1 - q) * s + CASE WHEN i = j THEN q * mu ELSE 0 END, 7) AS value FROM s JOIN q USING (trial_id) WHERE i <= j",
    "band_weights": f"WITH {B.EMB}, l AS (SELECT label AS y, i AS dim, f[i + 1] AS x FROM emb, range(64) t(i) WHERE label IS NOT NULL), e AS (SELECT dim, min(x) AS lo, max(x) AS hi FROM l GROUP BY 1), b AS (SELECT dim, y, coalesce(least(7, CAST(floor((x - lo) / nullif(hi - lo, 0) * 8) AS INTEGER)), 0) AS bin FROM l JOIN e USING (dim)), c AS (SELECT dim, bin, y, count(*)::DOUBLE AS n FROM b GROUP BY ALL), d AS (SELECT *, sum(n) OVER (PARTITION BY dim, bin) AS nx, sum(n) OVER (PARTITION BY dim, y) AS ny, sum(n) OVER (PARTITION BY dim) AS t FROM c), m AS (SELECT dim, sum(n / t * ln(n * t / (nx * ny))) AS mi FROM d GROUP BY 1), w AS (SELECT CAST(dim // 8 AS INTEGER) AS band, avg(mi) + 1e-12::DOUBLE AS w FROM m GROUP BY 1) SELECT band, round(w / sum(w) OVER (), 7) AS weight FROM w",
}
