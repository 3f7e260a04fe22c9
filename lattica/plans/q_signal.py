"""Windows and signal operators over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from lattica.operators import signal as G
from lattica.operators import windows as N
from lattica.operators.adapters import ZScore, subject_weights
from lattica.plans import bindings as B

T = "subject_id, trial_id"


def neighbours(spark):
    """A ring of four of the eight channels; the others have no neighbours."""
    return spark.createDataFrame([(0, 1), (0, 3), (1, 0), (1, 2), (2, 1), (2, 3), (3, 2), (3, 0)], "channel int, neighbour int")


RING = "ring AS (SELECT * FROM (VALUES (0, 1), (0, 3), (1, 0), (1, 2), (2, 1), (2, 3), (3, 2), (3, 0)) t(channel, neighbour))"


def q_sliding(spark, sf):
    w = N.sliding(B.features(spark, sf), "features", 16, 0.75)
    return w.select("trial_id", "start", "stop", F.round(F.aggregate("window", F.lit(0.0), lambda a, v: a + v), 9).alias("total"))


def q_multichannel(spark, sf):
    w = N.multichannel(B.trials(spark, sf), "signal", 4, 0.5)
    return w.select("trial_id", "start", "stop", F.round(F.aggregate(F.flatten("window"), F.lit(0.0), lambda a, v: a + v), 9).alias("total"))


def q_tiles(spark, sf):
    e = B.table(spark, sf, "events").select("user_id", "event_id")
    return N.full_tiles(e.withColumn("grp", F.col("event_id") % 1).select("grp", "event_id"), ["grp"], "event_id", 128)


def q_rolling(spark, sf):
    r = N.rolling(B.outcomes(spark, sf), ["subject_id"], ["ts", "event_id"], F.col("correct"), 20, 10, "accuracy")
    return B.rounded(N.low_run(r, ["subject_id"], ["ts", "event_id"], "accuracy", 3, 0.8, "low").select("subject_id", "event_id", "accuracy", "low"))


def q_chunks(spark, sf):
    o = B.outcomes(spark, sf).withColumn("y_true", F.lit(1.0)).withColumn("y_pred", F.col("correct"))
    return B.rounded(N.chunk_stability(o, ["subject_id"], ["ts", "event_id"]))


def q_newest(spark, sf):
    return N.newest(B.outcomes(spark, sf), ["subject_id"], ["ts", "event_id"], 50).select("subject_id", "event_id")


def q_latest(spark, sf):
    return N.latest(B.table(spark, sf, "events"), ["event_type"], ["ts", "event_id"], 100).select("event_type", "event_id")


def q_edges(spark, sf):
    e = B.table(spark, sf, "events").select("user_id", "ts", "event_id", "event_type")
    return N.edges(e, ["user_id"], "event_id", "event_type", ["click", "error"]).select("user_id", "event_id", "event_type")


def q_segments(spark, sf):
    e = B.table(spark, sf, "events")
    start = e.filter("event_type = 'error'").select("user_id", F.col("event_id").alias("start"))
    s = e.select("user_id", F.col("event_id").alias("idx"), "value")
    g = N.segments(start, s, ["user_id"], "start", "idx", 500)
    return B.rounded(g.groupBy("user_id", "start").agg(F.count("*").alias("n"), F.sum("value").alias("total")), 6)


def q_event_windows(spark, sf):
    e = B.table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    g = e.groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return B.rounded(g.select(F.date_format("w.start", "yyyy-MM-dd").alias("day"), "event_type", "n", "total"), 6)


def _samples(f):
    return lambda spark, sf: B.rounded(f(spark, B.samples(spark, sf)))


def q_asr(spark, s):
    return G.asr(s, G.channel_baseline(s), 3, 1.5)


def q_zscore_adapter(spark, sf):
    f = B.features(spark, sf)
    z = ZScore.fit(f.filter("subject_id <> 3"), f.filter("subject_id = 3"))
    out = z.transform(f.filter("subject_id <> 3"))
    return out.select("trial_id", F.round(F.aggregate("features", F.lit(0.0), lambda a, v: a + v), 6).alias("total"), F.round(F.col("features")[5], 6).alias("x5"))


def q_weights(spark, sf):
    f = B.features(spark, sf)
    return B.rounded(subject_weights(f.filter("subject_id <> 3"), f.filter("subject_id = 3")))


def q_deep(spark, sf):
    return B.rounded(G.mean_std(B.samples(spark, sf)))


SMP = f"WITH {B.SAMPLES}"
ROLL = "ROWS BETWEEN 19 PRECEDING AND CURRENT ROW"

QUERIES = {
    "sliding_windows": q_sliding,
    "multichannel_windows": q_multichannel,
    "tumbling_tiles": q_tiles,
    "rolling_accuracy": q_rolling,
    "chunk_stability": q_chunks,
    "newest_n": q_newest,
    "latest_n": q_latest,
    "event_edges": q_edges,
    "event_segments": q_segments,
    "event_windows": q_event_windows,
    "car": _samples(lambda spark, s: G.car(s)),
    "laplacian": _samples(lambda spark, s: G.laplacian(s, neighbours(spark))),
    "asr": _samples(q_asr),
    "signal_quality": _samples(lambda spark, s: G.signal_quality(s, 2.0)),
    "signal_repair": _samples(lambda spark, s: G.repair(s, 2.0)),
    "subject_zscore": _samples(lambda spark, s: G.standardise(s)),
    "covariance_upper": _samples(lambda spark, s: G.covariance_upper(s)),
    "psd_dft": _samples(lambda spark, s: G.psd_dft(s, 8, 1, 3)),
    "temporal_features": _samples(lambda spark, s: G.temporal_features(s, 2, 8)),
    "deep_mean_std": q_deep,
    "zscore_adapter": q_zscore_adapter,
    "subject_similarity_weights": q_weights,
}

ORACLES = {
    "sliding_windows": f"WITH {B.EMB} SELECT trial_id, CAST(s AS INTEGER) AS start, CAST(s + 16 AS INTEGER) AS stop, round(list_sum(list_slice(f, s + 1, s + 16)), 9) AS total FROM emb, range(0, 49, 4) t(s)",
    "multichannel_windows": f"{SMP} SELECT trial_id, CAST(s AS INTEGER) AS start, CAST(s + 4 AS INTEGER) AS stop, round(sum(value), 9) AS total FROM smp, range(0, 5, 2) t(s) WHERE sample_idx >= s AND sample_idx < s + 4 GROUP BY ALL",
    "tumbling_tiles": "SELECT CAST(0 AS BIGINT) AS grp, event_id // 128 AS tile, count(*) AS n, min(event_id) AS first, max(event_id) AS last FROM events GROUP BY 2 HAVING count(*) = 128",
    "rolling_accuracy": f"WITH {B.OUT}, r AS (SELECT subject_id, event_id, ts, CASE WHEN count(*) OVER w >= 10 THEN avg(correct) OVER w END AS accuracy FROM outc WINDOW w AS (PARTITION BY subject_id ORDER BY ts, event_id {ROLL})) SELECT subject_id, event_id, round(accuracy, 9) AS accuracy, coalesce(count(accuracy) OVER v = 3 AND max(accuracy) OVER v < 0.8, false) AS low FROM r WINDOW v AS (PARTITION BY subject_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)",
    "chunk_stability": f"WITH {B.OUT}, r AS (SELECT subject_id, correct, row_number() OVER (PARTITION BY subject_id ORDER BY ts, event_id) - 1 AS i, count(*) OVER (PARTITION BY subject_id) AS n FROM outc), c AS (SELECT subject_id, i // greatest(5, n // 5) AS c, avg(correct) AS a FROM r WHERE (i // greatest(5, n // 5)) * greatest(5, n // 5) < n - greatest(5, n // 5) GROUP BY ALL) SELECT subject_id, count(*) AS n_chunks, round(1 - coalesce(var_pop(a), 0), 9) AS stability FROM c GROUP BY 1",
    "newest_n": f"WITH {B.OUT}, r AS (SELECT *, row_number() OVER (PARTITION BY subject_id ORDER BY ts DESC, event_id DESC) AS r, count(*) OVER (PARTITION BY subject_id) AS n FROM outc) SELECT subject_id, event_id FROM r WHERE r <= 50 AND n >= 50",
    "latest_n": "SELECT event_type, event_id FROM events QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) <= 100",
    "event_edges": "SELECT user_id, event_id, event_type FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS p FROM events) WHERE event_type IN ('click', 'error') AND (p IS NULL OR p <> event_type)",
    "event_segments": "SELECT e.user_id, e.event_id AS start, count(*) AS n, round(sum(s.value), 6) AS total FROM events e JOIN events s ON s.user_id = e.user_id AND s.event_id >= e.event_id AND s.event_id < e.event_id + 500 WHERE e.event_type = 'error' GROUP BY ALL",
    "event_windows": "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY ALL",
    "car": f"{SMP} SELECT {T}, channel, sample_idx, round(value - avg(value) OVER (PARTITION BY {T}, sample_idx), 9) AS value FROM smp",
    "laplacian": f"{SMP}, {RING}, m AS (SELECT s.subject_id, s.trial_id, s.channel, s.sample_idx, avg(n.value) AS near FROM smp s JOIN ring r USING (channel) JOIN smp n ON n.trial_id = s.trial_id AND n.sample_idx = s.sample_idx AND n.channel = r.neighbour GROUP BY ALL), c AS (SELECT *, avg(value) OVER (PARTITION BY {T}, sample_idx) AS car FROM smp) SELECT c.subject_id, c.trial_id, c.channel, c.sample_idx, round(c.value - coalesce(m.near, c.car), 9) AS value FROM c LEFT JOIN m USING (trial_id, channel, sample_idx)",
    "asr": f"{SMP}, b AS (SELECT channel, stddev_pop(value) AS base FROM smp GROUP BY 1), t AS (SELECT smp.*, base, stddev_pop(value) OVER (PARTITION BY {T}, channel, sample_idx // 3) AS sd FROM smp JOIN b USING (channel)) SELECT {T}, channel, sample_idx, round(CASE WHEN sd > base * 1.5 THEN value * (base * 1.5) / sd ELSE value END, 9) AS value FROM t",
    "signal_quality": f"{SMP}, s AS (SELECT {T}, channel, var_pop(value) AS var, coalesce(kurtosis_pop(value), 0) AS kurt FROM smp GROUP BY ALL), m AS (SELECT channel, avg(var) AS mv, stddev_pop(var) AS sv, avg(kurt) AS mk, stddev_pop(kurt) AS sk FROM s GROUP BY 1) SELECT {T}, channel, round(var, 9) AS var, round(kurt, 9) AS kurt, (var - mv) / (sv + 1e-9::DOUBLE) > 2.0 OR (kurt - mk) / (sk + 1e-9::DOUBLE) > 2.0 AS bad FROM s JOIN m USING (channel)",
    "signal_repair": f"{SMP}, s AS (SELECT {T}, channel, var_pop(value) AS var, coalesce(kurtosis_pop(value), 0) AS kurt FROM smp GROUP BY ALL), m AS (SELECT channel, avg(var) AS mv, stddev_pop(var) AS sv, avg(kurt) AS mk, stddev_pop(kurt) AS sk FROM s GROUP BY 1), q AS (SELECT {T}, channel, (var - mv) / (sv + 1e-9::DOUBLE) > 2.0 OR (kurt - mk) / (sk + 1e-9::DOUBLE) > 2.0 AS bad FROM s JOIN m USING (channel)) SELECT {T}, channel, sample_idx, round(CASE WHEN bad THEN (sum(value) OVER w - value) / 7 ELSE value END, 9) AS value FROM smp JOIN q USING (subject_id, trial_id, channel) WINDOW w AS (PARTITION BY {T}, sample_idx)",
    "subject_zscore": f"{SMP}, m AS (SELECT subject_id, channel, avg(value) AS m, stddev_pop(value) AS s FROM smp GROUP BY ALL) SELECT subject_id, trial_id, channel, sample_idx, round((value - m) / (s + 1e-8), 9) AS value FROM smp JOIN m USING (subject_id, channel)",
    "covariance_upper": f"{SMP} SELECT a.subject_id, a.trial_id, a.channel AS i, b.channel AS j, round(covar_samp(a.value, b.value), 9) AS cov FROM smp a JOIN smp b ON a.trial_id = b.trial_id AND a.sample_idx = b.sample_idx AND a.channel <= b.channel GROUP BY ALL",
    "psd_dft": f"{SMP}, d AS (SELECT {T}, channel, CAST(k AS INTEGER) AS k, sum(value * cos(2 * 3.141592653589793::DOUBLE * k * sample_idx / 8.0)) AS re, sum(value * sin(2 * 3.141592653589793::DOUBLE * k * sample_idx / 8.0)) AS im FROM smp, range(1, 4) t(k) GROUP BY ALL) SELECT {T}, channel, k, round(re * re + im * im, 9) AS power FROM d",
    "temporal_features": f"{SMP}, d AS (SELECT *, value - lag(value) OVER (PARTITION BY {T}, channel ORDER BY sample_idx) AS d, CAST(sample_idx * 2 // 8 AS INTEGER) AS tile FROM smp) SELECT {T}, channel, tile, round(ln(var_pop(value) + 1e-10), 9) AS log_var, round(sqrt(var_pop(d) / (var_pop(value) + 1e-12)), 9) AS mobility FROM d GROUP BY ALL",
    "deep_mean_std": f"{SMP} SELECT {T}, channel, round(avg(value), 9) AS mean, round(stddev_pop(value) + 1e-10, 9) AS std FROM smp GROUP BY ALL",
    "zscore_adapter": f"WITH {B.EMB}, l AS (SELECT trial_id, subject_id, i, f[i + 1] AS x FROM emb, range(64) t(i)), s AS (SELECT i, avg(x) AS m, stddev_pop(x) AS s FROM l WHERE subject_id <> 3 GROUP BY 1), t AS (SELECT i, avg(x) AS m, stddev_pop(x) AS s FROM l WHERE subject_id = 3 GROUP BY 1), z AS (SELECT trial_id, i, (x - s.m) / s.s * t.s + t.m AS z FROM l JOIN s USING (i) JOIN t USING (i) WHERE subject_id <> 3) SELECT trial_id, round(sum(z), 6) AS total, round(max(CASE WHEN i = 5 THEN z END), 6) AS x5 FROM z GROUP BY 1",
    "subject_similarity_weights": f"WITH {B.EMB}, l AS (SELECT subject_id, i, f[i + 1] AS x FROM emb, range(64) t(i)), m AS (SELECT subject_id, i, avg(x) AS m FROM l GROUP BY ALL), d AS (SELECT a.subject_id, sqrt(sum((a.m - b.m) * (a.m - b.m))) AS distance FROM m a JOIN m b ON b.subject_id = 3 AND a.i = b.i WHERE a.subject_id <> 3 GROUP BY 1) SELECT subject_id, round(distance, 9) AS distance, round(1 / (1 + distance) / sum(1 / (1 + distance)) OVER (), 9) AS weight FROM d",
}
