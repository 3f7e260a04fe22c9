"""Statistics, summaries and selection over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from lattica.functions import stats as X
from lattica.functions.metrics import accuracy
from lattica.operators import aggregates as A
from lattica.operators import selection as L
from lattica.plans import bindings as B


def subject_table(spark, sf):
    """(pipeline, subject_id, accuracy)."""
    return accuracy(B.predictions(spark, sf), ["pipeline", "subject_id"])


def pairs(spark, sf):
    t = subject_table(spark, sf)
    return X.aligned(t.filter("pipeline = 'p0'"), t.filter("pipeline = 'p1'"), "subject_id", "accuracy")


ACC = f"WITH {B.PRED}, acc AS (SELECT pipeline, subject_id, avg(CASE WHEN y_true = y_pred THEN 1.0::DOUBLE ELSE 0 END) AS accuracy FROM pred GROUP BY ALL)"
PAIRS = ACC + ", pr AS (SELECT a.subject_id, a.accuracy AS v1, b.accuracy AS v2, b.accuracy - a.accuracy AS d FROM acc a JOIN acc b USING (subject_id) WHERE a.pipeline = 'p0' AND b.pipeline = 'p1')"
EFFECT = PAIRS + ", ef AS (SELECT count(*) AS n, avg(v1) AS mean_1, avg(v2) AS mean_2, stddev_pop(v1) AS std_1, stddev_pop(v2) AS std_2, avg(d) AS mean_delta, stddev_pop(d) AS std_delta, stddev_samp(d) AS s FROM pr)"
R = lambda names, places=9: ", ".join(f"round({n}, {places}) AS {n}" for n in names)
PRICE = "SELECT c_nationkey AS subject_id, o_orderpriority AS method, avg(o_totalprice) AS value FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL"


def methods(spark, sf):
    """(subject_id, method, value): nations as subjects, order priorities as methods."""
    o, c = B.table(spark, sf, "orders"), B.table(spark, sf, "customer")
    return o.join(c, F.col("o_custkey") == F.col("c_custkey")).groupBy(F.col("c_nationkey").alias("subject_id"), F.col("o_orderpriority").alias("method")).agg(F.avg("o_totalprice").alias("value"))


ORDER = ["3-MEDIUM", "1-URGENT", "2-HIGH", "4-NOT SPECIFIED", "5-LOW"]


def q_pairwise(spark, sf):
    """Every two pipelines, the earlier first: a theta join of subject rows on equal subjects."""
    t = subject_table(spark, sf)
    a, b = t.select("subject_id", F.col("pipeline").alias("a"), F.col("accuracy").alias("v1")), t.select("subject_id", F.col("pipeline").alias("b"), F.col("accuracy").alias("v2"))
    return B.rounded(X.effect(a.join(b, "subject_id").filter("a < b"), ["a", "b"]).select("a", "b", "n", "mean_1", "mean_2", "mean_delta", "cohens_d"))


def q_wilcoxon(spark, sf):
    return B.rounded(X.wilcoxon(pairs(spark, sf)).select("n", "w_plus", "w_minus", "statistic"))


def q_spearman(spark, sf):
    m = B.pipeline_metrics(spark, sf)
    return B.rounded(L.rank_correlation(m.select("pipeline", F.col("accuracy").alias("s")), m.select("pipeline", F.col("latency_ms").alias("s")), "pipeline", "s"))


def q_props(spark, sf):
    e = B.table(spark, sf, "events").withColumn("m", F.from_json("props", "map<string,double>"))
    return L.metric_projection(e, "m", ["k", "absent"], "event_id")


def q_board(spark, sf):
    m = B.pipeline_metrics(spark, sf)
    kept = L.prune(m.select("pipeline"), m, 0.45, 300.0, 0.05)
    return L.leaderboard(m, "accuracy", 15, m.join(kept, "pipeline", "left_anti"), "pipe_7").select("rank", "pipeline", "accuracy", "latency_ms", "pruned", "selected")


def q_grid(spark, sf):
    names = B.table(spark, sf, "region").select("r_name")
    spatial = [None, "car"] if names.count() else [None]
    return L.pipeline_grid(spark, ["csp", "covariance", "psd", "riemann_tangent"], ["lda", "mdm", "logistic"], spatial, 20)


def q_families(spark, sf):
    """Parts as pipelines, their types deciding the family."""
    p = B.table(spark, sf, "part")
    name = F.when(F.col("p_size") % 4 == 0, F.concat(F.lit("csp_lda_"), F.col("p_partkey").cast("string"))).when(F.col("p_size") % 4 == 1, F.concat(F.lit("riemann_lr_"), F.col("p_partkey").cast("string"))).when(F.col("p_size") % 4 == 2, F.concat(F.lit("cov_mdm_"), F.col("p_partkey").cast("string"))).otherwise(F.concat(F.lit("psd_svm_"), F.col("p_partkey").cast("string")))
    m = p.select(name.alias("pipeline"), F.round(F.col("p_retailprice") / 10000.0, 9).alias("accuracy"), F.lit(None).cast("double").alias("cv_accuracy"), F.lit(False).alias("failed"))
    return L.best_per_family(m)


def q_feedback(spark, sf):
    l = B.table(spark, sf, "labels")  # noqa: E741
    return A.correction_accuracy(l, "toxic", "quality")


def q_acceptance(spark, sf):
    e = X.effect(methods(spark, sf).groupBy("subject_id").agg(F.max(F.when(F.col("method") == "1-URGENT", F.col("value"))).alias("v1"), F.max(F.when(F.col("method") == "5-LOW", F.col("value"))).alias("v2")).filter("v1 IS NOT NULL AND v2 IS NOT NULL"))
    return B.rounded(e.select("n", "mean_delta", "cohens_d", "t_stat"), 6)


def q_bootstrap_metric(spark, sf):
    """F1 and its interval: a component of each vector as score of odd labels."""
    f = B.features(spark, sf).select("trial_id", (F.col("label") % 2).alias("y"), (F.col("features")[0] + 0.5).alias("s"))
    return B.rounded(X.bootstrap_metric(f, "s", "y", "trial_id", "f1"))


def q_config_hash(spark, sf):
    r = B.table(spark, sf, "region")
    return r.select("r_regionkey", F.substring(F.sha2(F.concat_ws("|", F.col("r_regionkey").cast("string"), "r_name"), 256), 1, 16).alias("config_hash"), L.pipeline_name(F.col("r_name"), F.lit("lda")).alias("pipeline"))


COMP = "greatest(0.0::DOUBLE, 0.4 * cv_accuracy + 0.3 * kappa + 0.2 * stability - 0.1 * latency_ms / 1000.0 - 0.5 * greatest(0.0::DOUBLE, train_accuracy - cv_accuracy))"

QUERIES = {
    "subject_summary": lambda spark, sf: B.rounded(A.summary(subject_table(spark, sf), ["pipeline"], "accuracy")),
    "stability_report": lambda spark, sf: B.rounded(A.stability_report(B.table(spark, sf, "lineitem"), ["l_suppkey"], "l_quantity"), 6),
    "latency_stats": lambda spark, sf: B.rounded(A.latency_stats(B.table(spark, sf, "events"), ["event_type"], "value", 300.0), 6),
    "engine_latency": lambda spark, sf: B.rounded(A.engine_latency(B.table(spark, sf, "events"), "value"), 6),
    "ablation": lambda spark, sf: B.rounded(A.ablation(methods(spark, sf), "method", "subject_id", "value", "3-MEDIUM", ORDER), 5),
    "subject_counts": lambda spark, sf: A.subject_counts(B.features(spark, sf), "subject_id", "label"),
    "align_tables": lambda spark, sf: B.rounded(pairs(spark, sf)),
    "paired_t_stat": lambda spark, sf: B.rounded(X.effect(pairs(spark, sf)).select("n", "mean_1", "mean_2", "std_1", "std_2", "mean_delta", "std_delta", "t_stat")),
    "paired_t": lambda spark, sf: B.rounded(X.paired_t(pairs(spark, sf))),
    "cohens_d": lambda spark, sf: B.rounded(X.effect(pairs(spark, sf)).select("n", "cohens_d")),
    "wilcoxon_stat": q_wilcoxon,
    "permutation_exact": lambda spark, sf: B.rounded(X.permutation_exact(pairs(spark, sf), "subject_id")),
    "permutation_hashed": lambda spark, sf: B.rounded(X.permutation(pairs(spark, sf), "subject_id")),
    "bootstrap_ci": lambda spark, sf: B.rounded(X.bootstrap_ci(pairs(spark, sf), "subject_id")),
    "pairwise_compare": q_pairwise,
    "compare_tables": lambda spark, sf: X.compare(B.pipeline_metrics(spark, sf), B.pipeline_metrics(spark, sf).withColumn("accuracy", F.col("train_accuracy")), "pipeline", ["accuracy", "kappa"]),
    "bootstrap_metric": q_bootstrap_metric,
    "leaderboard": q_board,
    "top_n_composite": lambda spark, sf: B.rounded(L.top_n(B.pipeline_metrics(spark, sf), 10).select("pipeline", "score")),
    "best_pipeline": lambda spark, sf: L.best(B.pipeline_metrics(spark, sf)).select("pipeline", "accuracy"),
    "prune": lambda spark, sf: L.prune(B.pipeline_metrics(spark, sf).select("pipeline"), B.pipeline_metrics(spark, sf), 0.33, 256.0, 0.0007).select("pipeline"),
    "screening_top_k": lambda spark, sf: L.screened(B.pipeline_metrics(spark, sf), "kappa", L.screening_keep(16)).select("pipeline", "kappa"),
    "pipeline_grid": q_grid,
    "best_per_family": q_families,
    "rank_correlation": q_spearman,
    "condition_pairs": lambda spark, sf: L.condition_pairs(B.table(spark, sf, "nation"), "n_name"),
    "metric_projection": q_props,
    "correction_accuracy": q_feedback,
    "acceptance_effect": q_acceptance,
    "config_hash": q_config_hash,
}

ORACLES = {
    "subject_summary": f"{ACC} SELECT pipeline, count(accuracy) AS n, round(avg(accuracy), 9) AS mean, round(stddev_pop(accuracy), 9) AS std FROM acc GROUP BY 1",
    "stability_report": "SELECT l_suppkey, round(avg(l_quantity), 6) AS mean, round(stddev_pop(l_quantity), 6) AS std, round(var_pop(l_quantity), 6) AS var, round(stddev_pop(l_quantity) / avg(l_quantity), 6) AS cv FROM lineitem GROUP BY 1",
    "latency_stats": "SELECT event_type, count(value) AS n, round(avg(value), 6) AS mean, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.99), 6) AS p99, round(max(value), 6) AS max, quantile_cont(value, 0.95) > 300 OR avg(value) > 300 AS over_budget FROM events GROUP BY 1",
    "engine_latency": "SELECT round(avg(value), 6) AS mean, round(median(value), 6) AS median, round(max(value), 6) AS max, round(min(value), 6) AS min FROM events",
    "ablation": f"WITH m AS ({PRICE}), j AS (SELECT m.*, m.value - r.value AS d FROM m LEFT JOIN m r ON r.subject_id = m.subject_id AND r.method = '3-MEDIUM') SELECT list_position(['3-MEDIUM', '1-URGENT', '2-HIGH', '4-NOT SPECIFIED', '5-LOW'], method)::BIGINT AS pos, method, count(value) AS n, round(avg(value), 5) AS mean, round(stddev_samp(value), 5) AS std_sample, round(avg(d), 5) AS mean_delta, round(CASE WHEN stddev_pop(d) > 0 THEN avg(d) / stddev_pop(d) ELSE 0 END, 5) AS cohens_d FROM j GROUP BY method",
    "subject_counts": f"WITH {B.EMB} SELECT subject_id, label, count(*) AS n FROM emb GROUP BY ALL",
    "align_tables": f"{PAIRS} SELECT subject_id, round(v1, 9) AS v1, round(v2, 9) AS v2 FROM pr",
    "paired_t_stat": f"{EFFECT} SELECT n, {R(['mean_1', 'mean_2', 'std_1', 'std_2', 'mean_delta', 'std_delta'])}, round(mean_delta / (s / sqrt(n)), 9) AS t_stat FROM ef",
    "cohens_d": f"{EFFECT} SELECT n, round(mean_delta / std_delta, 9) AS cohens_d FROM ef",
    "wilcoxon_stat": f"{PAIRS}, q AS (SELECT *, abs(d) AS a FROM pr WHERE d <> 0), k AS (SELECT *, rank() OVER (ORDER BY a) + (count(*) OVER (PARTITION BY a) - 1) / 2.0::DOUBLE AS r FROM q), w AS (SELECT count(*) AS n, coalesce(sum(r) FILTER (d > 0), 0) AS w_plus, coalesce(sum(r) FILTER (d < 0), 0) AS w_minus FROM k) SELECT n, w_plus, w_minus, least(w_plus, w_minus) AS statistic FROM w",
    "permutation_exact": f"{PAIRS}, i AS (SELECT d, row_number() OVER (ORDER BY subject_id) - 1 AS k, count(*) OVER () AS n FROM pr), m AS (SELECT mask, abs(sum(CASE WHEN (mask >> k) & 1 = 1 THEN -d ELSE d END)) AS s, abs(sum(d)) AS o FROM i, range(512) t(mask) GROUP BY mask) SELECT CAST((SELECT max(n) FROM i) AS INTEGER) AS n, (SELECT round(avg(d), 9) FROM pr) AS observed, round(avg(CASE WHEN s >= o - 1e-12 THEN 1.0::DOUBLE ELSE 0 END), 9) AS p_value FROM m",
    "bootstrap_ci": f"{PAIRS}, i AS (SELECT d, row_number() OVER (ORDER BY subject_id) - 1 AS k, count(*) OVER () AS n FROM pr), b AS (SELECT rep, CAST('0x' || substr(md5('42:' || rep || ':' || k), 1, 7) AS BIGINT) % n AS pick FROM i, range(2000) t(rep)), g AS (SELECT rep, avg(i.d) AS m FROM b JOIN i ON i.k = b.pick GROUP BY 1) SELECT (SELECT max(n) FROM i) AS n, round(quantile_cont(m, 0.025), 9) + 0.0 AS ci_low, round(quantile_cont(m, 0.975), 9) + 0.0 AS ci_high FROM g",
    "permutation_hashed": f"{PAIRS}, m AS (SELECT p, abs(sum(CASE WHEN CAST('0x' || substr(md5('42:' || p || ':' || subject_id), 1, 1) AS INTEGER) % 2 = 0 THEN d ELSE -d END)) AS s FROM pr, range(10000) t(p) GROUP BY p) SELECT (SELECT count(*) FROM pr) AS n, round((count(*) FILTER (s >= (SELECT abs(sum(d)) FROM pr) - 1e-12) + 1.0::DOUBLE) / 10001, 9) AS p_value FROM m",
    "bootstrap_metric": f"WITH {B.EMB}, r AS (SELECT trial_id, label % 2 AS y, f[1] + 0.5 AS s FROM emb WHERE label IS NOT NULL), u AS (SELECT rep, y, s, CASE WHEN rep < 0 THEN 1 ELSE len(list_filter([{', '.join(f'{p!r}::DOUBLE' for p in X.POISSON)}], lambda p: p <= CAST('0x' || substr(md5('0:' || rep || ':' || trial_id), 1, 7) AS BIGINT) / 268435456.0::DOUBLE)) END AS w FROM r, range(-1, 1000) t(rep)), g AS (SELECT rep, sum(CASE WHEN s >= 0.5 THEN w * y END) AS tp, sum(CASE WHEN s >= 0.5 THEN w ELSE 0 END) AS p, sum(w * y) AS t FROM u GROUP BY 1), v AS (SELECT rep, 2.0::DOUBLE * coalesce(tp, 0) / nullif(p + t, 0) AS v FROM g) SELECT round(max(v) FILTER (rep < 0), 9) AS original_score, round(quantile_cont(v, 0.025) FILTER (rep >= 0), 9) AS ci_low, round(quantile_cont(v, 0.975) FILTER (rep >= 0), 9) AS ci_high FROM v",
    "compare_tables": f"""WITH {B.PIPES}, pr AS (SELECT pipeline, metric, CASE metric WHEN 'accuracy' THEN accuracy ELSE kappa END AS v1, CASE metric WHEN 'accuracy' THEN train_accuracy ELSE kappa END AS v2 FROM pm, (VALUES ('accuracy'), ('kappa')) t(metric)),
d AS (SELECT *, v2 - v1 AS d, row_number() OVER (PARTITION BY metric ORDER BY pipeline) - 1 AS i, count(*) OVER (PARTITION BY metric) AS n FROM pr),
e AS (SELECT metric, count(*) AS n, avg(v1) AS m1, avg(v2) AS m2, stddev_pop(v1) AS s1, stddev_pop(v2) AS s2, avg(d) AS md, stddev_pop(d) AS sd, abs(sum(d)) AS o FROM d GROUP BY 1),
s AS (SELECT metric, p, abs(sum(CASE WHEN CAST('0x' || substr(md5('42:' || p || ':' || pipeline), 1, 1) AS INTEGER) % 2 = 0 THEN d ELSE -d END)) AS s FROM d, range(10000) t(p) WHERE n > 20 GROUP BY ALL),
x AS (SELECT metric, p, abs(sum(CASE WHEN (p >> i) & 1 = 1 THEN -d ELSE d END)) AS s FROM d, range(1048576) t(p) WHERE n <= 20 AND p < (1 << n) GROUP BY ALL),
p AS (SELECT metric, (count(*) FILTER (s >= o - 1e-12) + 1.0::DOUBLE) / 10001 AS p FROM s JOIN e USING (metric) GROUP BY 1 UNION ALL SELECT metric, avg(CASE WHEN s >= o - 1e-12 THEN 1.0::DOUBLE ELSE 0 END) FROM x JOIN e USING (metric) GROUP BY 1),
b AS (SELECT metric, rep, avg(o.d) AS m FROM (SELECT metric, rep, CAST('0x' || substr(md5('42:' || rep || ':' || i), 1, 7) AS BIGINT) % n AS pick FROM d, range(2000) t(rep)) k JOIN d o USING (metric) WHERE o.i = k.pick GROUP BY ALL),
c AS (SELECT metric, quantile_cont(m, 0.025) AS lo, quantile_cont(m, 0.975) AS hi FROM b GROUP BY 1)
SELECT metric, 'Pipeline_A' AS name_1, 'Pipeline_B' AS name_2, 'permutation' AS test_used, n AS n_subjects, round(m1, 6) AS mean_1, round(m2, 6) AS mean_2, round(s1, 6) AS std_1, round(s2, 6) AS std_2, round(md, 6) AS mean_delta, round(sd, 6) AS std_delta,
round(md, 6) AS statistic, round(p, 6) AS p_value, round(CASE WHEN sd = 0 THEN 0 ELSE md / sd END, 6) AS cohens_d, round(lo, 6) AS ci_low, round(hi, 6) AS ci_high, p < 0.05 AS significant, CAST(NULL AS VARCHAR) AS error FROM e JOIN p USING (metric) JOIN c USING (metric)""",
    "pairwise_compare": f"{ACC} SELECT x.pipeline AS a, y.pipeline AS b, count(*) AS n, round(avg(x.accuracy), 9) AS mean_1, round(avg(y.accuracy), 9) AS mean_2, round(avg(y.accuracy - x.accuracy), 9) AS mean_delta, round(avg(y.accuracy - x.accuracy) / stddev_pop(y.accuracy - x.accuracy), 9) AS cohens_d FROM acc x JOIN acc y USING (subject_id) WHERE x.pipeline < y.pipeline GROUP BY ALL",
    "leaderboard": f"WITH {B.PIPES}, r AS (SELECT *, CAST(row_number() OVER (ORDER BY accuracy DESC, pipeline) AS INTEGER) AS rank FROM pm) SELECT rank, pipeline, accuracy, latency_ms, NOT (accuracy >= 0.45 AND latency_ms <= 300 AND 1 - stability <= 0.05) AS pruned, pipeline = 'pipe_7' AS selected FROM r WHERE rank <= 15",
    "top_n_composite": f"WITH {B.PIPES} SELECT pipeline, round({COMP}, 9) AS score FROM pm ORDER BY {COMP} DESC, latency_ms, pipeline LIMIT 10",
    "best_pipeline": f"WITH {B.PIPES} SELECT pipeline, accuracy FROM pm ORDER BY cv_accuracy DESC, pipeline LIMIT 1",
    "prune": f"WITH {B.PIPES} SELECT pipeline FROM pm WHERE accuracy >= 0.33 AND latency_ms <= 256 AND 1 - stability <= 0.0007",
    "screening_top_k": f"WITH {B.PIPES} SELECT pipeline, kappa FROM pm ORDER BY kappa DESC, pipeline LIMIT 8",
    "pipeline_grid": "WITH f AS (SELECT * FROM (VALUES (0, 'csp'), (1, 'covariance'), (2, 'psd'), (3, 'riemann_tangent')) t(i, feature)), c AS (SELECT * FROM (VALUES (0, 'lda'), (1, 'mdm'), (2, 'logistic')) t(j, classifier)), s AS (SELECT * FROM (VALUES (0, NULL), (1, 'car')) t(k, spatial)), p AS (SELECT * FROM (VALUES (0, 'csp', 'lda'), (1, 'riemann_tangent', 'logistic'), (2, 'covariance', 'mdm')) t(q, feature, classifier)), g AS (SELECT feature, classifier, spatial, CAST(row_number() OVER (ORDER BY coalesce(q, 1000), i, j, k) AS INTEGER) AS pos FROM f CROSS JOIN c CROSS JOIN s LEFT JOIN p USING (feature, classifier)) SELECT pos, concat_ws('_', 'baseline', spatial, feature, classifier) AS pipeline, feature, classifier, spatial FROM g WHERE pos <= 20",
    "best_per_family": "WITH m AS (SELECT CASE p_size % 4 WHEN 0 THEN 'csp_lda_' WHEN 1 THEN 'riemann_lr_' WHEN 2 THEN 'cov_mdm_' ELSE 'psd_svm_' END || p_partkey AS pipeline, CASE p_size % 4 WHEN 0 THEN 'csp' WHEN 1 THEN 'riemann' WHEN 2 THEN 'mdm' ELSE 'other' END AS family, round(p_retailprice / 10000.0, 9) AS accuracy FROM part) SELECT family, pipeline, accuracy FROM m QUALIFY row_number() OVER (PARTITION BY family ORDER BY accuracy DESC, pipeline) = 1",
    "rank_correlation": f"WITH {B.PIPES}, r AS (SELECT row_number() OVER (ORDER BY accuracy DESC, pipeline) AS a, row_number() OVER (ORDER BY latency_ms DESC, pipeline) AS b FROM pm) SELECT round(corr(a, b), 9) AS rank_correlation, count(*) AS n FROM r",
    "condition_pairs": "SELECT a.n_name AS a, b.n_name AS b FROM nation a JOIN nation b ON a.n_name < b.n_name",
    "metric_projection": "SELECT event_id, CAST(json_extract(props, '$.k') AS DOUBLE) AS k, CAST(NULL AS DOUBLE) AS absent FROM events",
    "correction_accuracy": "SELECT avg(CASE WHEN toxic = quality THEN 1.0::DOUBLE ELSE 0 END) AS correction_accuracy, count(*) AS n FROM labels WHERE quality IS NOT NULL",
    "acceptance_effect": f"WITH m AS ({PRICE}), p AS (SELECT a.subject_id, b.value - a.value AS d FROM m a JOIN m b USING (subject_id) WHERE a.method = '1-URGENT' AND b.method = '5-LOW') SELECT count(*) AS n, round(avg(d), 6) AS mean_delta, round(avg(d) / stddev_pop(d), 6) AS cohens_d, round(avg(d) / (stddev_samp(d) / sqrt(count(*))), 6) AS t_stat FROM p",
    "config_hash": "SELECT r_regionkey, substr(sha256(r_regionkey || '|' || r_name), 1, 16) AS config_hash, 'baseline_' || r_name || '_lda' AS pipeline FROM region",
}
