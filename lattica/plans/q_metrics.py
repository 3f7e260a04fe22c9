"""Metrics, splits and guards over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from lattica.functions import metrics as M
from lattica.operators import splits as S
from lattica.operators.classifiers import ensemble, nearest_centroid_folds
from lattica.plans import bindings as B

BY = ["pipeline", "subject_id"]


def q_nearest_centroid(spark, sf):
    p = nearest_centroid_folds(B.folded(spark, sf))
    out = p.groupBy("fold").agg(F.count("*").alias("n")).join(M.accuracy(p, ["fold"]), "fold").join(M.kappa(p, ["fold"]), "fold")
    return B.rounded(out)


FOLDS = B.EMB + f""", ranked AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY {B.hash_key(42, 'trial_id')}) AS r FROM emb),
folds AS (SELECT *, CAST((r - 1) % 5 AS INTEGER) AS fold FROM ranked)"""

O_NEAREST = f"""WITH {FOLDS}, long AS (SELECT trial_id, label, fold, i, f[i + 1] AS x FROM folds, range(64) t(i)),
s AS (SELECT fold, label, i, sum(x) AS s, count(*) AS k FROM long GROUP BY ALL),
m AS (SELECT h.fold, s.label, s.i, sum(s.s) / sum(s.k) AS m FROM (SELECT DISTINCT fold FROM folds) h JOIN s ON s.fold <> h.fold GROUP BY ALL),
d AS (SELECT l.trial_id, l.fold, l.label AS y_true, m.label AS cls, sum((l.x - m.m) * (l.x - m.m)) AS d FROM long l JOIN m ON m.fold = l.fold AND m.i = l.i GROUP BY ALL),
p AS (SELECT trial_id, fold, y_true, arg_min(cls, d) AS y_pred FROM d GROUP BY ALL),
c AS (SELECT fold, count(*) AS n, avg(CASE WHEN y_true = y_pred THEN 1.0::DOUBLE ELSE 0 END) AS accuracy FROM p GROUP BY fold),
e AS (SELECT a.fold, sum(CAST(a.k AS DOUBLE) * b.k) AS ch FROM (SELECT fold, y_true AS v, count(*) AS k FROM p GROUP BY ALL) a JOIN (SELECT fold, y_pred AS v, count(*) AS k FROM p GROUP BY ALL) b USING (fold, v) GROUP BY a.fold)
SELECT c.fold, c.n, round(accuracy, 9) AS accuracy, round((accuracy - coalesce(ch, 0) / (n * n)) / (1 - coalesce(ch, 0) / (n * n)), 9) AS kappa FROM c LEFT JOIN e USING (fold)"""

PC = f"""WITH {B.PRED}, cls AS (SELECT pipeline, subject_id, v, sum(tp) AS tp, sum(fp) AS fp, sum(fn) AS fn FROM (
  SELECT pipeline, subject_id, y_true AS v, CASE WHEN y_true = y_pred THEN 1 ELSE 0 END AS tp, 0 AS fp, CASE WHEN y_true <> y_pred THEN 1 ELSE 0 END AS fn FROM pred
  UNION ALL SELECT pipeline, subject_id, y_pred, 0, CASE WHEN y_true <> y_pred THEN 1 ELSE 0 END, 0 FROM pred) GROUP BY ALL)"""
ACC = "acc AS (SELECT pipeline, subject_id, avg(CASE WHEN y_true = y_pred THEN 1.0::DOUBLE ELSE 0 END) AS accuracy FROM pred GROUP BY ALL)"
KAPPA = "kap AS (SELECT pipeline, subject_id, (sum(tp) / sum(tp + fn) - sum(CAST(tp + fn AS DOUBLE) * (tp + fp)) / (sum(tp + fn) * sum(tp + fn))) / (1 - sum(CAST(tp + fn AS DOUBLE) * (tp + fp)) / (sum(tp + fn) * sum(tp + fn))) AS kappa FROM cls GROUP BY ALL)"
F1 = "f1 AS (SELECT pipeline, subject_id, avg(coalesce(2.0::DOUBLE * tp / nullif(2 * tp + fp + fn, 0), 0)) AS f1_macro FROM cls GROUP BY ALL)"
BAL = "bal AS (SELECT pipeline, subject_id, avg(CAST(tp AS DOUBLE) / (tp + fn)) AS balanced_accuracy FROM cls WHERE tp + fn > 0 GROUP BY ALL)"
AUC = """sc AS (SELECT pipeline, subject_id, k AS cls, proba[k + 1] AS s, CASE WHEN y_true = k THEN 1 ELSE 0 END AS pos FROM pred, range(10) t(k)),
rk AS (SELECT *, rank() OVER (PARTITION BY pipeline, subject_id, cls ORDER BY s) + (count(*) OVER (PARTITION BY pipeline, subject_id, cls, s) - 1) / 2.0::DOUBLE AS r FROM sc),
auc0 AS (SELECT pipeline, subject_id, cls, sum(pos) AS m, count(*) - sum(pos) AS n, sum(CASE WHEN pos = 1 THEN r END) AS rs FROM rk GROUP BY ALL),
auc AS (SELECT pipeline, subject_id, coalesce(avg(CASE WHEN m > 0 AND n > 0 THEN (rs - m * (m + 1) / 2.0::DOUBLE) / (CAST(m AS DOUBLE) * n) END), 0) AS roc_auc_macro FROM auc0 GROUP BY ALL)"""
MI = """jc AS (SELECT pipeline, subject_id, y_true, y_pred, CAST(count(*) AS DOUBLE) AS n FROM pred GROUP BY ALL),
jw AS (SELECT *, sum(n) OVER (PARTITION BY pipeline, subject_id, y_true) AS nx, sum(n) OVER (PARTITION BY pipeline, subject_id, y_pred) AS ny, sum(n) OVER (PARTITION BY pipeline, subject_id) AS t FROM jc),
mi AS (SELECT pipeline, subject_id, sum(n / t * ln(n * t / (nx * ny))) AS mutual_information FROM jw GROUP BY ALL)"""
ITR = "CASE WHEN accuracy <= 0 THEN 0.0::DOUBLE WHEN accuracy >= 1 THEN log2(10.0::DOUBLE) ELSE log2(10.0::DOUBLE) + accuracy * log2(accuracy) + (1 - accuracy) * log2((1 - accuracy) / 9.0::DOUBLE) END"


def _simple(f):
    return lambda spark, sf: B.rounded(f(B.predictions(spark, sf), BY))


def q_itr(spark, sf):
    a = M.accuracy(B.predictions(spark, sf), BY)
    return B.rounded(a.select(*BY, M.itr_bits_per_trial(F.col("accuracy"), 10).alias("itr_bits_per_trial"), M.itr_bits_per_minute(F.col("accuracy"), 10, 3.0).alias("itr_bits_per_minute")))


def q_confusion_matrix(spark, sf):
    return M.confusion_matrix(B.predictions(spark, sf).filter("pipeline = 'p0'"), list(range(10)))


def q_trial_split(spark, sf):
    return S.trial_split(B.features(spark, sf).select("trial_id"), "trial_id", 0.8)


def q_sequential(spark, sf):
    return S.sequential_split(B.features(spark, sf).select("subject_id", "trial_id"), "trial_id", 20, by=["subject_id"])


def q_first_n(spark, sf):
    return S.first_n(B.features(spark, sf).select("trial_id", "label"), "trial_id", 80)


def q_kfold(spark, sf):
    return S.kfold(B.table(spark, sf, "documents").select(F.col("doc_id").alias("trial_id")), "trial_id", 7)


def q_stratified(spark, sf):
    return B.folded(spark, sf).select("trial_id", "label", "fold")


def q_stratified_split(spark, sf):
    return S.stratified_split(B.features(spark, sf).select("trial_id", "label"), "trial_id", "label", 0.3)


def q_loso(spark, sf):
    return S.loso_folds(B.features(spark, sf), "subject_id")


def q_group_kfold(spark, sf):
    """Greedy folds joined back to trials; subjects never straddle folds."""
    f = B.features(spark, sf).select("trial_id", "subject_id")
    g = S.group_kfold(f, "subject_id", 5)
    return f.join(g.select("subject_id", "fold"), "subject_id").groupBy("fold").agg(F.count("*").alias("n"), F.countDistinct("subject_id").alias("n_subjects"))


def q_guard(spark, sf):
    f = B.features(spark, sf).select("trial_id", "subject_id")
    s = S.loso_holdout(f, "subject_id", 3)
    return S.guard_report(s, "trial_id", "subject_id", "trial_id")


def q_overlap(spark, sf):
    f = B.features(spark, sf).select("trial_id")
    return S.overlap(f.filter("trial_id % 3 = 0"), f.filter("trial_id % 5 = 0"), "trial_id")


def q_complement(spark, sf):
    o = B.table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    return S.complement(o, B.table(spark, sf, "customer").filter("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey")), "o_custkey")


def q_balance(spark, sf):
    return S.class_balance(B.features(spark, sf), "label")


def q_cross_session(spark, sf):
    f = B.features(spark, sf).select("trial_id", (F.col("trial_id") % 3).alias("session"))
    return S.cross_session(f, "session", 0, 1)


def q_ensemble(spark, sf):
    e = ensemble(B.predictions(spark, sf), ["trial_id", "y_true"])
    return e.select("trial_id", "y_true", "y_pred", F.round(F.array_max("proba"), 9).alias("top"))


def q_delong(spark, sf):
    from lattica.functions.stats import delong

    f = B.features(spark, sf).select((F.col("label") % 2).cast("int").alias("y"), F.col("features")[0].alias("a"), F.col("features")[1].alias("b"))
    d = delong(f, [], "a", "b", "y")
    return B.rounded(d.select("auc_1", "auc_2", "z"), 6)


def _acc_sql(extra: str, cols: str, name: str) -> str:
    return f"{PC}, {extra} SELECT pipeline, subject_id, {cols} FROM {name}"


QUERIES = {
    "nearest_centroid": q_nearest_centroid,
    "accuracy": _simple(M.accuracy),
    "confusion": lambda spark, sf: M.confusion(B.predictions(spark, sf), ["pipeline"]),
    "confusion_matrix": q_confusion_matrix,
    "kappa": _simple(M.kappa),
    "f1_macro": _simple(M.f1_macro),
    "balanced_accuracy": _simple(M.balanced_accuracy),
    "auc_ovr": _simple(M.roc_auc_macro),
    "itr": q_itr,
    "mutual_information": _simple(lambda p, by: M.mutual_information(p, by, "y_true", "y_pred")),
    "all_metrics": _simple(lambda p, by: M.all_metrics(p, by, 10, 3.0)),
    "confidence": _simple(M.confidence),
    "trial_split": q_trial_split,
    "sequential_split": q_sequential,
    "first_n": q_first_n,
    "kfold": q_kfold,
    "stratified_kfold": q_stratified,
    "stratified_split": q_stratified_split,
    "loso_folds": q_loso,
    "group_kfold": q_group_kfold,
    "leakage_guard": q_guard,
    "leakage_overlap": q_overlap,
    "holdout_complement": q_complement,
    "class_balance": q_balance,
    "cross_session": q_cross_session,
    "ensemble": q_ensemble,
    "delong": q_delong,
}

ORACLES = {
    "nearest_centroid": O_NEAREST,
    "accuracy": f"WITH {B.PRED}, {ACC} SELECT pipeline, subject_id, round(accuracy, 9) AS accuracy FROM acc",
    "confusion": f"WITH {B.PRED} SELECT pipeline, y_true, y_pred, count(*) AS n FROM pred GROUP BY ALL",
    "confusion_matrix": f"WITH {B.PRED} SELECT y_true, " + ", ".join(f'CAST(sum(CASE WHEN y_pred = {k} THEN 1 ELSE 0 END) AS BIGINT) AS "{k}"' for k in range(10)) + " FROM pred WHERE pipeline = 'p0' GROUP BY y_true",
    "kappa": _acc_sql(KAPPA, "round(kappa, 9) AS kappa", "kap"),
    "f1_macro": _acc_sql(F1, "round(f1_macro, 9) AS f1_macro", "f1"),
    "balanced_accuracy": _acc_sql(BAL, "round(balanced_accuracy, 9) AS balanced_accuracy", "bal"),
    "auc_ovr": _acc_sql(AUC, "round(roc_auc_macro, 9) AS roc_auc_macro", "auc"),
    "itr": f"WITH {B.PRED}, {ACC} SELECT pipeline, subject_id, round({ITR}, 9) AS itr_bits_per_trial, round(({ITR}) * 20.0::DOUBLE, 9) AS itr_bits_per_minute FROM acc",
    "mutual_information": _acc_sql(MI, "round(mutual_information, 9) AS mutual_information", "mi"),
    "all_metrics": f"{PC}, {ACC}, {KAPPA}, {F1}, {BAL}, {AUC}, {MI} SELECT pipeline, subject_id, round(accuracy, 9) AS accuracy, round({ITR}, 9) AS itr_bits_per_trial, round(({ITR}) * 20.0::DOUBLE, 9) AS itr_bits_per_minute, round(kappa, 9) AS kappa, round(f1_macro, 9) AS f1_macro, round(balanced_accuracy, 9) AS balanced_accuracy, round(roc_auc_macro, 9) AS roc_auc_macro, round(mutual_information, 9) AS mutual_information FROM acc JOIN kap USING (pipeline, subject_id) JOIN f1 USING (pipeline, subject_id) JOIN bal USING (pipeline, subject_id) JOIN auc USING (pipeline, subject_id) JOIN mi USING (pipeline, subject_id)",
    "confidence": f"WITH {B.PRED} SELECT pipeline, subject_id, round(avg(list_max(proba)), 9) AS confidence FROM pred GROUP BY ALL",
    "trial_split": f"WITH {B.EMB}, r AS (SELECT trial_id, row_number() OVER (ORDER BY {B.hash_key(42, 'trial_id')}) AS r, count(*) OVER () AS n FROM emb) SELECT trial_id, CASE WHEN r <= greatest(1, least(CAST(floor(n * 0.8) AS BIGINT), n - 1)) THEN 'train' ELSE 'test' END AS role FROM r",
    "sequential_split": f"WITH {B.EMB} SELECT subject_id, trial_id, CASE WHEN row_number() OVER (PARTITION BY subject_id ORDER BY trial_id) <= 20 THEN 'calibrate' ELSE 'test' END AS role FROM emb",
    "first_n": f"WITH {B.EMB} SELECT trial_id, label FROM emb ORDER BY trial_id LIMIT 80",
    "kfold": f"SELECT doc_id AS trial_id, CAST(ntile(7) OVER (ORDER BY {B.hash_key(42, 'doc_id')}) - 1 AS INTEGER) AS fold FROM documents",
    "stratified_kfold": f"WITH {FOLDS} SELECT trial_id, label, fold FROM folds",
    "stratified_split": f"WITH {B.EMB}, r AS (SELECT trial_id, label, row_number() OVER (PARTITION BY label ORDER BY {B.hash_key(42, 'trial_id')}) AS r, count(*) OVER (PARTITION BY label) AS n FROM emb) SELECT trial_id, label, CASE WHEN r <= floor(n * 0.3) THEN 'cal' ELSE 'test' END AS role FROM r",
    "loso_folds": f"WITH {B.EMB}, s AS (SELECT subject_id, count(*) AS n FROM emb GROUP BY 1) SELECT a.subject_id AS holdout, b.subject_id, CASE WHEN a.subject_id = b.subject_id THEN 'test' ELSE 'train' END AS role, b.n FROM s a, s b",
    "leakage_guard": f"WITH {B.EMB}, s AS (SELECT *, CASE WHEN subject_id = 3 THEN 'test' ELSE 'train' END AS role FROM emb) SELECT CAST(0 AS BIGINT) AS ids_in_both, (SELECT count(*) FROM (SELECT subject_id FROM s GROUP BY 1 HAVING count(DISTINCT role) > 1)) AS subjects_in_both, count(*) FILTER (role = 'train') AS n_train, count(*) FILTER (role = 'test') AS n_test, count(*) AS n_total, coalesce(max(trial_id) FILTER (role = 'train') < min(trial_id) FILTER (role = 'test'), true) AS in_order, count(*) FILTER (role = 'test') > 0 AND count(*) FILTER (role = 'train') >= count(*) AS fits_all FROM s",
    "leakage_overlap": f"WITH {B.EMB} SELECT trial_id FROM emb WHERE trial_id % 3 = 0 INTERSECT SELECT trial_id FROM emb WHERE trial_id % 5 = 0",
    "holdout_complement": "SELECT o_custkey, o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')",
    "class_balance": f"WITH {B.EMB}, c AS (SELECT label, count(*) AS n FROM emb GROUP BY 1) SELECT count(*) AS n_classes, min(n) AS smallest, max(n) AS largest, max(n) <= min(n) * 2.0 AS balanced FROM c",
    "cross_session": f"WITH {B.EMB} SELECT trial_id, trial_id % 3 AS session, CASE WHEN trial_id % 3 = 0 THEN 'source' ELSE 'target' END AS role FROM emb WHERE trial_id % 3 IN (0, 1)",
    "ensemble": f"WITH {B.PRED}, l AS (SELECT trial_id, y_true, k, avg(proba[k + 1]) AS p FROM pred, range(10) t(k) GROUP BY ALL), g AS (SELECT trial_id, y_true, list(p ORDER BY k) AS ps FROM l GROUP BY ALL) SELECT trial_id, y_true, CAST(list_position(ps, list_max(ps)) - 1 AS INTEGER) AS y_pred, round(list_max(ps), 9) AS top FROM g",
    "delong": f"WITH {B.EMB}, d AS (SELECT trial_id, label % 2 AS y, f[1] AS a, f[2] AS b FROM emb), v AS (SELECT p.trial_id, 1 AS side, avg(CASE WHEN p.a > q.a THEN 1.0::DOUBLE WHEN p.a = q.a THEN 0.5::DOUBLE ELSE 0 END) AS va, avg(CASE WHEN p.b > q.b THEN 1.0::DOUBLE WHEN p.b = q.b THEN 0.5::DOUBLE ELSE 0 END) AS vb FROM d p, d q WHERE p.y = 1 AND q.y = 0 GROUP BY 1 UNION ALL SELECT q.trial_id, 0, avg(CASE WHEN p.a > q.a THEN 1.0::DOUBLE WHEN p.a = q.a THEN 0.5::DOUBLE ELSE 0 END), avg(CASE WHEN p.b > q.b THEN 1.0::DOUBLE WHEN p.b = q.b THEN 0.5::DOUBLE ELSE 0 END) FROM d p, d q WHERE p.y = 1 AND q.y = 0 GROUP BY 1) SELECT round(avg(va) FILTER (side = 1), 6) AS auc_1, round(avg(vb) FILTER (side = 1), 6) AS auc_2, round((avg(va) FILTER (side = 1) - avg(vb) FILTER (side = 1)) / sqrt(var_samp(va - vb) FILTER (side = 1) / count(*) FILTER (side = 1) + var_samp(va - vb) FILTER (side = 0) / count(*) FILTER (side = 0)), 6) AS z FROM v",
}
