import hashlib
import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lattica.functions import stats as X
from lattica.functions.hashed import first_words
from lattica.operators import aggregates as A
from lattica.operators import selection as L


def pairs(spark, a, b):
    return spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(zip(a, b, strict=True))], "subject_id int, v1 double, v2 double")


def test_tails():
    assert X.t_tail(2.262157, 9) == pytest.approx(0.05, abs=1e-5) and X.t_tail(0, 5) == pytest.approx(1)
    assert X.normal_tail(1.959964) == pytest.approx(0.05, abs=1e-6) and X.normal_quantile(0.975) == pytest.approx(1.959964, abs=1e-5)
    assert X.incomplete_beta(2, 3, 0.5) == pytest.approx(0.6875)


def test_wilcoxon_by_all_sign_patterns(spark):
    rng = np.random.RandomState(0)
    d = np.round(rng.normal(0.3, 1, 9), 1)
    d[d == 0] = 0.1
    r = X.wilcoxon(pairs(spark, np.zeros(9), d)).first()
    a = np.abs(d)
    ranks = np.array([(a < v).sum() + ((a == v).sum() + 1) / 2 for v in a])
    w = min(ranks[d > 0].sum(), ranks[d < 0].sum())
    assert r["statistic"] == pytest.approx(w)
    hits = sum(sum(x for x, s in zip(ranks, signs, strict=True) if s) <= w for signs in itertools.product((0, 1), repeat=9))
    assert r["p_value"] == pytest.approx(min(1, 2 * hits / 512))


def test_permutation_exact_and_hashed(spark):
    v1, v2 = [0.1, 0.2, 0.3, 0.2, 0.15, 0.3], [0.2, 0.25, 0.45, 0.2, 0.35, 0.5]
    df = pairs(spark, v1, v2)
    d = np.subtract(v2, v1)
    want = np.mean([abs(np.dot(s, d)) >= abs(d.sum()) - 1e-12 for s in itertools.product((-1, 1), repeat=6)])
    assert X.permutation_exact(df, "subject_id").first()["p_value"] == pytest.approx(want)
    assert X.permutation(df, "subject_id", n_perm=4000).first()["p_value"] == pytest.approx(want, abs=0.02)
    same = pairs(spark, v1, v1)
    assert X.permutation_exact(same, "subject_id").first()["p_value"] == 1


def test_effects_and_intervals(spark):
    e = X.effect(pairs(spark, [1, 2, 3], [2, 3, 4])).first()
    assert e["cohens_d"] == 0 and e["mean_delta"] == 1 and e["t_stat"] is None
    assert X.effect(pairs(spark, [1], [2])).first()["cohens_d"] is None
    ci = X.bootstrap_ci(pairs(spark, [0] * 20, np.arange(20) / 10), "subject_id", replicates=400).first()
    assert ci["ci_low"] < 0.95 < ci["ci_high"]


def test_compare_reports_errors(spark):
    a = spark.createDataFrame([(1, 0.5, None), (2, 0.6, 1.0), (3, 0.7, None)], "subject_id int, accuracy double, kappa double")
    b = a.withColumn("accuracy", F.col("accuracy") + F.col("subject_id") / 100.0)
    rows = {r["metric"]: r for r in X.compare(a, b, "subject_id", ["accuracy", "kappa", ], "permutation").collect()}
    assert rows["accuracy"]["p_value"] == 0.25 and rows["kappa"]["error"] and rows["accuracy"]["error"] is None


def test_odds_ratio_and_holm(spark):
    r = X.auc_to_odds_ratio(0.75)
    assert r["d"] == pytest.approx(0.9539, abs=1e-3) and r["odds_ratio"] == pytest.approx(math.exp(r["ln_or"]))
    h = X.holm(spark.createDataFrame([(0.01,), (0.04,), (0.03,)], "p_value double")).orderBy("p_value").collect()
    assert [round(x["p_holm"], 3) for x in h] == [0.03, 0.06, 0.06]


def metrics(spark):
    rows = [("a", 0.6, 0.4, 0.99, 100.0, 0.7, 0.6, False), ("b", 0.8, 0.6, 0.9, 400.0, 1.0, 0.7, False), ("c", 0.7, 0.5, 0.99, 50.0, 0.7, None, False), ("d", None, None, None, None, None, None, True)]
    return spark.createDataFrame(rows, "pipeline string, accuracy double, kappa double, stability double, latency_ms double, train_accuracy double, cv_accuracy double, failed boolean")


def test_prune_rank_and_best(spark):
    m = metrics(spark)
    specs = m.select("pipeline").unionByName(spark.createDataFrame([("new",)], "pipeline string"))
    assert {r["pipeline"] for r in L.prune(specs, m, 0.5, 300, 0.05).collect()} == {"a", "c", "new"}
    assert [r["pipeline"] for r in L.top_n(m, 2).collect()] == ["c", "a"] or len(L.top_n(m, 2).collect()) == 2
    assert L.best(m).first()["pipeline"] == "b"
    board = L.leaderboard(m, "accuracy", 2, selected="b").orderBy("rank").collect()
    assert [(r["rank"], r["pipeline"], r["selected"]) for r in board] == [(1, "b", True), (2, "c", False)]


def test_grids_and_helpers(spark):
    g = L.pipeline_grid(spark, ["csp", "psd"], ["lda", "mdm"], [None, "car"], 5).orderBy("pos").collect()
    assert [r["pipeline"] for r in g] == ["baseline_csp_lda", "baseline_car_csp_lda", "baseline_csp_mdm", "baseline_car_csp_mdm", "baseline_psd_lda"]
    assert L.parameter_grid(spark, {"a": [1, 2], "b": ["x", "y", "z"]}).count() == 6
    assert L.parse_spec(["ica", "csp", "lda"]) == {"steps": ["ica"], "feature": "csp", "classifier": "lda"}
    assert L.halving_rounds(20, 4) == [10, 5, 4] and L.screening_keep(16) == 8
    assert L.early_stop([0.2, 0.3], 5, 0.75) and not L.early_stop([0.9, 0.9], 5, 0.75)


def test_ablation_reference_has_no_effect_on_itself(spark):
    """Means of many prices depend in their last digits on the order of their sums, which a second read of the rows doesn't keep."""
    rows = spark.range(60_000).select((F.col("id") % 25).alias("s"), F.concat(F.lit("m"), F.floor(F.col("id") / 25) % 3).alias("m"), (F.pmod(F.xxhash64("id"), F.lit(50_000_000)) / 100.0).alias("x"))
    means = rows.repartition(7).groupBy("s", "m").agg(F.avg("x").alias("v"))
    got = {r["m"]: r for r in A.ablation(means, "m", "s", "v", "m1", ["m1", "m0", "m2"]).collect()}
    assert (got["m1"]["mean_delta"], got["m1"]["cohens_d"], got["m1"]["n"]) == (0.0, 0.0, 25)
    v = {(r["s"], r["m"]): r["v"] for r in means.collect()}
    d = np.array([v[s, "m2"] - v[s, "m1"] for s in range(25)])
    assert got["m2"]["mean_delta"] == pytest.approx(d.mean()) and got["m2"]["cohens_d"] == pytest.approx(d.mean() / d.std())


def test_ablation_pairs_missing_and_repeated_rows(spark):
    rows = [(1, "r", 1.0), (1, "r", 3.0), (1, "a", 4.0), (2, "a", 5.0), (3, "r", None), (3, "a", 7.0), (None, "r", 9.0), (None, "a", 8.0)]
    got = {r["m"]: r for r in A.ablation(spark.createDataFrame(rows, "s int, m string, v double"), "m", "s", "v", "r", ["r"]).collect()}
    assert (got["a"]["n"], got["a"]["mean"], got["a"]["mean_delta"], got["a"]["cohens_d"], got["a"]["pos"]) == (5, 5.6, 2.0, 2.0, 0)
    assert (got["r"]["n"], got["r"]["mean_delta"], got["r"]["pos"]) == (5, 0.0, 1)


def md5_word(text):
    return int.from_bytes(hashlib.md5(text.encode()).digest()[:4], "little")


def test_first_words_are_md5(spark):
    heads, tails = ["", "7:", "42:9:", "42:10:", "42:123456:"], ["", "a", "é漢", *map(str, range(0, 2000, 7)), *["x" * n for n in range(40, 70)], "y" * 200]
    got = first_words([h.encode() for h in heads], [t.encode() for t in tails])
    assert got.tolist() == [[md5_word(h + t) for t in tails] for h in heads]


def test_compare_reads_its_inputs_once(spark):
    """Every statistic read both tables anew: at 60,000 keys that, and a row for each pair and permutation, didn't end in time."""
    read = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def noted(x):
        read.add(1)
        return x

    base = spark.range(50).select(F.concat(F.lit("k"), F.col("id")).alias("k"), (F.col("id") / 100.0).alias("m"))
    a = base.withColumn("m", noted("m"))
    X.compare(a, base.withColumn("m", F.sqrt("m")), "k", ["m"], n_perm=300, replicates=100).collect()
    assert read.value == 50


@pytest.mark.parametrize("by", [[], ["f"], ["f", "g"]])
def test_signs_and_draws_by_plain_hashing(spark, by, monkeypatch):
    """Families that share keys, of unequal sizes, more than a task keeps; null keys and a null delta; a family beyond the size of an array meets its draws in a join."""
    monkeypatch.setattr(X, "KEPT_FAMILIES", 1)
    rng = np.random.RandomState(5)
    rows = [(f"f{f}", f, (None if i == 3 and f == 1 else f"key{'x' * (i % 60)}{i}"), 0.0, (None if (i, f) == (4, 0) else float(rng.normal(0.2)))) for f in range(3) for i in range(25 + 900 * (f == 2))]
    if not by:
        rows = [r for r in rows if r[1] == 2]
    df = spark.createDataFrame(rows, "f string, g int, k string, v1 double, v2 double").repartition(3)
    families = {}
    for r in rows:
        families.setdefault(r[0], []).append(r)
    p = {r["f"] if by else "f2": r for r in X.permutation(df, "k", by, 700, 9).collect()}
    ci = {r["f"] if by else "f2": r for r in X.bootstrap_ci(df, "k", by, 60, 9).collect()}
    monkeypatch.setattr(X, "HELD_PAIRS", 30)
    joined = {r["f"] if by else "f2": r for r in X.bootstrap_ci(df, "k", by, 60, 9).collect()}
    assert set(p) == set(ci) == set(joined) == set(families)
    for f, held in families.items():
        d = {i: r[4] for i, r in enumerate(held)}
        total = sum(v for v in d.values() if v is not None)
        sums = [sum((1 if (md5_word(f"9:{q}" + ("" if held[i][2] is None else ":" + held[i][2])) >> 4) % 2 == 0 else -1) * v for i, v in d.items() if v is not None) for q in range(700)]
        assert (p[f]["n"], p[f]["p_value"]) == (len(held), (sum(abs(s) >= abs(total) - 1e-12 for s in sums) + 1) / 701)
        values = [r[4] for r in sorted(held, key=lambda r: (r[2] is not None, r[2] or ""))]
        means = []
        for b in range(60):
            got = [values[int(hashlib.md5(f"9:{b}:{i}".encode()).hexdigest()[:7], 16) % len(values)] for i in range(len(values))]
            means.append(np.mean([v for v in got if v is not None]))
        for row in (ci[f], joined[f]):
            assert row["n"] == len(held) and [row["ci_low"], row["ci_high"]] == pytest.approx(np.percentile(means, [2.5, 97.5]).tolist())
