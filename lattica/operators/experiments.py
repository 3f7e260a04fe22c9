"""Pipelines of preprocessing, features, adapter and classifier; their evaluation over folds and subjects; calibration and choice.

The loops here run over specs and holdouts, which are few; every fit and every prediction inside is a distributed pass over the trials.
"""

from __future__ import annotations

import time
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field, replace
from itertools import product

import numpy as np
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.functions import linalg
from lattica.functions import metrics as M
from lattica.functions import ranks
from lattica.functions.ranks import seeded
from lattica.operators import adapters, classifiers, features, held_out, kernels, selection, splits
from lattica.operators.kernels import gathered
from lattica.session import shared_path


@dataclass(frozen=True)
class Spec:
    """What a pipeline is made of; options by part."""

    feature: str
    classifier: str
    adapter: str = "none"
    fs: float = 250.0
    steps: tuple = ()
    options: dict = field(default_factory=dict)

    @property
    def name(self) -> str:
        return "_".join(["baseline", *self.steps, self.feature, self.classifier])


#: Named presets.
PRESETS = {
    "csp_lda": Spec("csp", "lda"), "riemann_mdm": Spec("covariance", "mdm"), "tangent_lr": Spec("riemann_tangent", "logistic"), "filter_bank_lr": Spec("filter_bank_riemann", "logistic"), "ea_tangent_lr": Spec("ea_tangent", "logistic"),
    "rsa_lr": Spec("filter_bank_riemann", "logistic", options={"feature": {"rsa": True}}),
}


class Pipeline:
    """Fitted parts; ``predict`` replays the same chain."""

    def __init__(self, spec: Spec):
        self.spec, self.feature, self.adapter, self.model, self.align = spec, None, None, None, None

    def _prepared(self, trials: DataFrame, online: bool = False) -> DataFrame:
        if not self.spec.steps:
            return trials
        return kernels.mapped(trials, kernels.chain(self.spec.fs, [(s, {}) for s in self.spec.steps if s in kernels.STEPS], online=online))

    def _features(self, trials: DataFrame) -> DataFrame:
        if self.align is not None:
            trials = self.align.transform(trials)
        return self.feature.transform(trials) if hasattr(self.feature, "transform") else kernels.extracted(trials, self.feature)

    def fit(self, trials: DataFrame, target: DataFrame | None = None) -> Pipeline:
        """target: unlabelled trials of the domain to be predicted, for adapters; an adapter without one is an error."""
        spec, t = self.spec, self._prepared(trials)
        kind = "riemann_tangent" if spec.feature == "ea_tangent" else spec.feature
        if spec.feature == "ea_tangent":
            self.align = features.EuclideanAlignment.fit(t)
            t = self.align.transform(t)
        if kind not in features.FEATURES:
            raise ValueError(f"no feature {kind!r}")
        made = features.FEATURES[kind]
        if hasattr(made, "fit"):
            self.feature = made.fit(t, spec.fs, **spec.options.get("feature", {})) if kind == "filter_bank_riemann" else made.fit(t, **spec.options.get("feature", {}))
        else:
            self.feature = made(spec.fs) if kind in ("psd", "band_powers", "temporal") else made()
        x = self.feature.transform(t) if hasattr(self.feature, "transform") else kernels.extracted(t, self.feature)
        if spec.adapter != "none":
            if target is None:
                raise ValueError("an adapter needs trials of the target domain")
            self.adapter = adapters.ADAPTERS[spec.adapter].fit(x, self._features(self._prepared(target)))
            x = self.adapter.transform(x)
        self.model = classifiers.fitted(spec.classifier, x, **spec.options.get("classifier", {}))
        return self

    def predict(self, trials: DataFrame, online: bool = False) -> DataFrame:
        """The trials' columns without the signal, y_pred and proba."""
        return self.model.transform(self._features(self._prepared(trials, online))).drop("features")


#: Fits of a leave-one-out loop that are submitted together: each is a few short jobs.
FITS_AT_ONCE = 4


def loso(trials: DataFrame, specs: list[Spec], subject: str = "subject_id", label: str = "label") -> DataFrame:
    """(pipeline, holdout, trial_id, y_true, y_pred, proba) for every spec and every subject held out. All source rows are fitted on, those without a subject among them; these are never held out.

    Specs whose fits are made of sums (``held_out.plan``) share a fixed number of passes, whatever the number of subjects. Each fold of the others is fitted by itself and its
    predictions are written, so the result's plan is a scan, however many folds there are."""
    spark = trials.sparkSession
    summed = [s for s in specs if held_out.plan(s)]
    others = [s for s in specs if not held_out.plan(s)]
    out = held_out.predictions(trials, summed, subject, label) if summed else None
    if not others:
        return out
    subjects = [r[0] for r in trials.filter(F.col(subject).isNotNull()).select(subject).distinct().orderBy(subject).collect()]

    def fold(at):
        spec, s = at
        train, test = trials.filter((F.col(subject) != s) | F.col(subject).isNull()), trials.filter(F.col(subject) == s)
        p = Pipeline(spec).fit(train, test).predict(test)
        p = p.select(F.lit(spec.name).alias("pipeline"), F.col(subject).alias("holdout"), "trial_id", F.col(label).alias("y_true"), F.col("y_pred").cast("int").alias("y_pred"), "proba")
        path = shared_path(spark, "fold")
        p.write.parquet(path)
        return path, p.schema

    with ThreadPoolExecutor(FITS_AT_ONCE) as pool:
        written = list(pool.map(fold, list(product(others, subjects))))
    fits = spark.read.schema(written[0][1]).parquet(*[path for path, _ in written]) if written else None
    return out if fits is None else fits if out is None else out.unionByName(fits)


def subject_table(predictions: DataFrame, classes: int, seconds: float) -> DataFrame:
    """A row of metrics per pipeline and subject held out."""
    counts = predictions.groupBy("pipeline", "holdout").agg(F.count("*").alias("n_trials_test"))
    m = M.all_metrics(predictions, ["pipeline", "holdout"], classes, seconds)
    return m.join(counts, ["pipeline", "holdout"]).withColumnRenamed("holdout", "subject_id")


def cross_validated(trials: DataFrame, spec: Spec, k: int = 5, seed: int = 42, label: str = "label", best_so_far: float | None = None) -> list[float]:
    """Accuracies of stratified folds; stops once even perfect folds can't reach ``best_so_far``."""
    folded = splits.stratified_kfold(trials.filter(F.col(label).isNotNull()), "trial_id", label, k, seed)
    if held_out.plan(spec):
        return _until_hopeless(_fold_scores(folded, [spec], label)[spec.name], k, best_so_far)
    out: list[float] = []
    for fold in range(k):
        train, test = folded.filter(F.col("fold") != fold).drop("fold"), folded.filter(F.col("fold") == fold).drop("fold")
        p = Pipeline(spec).fit(train, test).predict(test)
        out.append(p.agg(F.avg(F.when(F.col("y_pred") == F.col(label), 1.0).otherwise(0.0))).first()[0] or 0.0)
        if best_so_far is not None and selection.early_stop(out, k, best_so_far):
            break
    return out


def _fold_scores(folded: DataFrame, specs: list[Spec], label: str) -> dict[str, list[float]]:
    """By spec the accuracy of each fold, all specs and folds from one set of passes; names must differ."""
    p = held_out.predictions(folded, specs, "fold", label)
    got = {(r["pipeline"], r["holdout"]): r["a"] for r in p.groupBy("pipeline", "holdout").agg(F.avg((F.col("y_pred") == F.col("y_true")).cast("double")).alias("a")).collect()}
    folds = sorted({f for _, f in got})
    return {s.name: [got.get((s.name, f), 0.0) for f in folds] for s in specs}


def _until_hopeless(scores: list[float], k: int, best_so_far: float | None) -> list[float]:
    """The scores up to the fold after which even perfect ones can't reach ``best_so_far``."""
    for n in range(1, len(scores) if best_so_far is not None else 0):
        if selection.early_stop(scores[:n], k, best_so_far):
            return scores[:n]
    return scores


METRIC_SCHEMA = "pipeline string, accuracy double, kappa double, stability double, latency_ms double, confidence double, train_accuracy double, cv_accuracy double, cv_score_std double, folds_done int, failed boolean, error string"


def calibrate(trials: DataFrame, specs: list[Spec], k: int = 5, seed: int = 42, label: str = "label", stop_early: bool = False) -> DataFrame:
    """pipeline_metrics of each spec: cross-validated accuracy, and of the model fitted on all trials its accuracy on them (accuracy and train_accuracy alike: no trial is kept from calibration), kappa, confidence,
    stability over chunks, milliseconds a trial. A spec that fails has a row with its error. Folds of specs that are fitted by sums come from one set of passes for all."""
    from lattica.operators.windows import chunk_stability

    rows, best = [], None
    n = max(1, trials.count())
    summed, at_once = [s for s in specs if held_out.plan(s)], {}
    if len({s.name for s in summed}) == len(summed) > 0:
        try:
            at_once = _fold_scores(splits.stratified_kfold(trials.filter(F.col(label).isNotNull()), "trial_id", label, k, seed), summed, label)
        except FAILURES:  # one by one below, where the spec that fails is told
            at_once = {}
    for spec in specs:
        try:
            limit = best if stop_early else None
            cv = _until_hopeless(at_once[spec.name], k, limit) if spec.name in at_once and held_out.plan(spec) else cross_validated(trials, spec, k, seed, label, limit)
            model = Pipeline(spec).fit(trials, trials)
            at = time.perf_counter()
            p = model.predict(trials).select("trial_id", F.col(label).alias("y_true"), "y_pred", "proba").withColumn("run", F.lit(1))
            path = shared_path(trials.sparkSession, "calibration")
            p.write.parquet(path)
            ms = 1000 * (time.perf_counter() - at) / n  # of the pass that predicts and writes
            p = trials.sparkSession.read.schema(p.schema).parquet(path)
            r = M.accuracy(p, ["run"]).join(M.kappa(p, ["run"]), "run").join(M.confidence(p, ["run"]), "run").join(chunk_stability(p, ["run"], ["trial_id"]), "run", "left").first()
            mean = float(np.mean(cv))
            best = mean if best is None or (len(cv) == k and mean > best) else best
            rows.append((spec.name, r["accuracy"], r["kappa"], r["stability"], ms, r["confidence"], r["accuracy"], mean, float(np.std(cv)), len(cv), False, None))
        except FAILURES as e:  # recorded in the table: a spec that doesn't suit the data mustn't end the search
            rows.append((spec.name, None, None, None, None, None, None, None, None, None, True, str(e)[:300]))
    return trials.sparkSession.createDataFrame(rows, METRIC_SCHEMA)


#: What a spec that fails at runtime may raise; anything else is an error of the program.
FAILURES = (ValueError, np.linalg.LinAlgError, PySparkException)


def _held_out_score(train: DataFrame, test: DataFrame, spec: Spec, metric: str, label: str) -> float:
    """A screening metric of a fit without adapters; 0 for a spec that fails."""
    try:
        p = Pipeline(replace(spec, adapter="none")).fit(train).predict(test).select(F.col(label).alias("y_true"), "y_pred").withColumn("run", F.lit(1))
        return float(M.screening_metric(p, ["run"], metric).first()[metric] or 0.0)
    except FAILURES:
        return 0.0


def quick_screen(trials: DataFrame, specs: list[Spec], share: float = 0.3, repeats: int = 1, metric: str = "balanced_accuracy", least: int = 3, most: int = 5, exclude: tuple = (), seed: int = 42, label: str = "label") -> DataFrame:
    """(pipeline, score, score_std, excluded, kept): each spec fitted on four fifths of a stratified share of the trials and scored on the rest, ``repeats`` times.

    The better half is kept, ``least`` at least and ``most`` at most; specs whose name holds one of ``exclude`` aren't scored and stay. Trials, not windows, are dealt, so none is on both sides."""
    subset = splits.stratified_split(trials.filter(F.col(label).isNotNull()), "trial_id", label, share, seed).filter("role = 'cal'").drop("role")
    rows = []
    for at, spec in enumerate(specs):
        if any(x in spec.name.lower() for x in exclude):
            rows.append((at, spec.name, None, None, True))
            continue
        scores = []
        for k in range(repeats):
            s = splits.stratified_split(subset, "trial_id", label, 0.8, seed + 1 + k)
            scores.append(_held_out_score(s.filter("role = 'cal'").drop("role"), s.filter("role = 'test'").drop("role"), spec, metric, label))
        rows.append((at, spec.name, float(np.mean(scores)), float(np.std(scores)), False))
    scored = sorted((r for r in rows if not r[4]), key=lambda r: (-r[2], r[0]))
    keep = {r[0] for r in scored[: max(1, min(most, max(least, len(scored) // 2)))]}
    out = [(name, score, std, excluded, excluded or at in keep) for at, name, score, std, excluded in rows]
    return trials.sparkSession.createDataFrame(out, "pipeline string, score double, score_std double, excluded boolean, kept boolean")


def progressive_halving(trials: DataFrame, specs: list[Spec], factor: int = 2, seed: int = 42, label: str = "label") -> tuple[list[Spec], DataFrame]:
    """The best 1 / factor of the specs by accuracy on one half of the trials when fitted on the other, and (pipeline, score, kept)."""
    halves = splits.trial_split(trials.filter(F.col(label).isNotNull()), "trial_id", 0.5, seed)
    train, test = halves.filter("role = 'train'").drop("role"), halves.filter("role = 'test'").drop("role")
    scored = sorted(((-_held_out_score(train, test, s, "accuracy", label), at) for at, s in enumerate(specs)))
    keep = [at for _, at in scored[: max(1, len(specs) // factor)]]
    rows = [(specs[at].name, -score, at in keep) for score, at in scored]
    return [specs[at] for at in keep], trials.sparkSession.createDataFrame(rows, "pipeline string, score double, kept boolean")


#: The keys of the block.
def pruning_info(screening: DataFrame | None, metrics: DataFrame, folds: int, halved: bool = False, seconds: dict | None = None) -> dict:
    """What was pruned and why, as a metrics file holds it: screening scores, who was rejected and who remained, who stopped early, and how well the screening ranked."""
    held = [r.asDict() for r in screening.collect()] if screening is not None else []  # a row a pipeline
    cv = metrics.filter("cv_accuracy IS NOT NULL").select("pipeline", F.col("cv_accuracy").alias("score"))
    correlation = None
    if held:
        correlation = selection.rank_correlation(screening.filter("score IS NOT NULL AND kept").select("pipeline", "score"), cv, "pipeline", "score").first()[0]
    early = [r["pipeline"] for r in metrics.filter("folds_done < %d" % folds).select("pipeline").collect()] if "folds_done" in metrics.columns else []
    remaining = [r["pipeline"] for r in metrics.filter("NOT failed").select("pipeline").collect()]
    of_screening = {"enabled": bool(held), "scores": {r["pipeline"]: r["score"] for r in held if not r["excluded"]}, "std": {r["pipeline"]: r["score_std"] for r in held if not r["excluded"]}}
    return {
        "quick_screening": of_screening | {"rejected": [r["pipeline"] for r in held if not r["kept"]], "remaining": remaining}, "early_stopped_pipelines": early, "progressive_halving_used": halved,
        "adaptive_pruning": {"quick_screening": of_screening | {"correlation_with_full_cv": correlation}, "runtime_stats": seconds or {}, "early_stopped_pipelines": early, "progressive_halving_used": halved},
    }


def re_evaluation_ticks(df: DataFrame, interval: int, by: list[str], order: str) -> DataFrame:
    """The rows after which an agent evaluates anew: every ``interval``-th trial of a stream."""
    return ranks.value_rank(df, order, "_n", by=by).filter(F.col("_n") % interval == 0).drop("_n")


def denoising_comparison(trials: DataFrame, specs: list[Spec], steps: dict[str, tuple], k: int = 5, seed: int = 42, label: str = "label") -> DataFrame:
    """(condition, pipeline, accuracy, accuracy_std): cross-validated accuracy of each spec behind each chain of steps; condition names the chain."""
    rows = []
    for (condition, chain), spec in product(steps.items(), specs):
        cv = cross_validated(trials, replace(spec, steps=tuple(chain)), k, seed, label)
        rows.append((condition, spec.name, float(np.mean(cv)), float(np.std(cv))))
    return trials.sparkSession.createDataFrame(rows, "condition string, pipeline string, accuracy double, accuracy_std double")


def grid_search(trials: DataFrame, spec: Spec, grid: dict[str, list], k: int = 3, seed: int = 42) -> DataFrame:
    """(params, score) for each combination of classifier options, best first."""
    rows = []
    for values in product(*grid.values()):
        options = dict(zip(grid, values, strict=True))
        cv = cross_validated(trials, Spec(spec.feature, spec.classifier, spec.adapter, spec.fs, spec.steps, {**spec.options, "classifier": options}), k, seed)
        rows.append(({n: str(v) for n, v in options.items()}, float(np.mean(cv))))
    return trials.sparkSession.createDataFrame(rows, "params map<string,string>, score double").orderBy(F.col("score").desc())


def leakage_sanity(trials: DataFrame, spec: Spec, limit: float = 0.7, seed: int = 42, label: str = "label") -> tuple[float, bool]:
    """Cross-validated accuracy on labels dealt anew by a hashed order, and whether it is suspiciously high."""
    from lattica.functions.ranks import hash_rank

    r = hash_rank(trials.withColumn("_a", seeded(seed, "trial_id")), "_a", "_i")
    other = hash_rank(trials.select("trial_id", F.col(label).alias("_l")).withColumn("_b", seeded(seed + 1, "trial_id")), "_b", "_i").select("_i", "_l")
    mixed = r.join(other, "_i").withColumn(label, F.col("_l")).drop("_a", "_i", "_l")
    score = float(np.mean(cross_validated(mixed, spec, 3, seed, label)))
    return score, score > limit


def few_shot(trials: DataFrame, spec: Spec, subject, fractions: list[float], seed: int = 42) -> DataFrame:
    """(fraction, accuracy): source trials and a growing share of the target's, tested on the rest."""
    source, target = trials.filter(F.col("subject_id") != subject), trials.filter(F.col("subject_id") == subject)
    rows = []
    for f in fractions:
        s = splits.stratified_split(target, "trial_id", "label", f, seed)
        cal, test = s.filter("role = 'cal'").drop("role"), s.filter("role = 'test'").drop("role")
        p = Pipeline(spec).fit(source.unionByName(cal), test).predict(test)
        rows.append((f, p.agg(F.avg(F.when(F.col("y_pred") == F.col("label"), 1.0).otherwise(0.0))).first()[0]))
    return trials.sparkSession.createDataFrame(rows, "fraction double, accuracy double")


def leakage_inflation(trials: DataFrame, spec: Spec, k: int = 3, seed: int = 42) -> float:
    """Stratified less grouped accuracy: what trials of the same subject on both sides add."""
    mixed = float(np.mean(cross_validated(trials, spec, k, seed)))
    folds = splits.hashed_group_kfold(trials, "subject_id", k, seed).select("subject_id", "fold")
    t, scores = trials.join(folds, "subject_id"), []
    for fold in range(k):
        train, test = t.filter(F.col("fold") != fold).drop("fold"), t.filter(F.col("fold") == fold).drop("fold")
        p = Pipeline(spec).fit(train, test).predict(test)
        scores.append(p.agg(F.avg(F.when(F.col("y_pred") == F.col("label"), 1.0).otherwise(0.0))).first()[0] or 0.0)
    return mixed - float(np.mean(scores))


def subject_means(trials: DataFrame, by: str = "subject_id", kind: str = "explicit") -> dict:
    """Log-Euclidean mean covariance of each subject (one matrix a subject)."""
    cov = features.COVARIANCES[kind]
    return {k: linalg.expm(t / n) for k, (n, t) in gathered(trials, "signal", dict, lambda x: linalg.logm(cov(x)), by).items()}


def pairwise_distance(means: dict) -> float | None:
    """Mean Riemannian distance between subjects; None for fewer than two."""
    keys = sorted(means)
    d = [float(linalg.riemann_distance(means[a], means[b])) for i, a in enumerate(keys) for b in keys[:i]]
    return float(np.mean(d)) if d else None


def alignment_diagnostics(trials: DataFrame, least_trials: int = 20) -> dict:
    """Distances between subjects before and after whitening by their means; None with fewer than two subjects of enough trials."""
    few = trials.groupBy("subject_id").agg(F.count("*").alias("n")).filter(F.col("n") < least_trials).select("subject_id")
    t = trials.join(few, "subject_id", "left_anti")
    before = subject_means(t)
    if len(before) < 2:
        return {"before": None, "after": None}
    whiten = {k: linalg.inv_sqrtm(m) for k, m in before.items()}
    after = subject_means(features.EuclideanAlignment(whiten).transform(t))
    return {"before": pairwise_distance(before), "after": pairwise_distance(after)}


def class_spread(trials: DataFrame) -> dict:
    """Per class, the mean distance between subjects' means."""
    labels = [r[0] for r in trials.filter("label IS NOT NULL").select("label").distinct().orderBy("label").collect()]
    return {k: pairwise_distance(subject_means(trials.filter(F.col("label") == k))) for k in labels}


def outlier_weights(distance: DataFrame) -> DataFrame:
    """(subject_id, distance) to weights, as ``features.subject_weights`` has them, for a table of subjects."""
    m = distance.agg(F.avg("distance").alias("m"), F.stddev_pop("distance").alias("s"))
    w = F.when(F.col("distance") > F.col("m") + 2 * F.col("s"), 0.25).otherwise(1.0) / (1 + F.col("distance"))
    r = distance.crossJoin(m).withColumn("_w", w)  # one row joined to one row a subject
    total = r.agg(F.sum("_w").alias("_t"))
    return r.crossJoin(total).select("subject_id", "distance", (F.col("_w") / F.col("_t")).alias("weight"))


band_weights = features.band_weights
