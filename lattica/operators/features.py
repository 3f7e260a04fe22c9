"""Feature extractors and alignments of trials, with fitted state as small arrays that parquet can hold.

Fitting gathers sums of matrices (associative, one partial row a task); applying is one Arrow pass.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lattica.functions import dsp, linalg
from lattica.functions.metrics import mutual_information
from lattica.operators.kernels import Kernel, extracted, extracted_by, gathered, mapped_by

COVARIANCES: dict[str, Kernel] = {"sample": linalg.covariance, "explicit": linalg.explicit_covariance, "oas": linalg.oas}

#: The bands of the filter bank in Hz.
FILTER_BANK = ((8, 12), (12, 16), (16, 20), (20, 24), (24, 30))


def psd(fs: float, n_fft: int = 256) -> Kernel:
    return lambda x: dsp.psd_bins(x, fs, n_fft)


def wavelet_energy(levels: int = 4) -> Kernel:
    return lambda x: dsp.wavelet_energy(x, levels)


def covariance_features(kind: str = "oas") -> Kernel:
    return lambda x: linalg.pack(COVARIANCES[kind](x))


def raw_flatten() -> Kernel:
    return lambda x: x


def mean_std() -> Kernel:
    return lambda x: np.concatenate((x.mean(-1), x.std(-1) + 1e-10))


def band_powers(fs: float) -> Kernel:
    return lambda x: np.array(list(dsp.band_powers(x, fs).values()))


def temporal(fs: float, bands=FILTER_BANK) -> Kernel:
    """Per band four log variances, of windows of a second that start at quarters of the trial, and Hjorth's three numbers over all samples; then each band's share of the bands' power."""
    filters = [dsp.butter_bandpass(5, a, b, fs) for a, b in bands]
    least, second = 1e-12, max(int(fs), 1)

    def run(x):
        parts, out = [dsp.filtfilt(b, a, x) for b, a in filters], []
        n = x.shape[-1]
        for y in parts:
            for start in range(0, 4 * (n // 4), max(1, n // 4)) if n >= 4 else [0] * 4:
                out.append(np.log(y[..., start : start + second].var(-1).mean() + least))
            d, dd = np.diff(y), np.diff(y, 2)
            out += [y.var() + least, np.sqrt(d.var() + least) / (np.sqrt(y.var() + least) + least), np.sqrt(dd.var() + least) / (np.sqrt(d.var()) + least) if d.var() > least else 1.0]
        power = np.array([(y**2).mean() + least for y in parts])
        return np.array([*out, *(power / (power.sum() + least))])

    return run


@dataclass
class CspLogVariance:
    """Log variance behind spatial filters; the filters are the state."""

    filters: np.ndarray

    @staticmethod
    def fit(trials: DataFrame, n: int = 2, both_ends: bool = True, label: str = "label", signal: str = "signal", corrected: bool = True) -> CspLogVariance:
        """2 n filters: of one pair of classes by generalised eigenvectors, of more by joint diagonalisation of all, the most telling first."""
        return CspLogVariance.of_sums(gathered(trials, signal, dict, linalg.covariance, label), n, both_ends, corrected)

    @staticmethod
    def of_sums(sums: dict, n: int = 2, both_ends: bool = True, corrected: bool = True) -> CspLogVariance:
        """From (trials, sum of covariances) by class."""
        keys = sorted(sums)
        means = np.stack([sums[k][1] / sums[k][0] for k in keys]) if keys else np.zeros((0, 0, 0))
        if len(keys) < 2:
            return CspLogVariance(np.eye(means.shape[-1]))
        if len(keys) == 2:
            return CspLogVariance(linalg.csp_filters(means[0], means[1], n, both_ends))
        counts = np.array([sums[k][0] for k in keys], np.float64)
        return CspLogVariance(linalg.csp_joint(means, counts / counts.sum(), 2 * n, corrected))

    def transform(self, trials: DataFrame, signal: str = "signal") -> DataFrame:
        w = self.filters
        return extracted(trials, lambda x: np.log((w @ x).var(-1) + 1e-10), signal)


def riemann_means(rows: DataFrame, of: Kernel, column: str = "signal", key: str | None = None, steps: int = 50, tolerance: float = 1e-9) -> dict:
    """(trials, mean) by key under the affine-invariant distance, None the only key without one: Karcher's fixed point from the log-Euclidean mean. of: a row's array to its matrix.

    A step is one pass that adds the log maps at the present means of all keys; it ends once no key's mean log map is longer than ``tolerance``, or after ``steps`` passes. The trials are never gathered."""
    named = "_lattica_mean" if key is None else key
    df = rows.withColumn(named, F.lit(0)) if key is None else rows
    sums = gathered(df, column, dict, lambda x: linalg.logm(of(x)), named)
    means = {k: linalg.expm(t / n) for k, (n, t) in sums.items()}
    counts, moving = {k: n for k, (n, _) in sums.items()}, set(means)
    for _ in range(steps if means else 0):
        roots = {k: (linalg.sqrtm(means[k]), linalg.inv_sqrtm(means[k])) for k in moving}
        live = df.filter(F.col(named).isin(list(moving))) if len(moving) < len(means) else df
        maps = gathered(live, column, dict, lambda x, k, given: linalg.logm(given[k][1] @ of(x) @ given[k][1]), named, roots)
        for k, (n, t) in maps.items():
            t = t / n
            means[k] = roots[k][0] @ linalg.expm(t) @ roots[k][0]
            if np.linalg.norm(t) < tolerance:
                moving.discard(k)
        if not moving:
            break
    return {(None if key is None else k): (counts[k], m) for k, m in means.items()}


@dataclass
class TangentSpace:
    """Log map at a reference covariance; optional z-score from the training rows. The reference is the log-Euclidean mean, the affine-invariant one ("riemann") or the plain one ("arithmetic")."""

    reference: np.ndarray
    kind: str = "oas"
    mean: np.ndarray | None = None
    std: np.ndarray | None = None

    @staticmethod
    def fit(trials: DataFrame, kind: str = "oas", reference: str = "log_euclidean", zscore: bool = False, signal: str = "signal") -> TangentSpace:
        cov = COVARIANCES[kind]
        if reference == "arithmetic":
            n, total = gathered(trials, signal, dict, cov)
            ref = total / n
        elif reference == "riemann":
            _, ref = riemann_means(trials, cov, signal)[None]
        else:
            n, total = gathered(trials, signal, dict, lambda x: linalg.logm(cov(x)))
            ref = linalg.expm(total / n)
        out = TangentSpace(ref, kind)
        if zscore:
            n, total = gathered(trials, signal, dict, lambda x: np.stack([(v := linalg.tangent(cov(x), ref)), v * v]))
            out.mean = total[0] / n
            out.std = np.sqrt(np.maximum(total[1] / n - out.mean**2, 0)) + 1e-8
        return out

    def vector(self, x: np.ndarray) -> np.ndarray:
        v = linalg.tangent(COVARIANCES[self.kind](x), self.reference)
        return v if self.mean is None else (v - self.mean) / self.std

    def transform(self, trials: DataFrame, signal: str = "signal") -> DataFrame:
        return extracted(trials, self.vector, signal)


@dataclass
class EuclideanAlignment:
    """Whitens each subject's trials by the subject's mean covariance: subject to matrix. A subject that wasn't fitted gets the mean of all."""

    whiten: dict

    @staticmethod
    def fit(trials: DataFrame, subject: str = "subject_id", target=None, signal: str = "signal", mean: str = "arithmetic") -> EuclideanAlignment:
        """mean: of a subject's covariances, arithmetic or riemann; that of all subjects is the log-Euclidean or the Riemannian mean of theirs."""
        if mean == "riemann":
            means = {k: m for k, (_, m) in riemann_means(trials, linalg.covariance, signal, subject).items()}
        else:
            means = {k: t / n for k, (n, t) in gathered(trials, signal, dict, linalg.covariance, subject).items()}
        if target is not None and target in means:
            raise ValueError(f"subject {target} is held out and must not be fitted on")
        out = {k: linalg.inv_sqrtm(m) for k, m in means.items()}
        if means:
            held = np.stack(list(means.values()))
            out[None] = linalg.inv_sqrtm(linalg.karcher_mean(held) if mean == "riemann" else linalg.log_euclidean_mean(held))
        return EuclideanAlignment(out)

    def transform(self, trials: DataFrame, subject: str = "subject_id", signal: str = "signal") -> DataFrame:
        """One pass, the matrices broadcast (one a subject). Rows without a subject, and subjects that weren't fitted, take the mean's."""
        whiten = trials.sparkSession.sparkContext.broadcast(self.whiten)

        def run(x, key):
            w = whiten.value.get(key, whiten.value.get(None))
            return x if w is None else w @ x

        return mapped_by(trials, run, subject, signal) if self.whiten else trials


def band_weights(df: DataFrame, bands: int, label: str = "label", column: str = "features", bins: int = 8) -> DataFrame:
    """(band, weight): mean mutual information of a band's components, cut into bins of equal width, with the label; weights sum to 1."""
    n = df.select(F.size(column)).first()[0]
    long = df.filter(F.col(label).isNotNull()).select(F.col(label).alias("y"), F.posexplode(column).alias("dim", "x"))
    edges = long.groupBy("dim").agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    b = long.join(F.broadcast(edges) if n <= 100_000 else edges, "dim").withColumn("bin", F.least(F.lit(bins - 1), F.floor((F.col("x") - F.col("lo")) / F.nullif(F.col("hi") - F.col("lo"), F.lit(0.0)) * bins).cast("int"))).withColumn("bin", F.coalesce("bin", F.lit(0)))
    mi = mutual_information(b, ["dim"], "bin", "y").withColumn("band", F.floor(F.col("dim") * bands / n).cast("int"))
    g = mi.groupBy("band").agg((F.avg("mutual_information") + 1e-12).alias("_w"))
    return g.select("band", (F.col("_w") / F.sum("_w").over(W.partitionBy(F.lit(0)))).alias("weight"))  # a row a band


#: The least trials of a subject for its alignment, and of a subject's class for alignment by class.
LEAST_SUBJECT, LEAST_CLASS = 20, 10


def _added(sums: dict) -> tuple:
    return tuple(map(sum, zip(*sums.values(), strict=True)))


@dataclass
class FilterBankRiemann:
    """Tangent vectors of every band, concatenated, weighted by band and scaled; temporal features may follow.

    With ``rsa`` each subject's matrices are first whitened by the subject's mean (by class: by the mean of its class, where every subject has enough trials of each), and with
    ``procrustes`` turned to the eigenbasis of all. The reference of a band is the log-Euclidean mean of the aligned matrices, far subjects discounted and near ones weighted up
    if asked. At prediction a fitted subject keeps its alignment; any other, and rows without a subject together, is whitened by the mean of its own given trials, without labels.
    State is a few matrices a subject and band; each step of a fit is one pass that adds matrices."""

    fs: float
    bands: tuple
    references: list
    align: dict | None = None
    kind: str = "explicit"
    scale: np.ndarray | None = None
    mean: np.ndarray | None = None
    std: np.ndarray | None = None
    timed: bool = False
    band_weight: list | None = None
    subject_weight: list | None = None
    outliers: list | None = None
    distances: dict | None = None

    def _covariances(self):
        cov, designs = COVARIANCES[self.kind], [dsp.butter_bandpass(5, a, b, self.fs) for a, b in self.bands]
        return lambda x: np.stack([cov(dsp.filtfilt(b, a, x)) for b, a in designs])

    @staticmethod
    def fit(trials: DataFrame, fs: float, bands=FILTER_BANK, signal: str = "signal", *, rsa: bool = False, by_class: bool = False, procrustes: bool = False, weigh_subjects: bool = False, discount_outliers: bool = False,
            weigh_bands: bool = False, with_temporal: bool = False, zscore: bool = True, kind: str = "explicit", subject: str = "subject_id", label: str = "label") -> FilterBankRiemann:
        out = FilterBankRiemann(fs, tuple(bands), [], kind=kind, timed=with_temporal)
        covs, key = out._covariances(), "_lattica_key"
        logs = lambda x: np.stack([linalg.logm(c) for c in covs(x)])
        rows = trials.withColumn(key, F.to_json(F.struct(F.col(subject).alias("s"), F.col(label).alias("c")) if by_class else F.struct(F.col(subject).alias("s"))))
        if not rsa:
            n, total = gathered(trials, signal, dict, logs)
            out.references = [linalg.expm(t / n) for t in total]
            turn = None
        else:
            sums = gathered(rows, signal, dict, logs, key)
            owner = {k: json.loads(k).get("s") for k in sums}
            subjects = {s: _added({k: v for k, v in sums.items() if owner[k] == s}) for s in set(owner.values())}
            few = [s for s, (n, _) in subjects.items() if n < LEAST_SUBJECT]
            if few:
                raise ValueError(f"subjects {sorted(map(str, few))} have fewer than {LEAST_SUBJECT} trials")
            classes = {json.loads(k).get("c") for k in sums} - {None}
            if by_class and not (len(subjects) > 1 and all(sums.get(json.dumps({"s": s, "c": c}, separators=(",", ":")), (0,))[0] >= LEAST_CLASS for s in subjects for c in classes)):
                by_class = False
            means = lambda sums: {k: [linalg.expm(t / n) for t in total] for k, (n, total) in sums.items()}
            of_subject = means(subjects)
            white = {s: [linalg.inv_sqrtm(m) for m in ms] for s, ms in of_subject.items()}
            turn = {k: [linalg.inv_sqrtm(m) for m in ms] for k, ms in means(sums).items()} if by_class else {k: white[owner[k]] for k in sums}
            moved = lambda x, k, turn: np.stack([linalg.logm(a @ c @ a.T) for a, c in zip(turn[k], covs(x), strict=True)])
            aligned = gathered(rows, signal, dict, moved, key, turn)
            per = lambda sums: {s: _added({k: v for k, v in sums.items() if owner[k] == s}) for s in subjects}
            out.distances = {"before": [spread([m[b] for m in of_subject.values()]) for b in range(len(bands))]}
            if procrustes:
                n, total = _added(aligned)
                whole, own = [linalg.expm(t / n) for t in total], means(per(aligned))
                quarter = {s: [linalg.procrustes(m, w).T for m, w in zip(ms, whole, strict=True)] for s, ms in own.items()}
                turn = {k: [q @ a for q, a in zip(quarter[owner[k]], turn[k], strict=True)] for k in turn}
                white = {s: [q @ a for q, a in zip(quarter[s], white[s], strict=True)] for s in white}
                aligned = gathered(rows, signal, dict, moved, key, turn)
            held = per(aligned)
            out.distances["after"] = [spread([linalg.expm(t[b] / n) for n, t in held.values()]) for b in range(len(bands))]
            out.align, out.subject_weight, out.outliers = white, [], []
            for b in range(len(bands)):
                n, total = sum(n for n, _ in held.values()), sum(t[b] for _, t in held.values())
                reference = linalg.expm(total / n)
                if weigh_subjects or discount_outliers:
                    d = {s: float(linalg.riemann_distance(linalg.expm(t[b] / n), reference)) for s, (n, t) in held.items()}
                    w, far = subject_weights(d, weigh_subjects)
                    reference = linalg.expm(sum(w[s] * t[b] for s, (_, t) in held.items()) / sum(w[s] * n for s, (n, _) in held.items()))
                    out.subject_weight.append(w)
                    out.outliers.append(far)
                out.references.append(reference)
        # the training rows' vectors are aligned as above, by class if so fitted
        vectors = rows.drop(*[c for c in ("features",) if c in rows.columns])
        made = extracted_by(vectors, out._vector(turn), key, signal)
        if weigh_bands:
            size = len(out.references[0]) * (len(out.references[0]) + 1) // 2
            only = made.withColumn("features", F.slice("features", 1, size * len(bands)))
            got = {r["band"]: r["weight"] for r in band_weights(only, len(bands), label).collect()}
            out.band_weight = [got.get(b, 0.0) for b in range(len(bands))]
            out.scale = np.r_[np.repeat(out.band_weight, size), np.ones(8 * len(bands) if with_temporal else 0)]
        if zscore:
            scale = out.scale
            n, total = gathered(made, "features", dict, lambda v: (lambda u: np.stack([u, u * u]))(v if scale is None else v * scale))
            out.mean = total[0] / n
            deviation = np.sqrt(np.maximum(total[1] / n - out.mean**2, 0))
            out.std = np.where(deviation > 1e-12, deviation, 1.0)
        return out

    def _vector(self, turn: dict | None):
        covs, refs = self._covariances(), self.references
        more = temporal(self.fs, self.bands) if self.timed else None

        def run(x, key):
            parts = covs(x) if turn is None else [a @ c @ a.T for a, c in zip(turn[key], covs(x), strict=True)]
            v = [linalg.tangent(c, r) for c, r in zip(parts, refs, strict=True)]
            return np.concatenate([*v, more(x)] if more else v)

        return run

    def transform(self, trials: DataFrame, signal: str = "signal", subject: str = "subject_id") -> DataFrame:
        """The columns without the signal, and features."""
        turn = None
        if self.align is not None:
            covs = self._covariances()
            fitted = [s for s in self.align if s is not None]  # a null in the list would make every answer null
            new = trials.filter(F.col(subject).isNull() | ~F.col(subject).isin(fitted))
            key = F.coalesce(F.col(subject).cast("string"), F.lit(""))
            sums = gathered(new.withColumn("_lattica_key", key), signal, dict, lambda x: np.stack([linalg.logm(c) for c in covs(x)]), "_lattica_key")
            turn = {str(s): m for s, m in self.align.items()} | {s: [linalg.inv_sqrtm(linalg.expm(t / n)) for t in total] for s, (n, total) in sums.items()}
        vector, scale, mean, std = self._vector(turn), self.scale, self.mean, self.std

        def run(x, key):
            v = vector(x, "" if key is None else str(key))
            v = v if scale is None else v * scale
            return v if mean is None else (v - mean) / std

        return extracted_by(trials, run, subject, signal, drop=()) if self.align is not None else extracted(trials, lambda x: run(x, None), signal)


def spread(means: list) -> float | None:
    """Mean Riemannian distance between matrices; None for fewer than two."""
    d = [float(linalg.riemann_distance(a, b)) for i, a in enumerate(means) for b in means[:i]]
    return float(np.mean(d)) if d else None


#: Fixed values in ``subject_weights``: two deviations, a quarter, the floor of a weight; in ``temporal``: the order of its numbers.
def subject_weights(distance: dict, reliable: bool = True) -> tuple[dict, dict]:
    """Weights that sum to 1 by distance from the reference, and who is an outlier: beyond mean + 2 deviations a quarter counts; with ``reliable`` times 1 / (1 + distance)."""
    d = np.array(list(distance.values()))
    limit = d.mean() + 2 * (d.std() if len(d) > 1 else 1e-6)
    far = {s: bool(x > limit) for s, x in distance.items()}
    w = {s: max((0.25 if far[s] else 1.0) / (1.0 + x if reliable else 1.0), 1e-6) for s, x in distance.items()}
    return {s: x / sum(w.values()) for s, x in w.items()}, far


FEATURES = {"psd": psd, "wavelet": wavelet_energy, "covariance": covariance_features, "raw": raw_flatten, "deep": mean_std, "band_powers": band_powers, "temporal": temporal, "csp": CspLogVariance, "riemann_tangent": TangentSpace, "ea": EuclideanAlignment, "filter_bank_riemann": FilterBankRiemann}
