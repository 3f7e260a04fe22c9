"""Paired statistics: aggregates in SQL, distribution tails as vectorised numpy.

Paired rows have v1 and v2; ``by`` are the columns of a family of pairs (a metric, two pipelines). Deltas are v2 - v1.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import pandas_udf
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from lattica.functions.hashed import first_words
from lattica.functions.metrics import counted_below
from lattica.session import shared_path

#: Pairs up to which all sign patterns are counted.
EXACT_PAIRS = 20


def _beta_fraction(a: float, b: float, x: float) -> float:
    c, d = 1.0, 1 / (1 - (a + b) * x / (a + 1) or 1e-300)
    out = d
    for m in range(1, 300):
        up = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        d, c = 1 / (1 + up * d or 1e-300), 1 + up / c or 1e-300
        out *= d * c
        up = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d, c = 1 / (1 + up * d or 1e-300), 1 + up / c or 1e-300
        out *= d * c
        if abs(d * c - 1) < 1e-14:
            break
    return out


def incomplete_beta(a: float, b: float, x: float) -> float:
    """Regularised, by a continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    return front * _beta_fraction(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * _beta_fraction(b, a, 1 - x) / b


def t_tail(t: float, df: float) -> float:
    """Two-sided."""
    return incomplete_beta(df / 2, 0.5, df / (df + t * t)) if math.isfinite(t) else 0.0


def normal_tail(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def normal_quantile(p: float) -> float:
    lo, hi = -40.0, 40.0
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if 0.5 * math.erfc(-mid / math.sqrt(2)) < p else (lo, mid)
    return (lo + hi) / 2


def wilcoxon_tail(ranks: list[float], w: float) -> float:
    """Exact two-sided p of the smaller signed-rank sum, for any ranks (ties have halves): all sign patterns, by counting sums."""
    doubled = [int(round(2 * r)) for r in ranks]
    counts = np.zeros(sum(doubled) + 1)
    counts[0] = 1
    for r in doubled:
        counts[r:] += counts[: len(counts) - r].copy()
    return float(min(1.0, 2 * counts[: int(math.floor(2 * w + 1e-9)) + 1].sum() / 2.0 ** len(doubled)))


@pandas_udf(DoubleType())
def t_tail_udf(t, df):  # noqa: D103
    import pandas as pd

    return pd.Series([None if a is None or b is None or a != a or b < 1 else t_tail(a, b) for a, b in zip(t, df, strict=True)], dtype="float64")


@pandas_udf(DoubleType())
def normal_tail_udf(z):  # noqa: D103
    import pandas as pd

    return pd.Series([None if a is None or a != a else normal_tail(a) for a in z], dtype="float64")


@pandas_udf(DoubleType())
def wilcoxon_tail_udf(ranks, w):  # noqa: D103
    import pandas as pd

    return pd.Series([wilcoxon_tail(list(r), v) if len(r) else 1.0 for r, v in zip(ranks, w, strict=True)], dtype="float64")


def aligned(a: DataFrame, b: DataFrame, key: str, metric: str, order: str | None = None) -> DataFrame:
    """(key, v1, v2) where both tables have the metric; of rows repeated with one key the last by ``order`` counts."""

    def once(df, name):
        if order:
            df = df.groupBy(key).agg(F.max_by(metric, order).alias(metric))
        else:
            df = df.groupBy(key).agg(F.max(metric).alias(metric))
        return df.filter(F.col(metric).isNotNull()).select(key, F.col(metric).cast("double").alias(name))

    return once(a, "v1").join(once(b, "v2"), key)


def effect(pairs: DataFrame, by: list[str] = ()) -> DataFrame:
    """(n, mean_1, mean_2, std_1, std_2, mean_delta, std_delta, cohens_d, t_stat): population deviations but for t. cohens_d is null for n < 2 and 0 where deltas don't vary."""
    d = F.col("v2") - F.col("v1")
    g = pairs.groupBy(*by).agg(F.count("*").alias("n"), F.avg("v1").alias("mean_1"), F.avg("v2").alias("mean_2"), F.stddev_pop("v1").alias("std_1"), F.stddev_pop("v2").alias("std_2"), F.avg(d).alias("mean_delta"), F.stddev_pop(d).alias("std_delta"), F.stddev_samp(d).alias("_s"))
    cohen = F.when(F.col("n") < 2, None).when(F.col("std_delta") == 0, 0.0).otherwise(F.col("mean_delta") / F.nullif(F.col("std_delta"), F.lit(0.0)))
    return g.withColumn("cohens_d", cohen).withColumn("t_stat", F.col("mean_delta") / F.nullif(F.col("_s") / F.sqrt("n"), F.lit(0.0))).drop("_s")


def paired_t(pairs: DataFrame, by: list[str] = ()) -> DataFrame:
    e = effect(pairs, by)
    return e.withColumn("p_value", t_tail_udf("t_stat", (F.col("n") - 1).cast("double")))


#: Pairs up to which all sign patterns are counted for Wilcoxon's test, by sums of ranks.
EXACT_RANKS = 50


def signed_ranks(pairs: DataFrame, by: list[str] = ()) -> DataFrame:
    """(n, w_plus, w_minus, ranks) over pairs that differ; equal distances share their mean rank. ranks is null beyond EXACT_RANKS pairs."""
    family = W.partitionBy(*by) if by else W.partitionBy(F.lit(0))  # a row for each distance
    d = pairs.withColumn("_d", F.col("v2") - F.col("v1")).filter("_d <> 0").withColumn("_a", F.abs("_d"))
    c = d.groupBy(*by, "_a").agg(F.count("*").alias("_k"), F.count(F.when(F.col("_d") > 0, 1)).alias("_p"))
    before = F.sum("_k").over(family.orderBy("_a")) - F.col("_k")
    c = c.withColumn("_r", before + (F.col("_k") + 1) / 2.0).withColumn("_n", F.sum("_k").over(family))
    few = F.when(F.col("_n") <= EXACT_RANKS, F.array_repeat("_r", F.col("_k").cast("int")))
    g = c.groupBy(*by).agg(F.sum("_k").alias("n"), F.sum(F.col("_r") * F.col("_p")).alias("w_plus"), F.sum(F.col("_r") * (F.col("_k") - F.col("_p"))).alias("w_minus"), F.flatten(F.collect_list(few)).alias("ranks"))
    return g.withColumn("ranks", F.when(F.col("n") <= EXACT_RANKS, F.col("ranks")))


def wilcoxon(pairs: DataFrame, by: list[str] = ()) -> DataFrame:
    """Exact p up to 50 pairs, else the normal approximation."""
    r = signed_ranks(pairs, by).withColumn("statistic", F.least("w_plus", "w_minus"))
    n = F.col("n").cast("double")
    z = (F.col("statistic") - n * (n + 1) / 4) / F.sqrt(n * (n + 1) * (2 * n + 1) / 24)
    return r.withColumn("p_value", F.when(F.col("n") <= EXACT_RANKS, wilcoxon_tail_udf(F.coalesce("ranks", F.array().cast("array<double>")), "statistic")).otherwise(normal_tail_udf(z))).drop("ranks")


def permutation_exact(pairs: DataFrame, key: str, by: list[str] = ()) -> DataFrame:
    """(n, observed, p_value): the share of all 2**n sign patterns whose |mean| reaches the observed one. Families of more than EXACT_PAIRS pairs get null.

    A pattern is a number; its mean is a fold over the family's deltas, so patterns are rows and deltas one bounded array."""
    d = pairs.select(*by, key, (F.col("v2") - F.col("v1")).alias("d"))
    g = d.groupBy(*by).agg(F.count("*").cast("int").alias("n"), F.avg("d").alias("observed"), F.count("*").alias("_n"))
    few = g.filter(F.col("n") <= EXACT_PAIRS).drop("observed", "_n")
    held = d.join(few, by) if by else d.crossJoin(few)
    arrays = held.groupBy(*by, "n").agg(F.transform(F.array_sort(F.collect_list(F.struct(key, "d"))), lambda s: s["d"]).alias("ds"))
    masks = arrays.withColumn("mask", F.explode(F.sequence(F.lit(0).cast("long"), F.pow(F.lit(2.0), F.col("n")).cast("long") - 1)))
    total = lambda m: F.aggregate(F.zip_with("ds", F.sequence(F.lit(0), F.col("n") - 1), lambda v, k: F.when(F.floor(m / F.pow(F.lit(2.0), k)) % 2 == 1, -v).otherwise(v)), F.lit(0.0), lambda s, v: s + v)
    s = masks.withColumn("_s", F.abs(total(F.col("mask")))).withColumn("_o", F.abs(F.aggregate("ds", F.lit(0.0), lambda a, v: a + v)))
    p = s.groupBy(*by).agg(F.avg(F.when(F.col("_s") >= F.col("_o") - 1e-12, 1.0).otherwise(0.0)).alias("p_value"))
    out = g.drop("_n")
    return out.join(p, by, "left") if by else out.crossJoin(p)


#: Hashes that a task holds as signs or draws at a time.
CELLS = 1 << 20
#: Families whose sums of all permutations a task keeps before it passes them on.
KEPT_FAMILIES = 64


def _tasks(df: DataFrame) -> int:
    """How many tasks share work that is far larger than its rows."""
    spark = df.sparkSession
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


def _signed_sums(d: DataFrame, by: list[str], n_perm: int, seed: int) -> DataFrame:
    """(by, _p, _s): parts of the sum of each family's ``_d`` under each permutation's signs, which ``_k`` decides; null deltas count as 0.

    A pair's signs are a column of an array, made once for all families that have the pair, not ``n_perm`` rows."""
    n = len(by)
    d = d.select(*by, "_k", "_d").repartition(_tasks(d), "_k").sortWithinPartitions("_k")
    out = StructType([*[StructField(f"c{j}", f.dataType) for j, f in enumerate(d.schema.fields[:n])], StructField("_p", LongType()), StructField("_s", DoubleType())])

    def passed_on(kept):
        for row, sums in kept.values():
            yield pa.RecordBatch.from_arrays([*[c.take(pa.array(np.zeros(n_perm, np.int64))) for c in row], pa.array(np.arange(n_perm)), pa.array(sums)], names=out.names)

    def run(batches):
        kept: dict = {}
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                keys, place, rows = part.column(n).to_pylist(), {}, {}
                columns = np.array([place.setdefault(k, len(place)) for k in keys])
                for r, family in enumerate(map(str, zip(*[c.to_pylist() for c in part.columns[:n]], strict=True)) if n else [""] * len(keys)):
                    rows.setdefault(family, []).append(r)
                if len(kept) + len(rows) > KEPT_FAMILIES:
                    yield from passed_on(kept)
                    kept.clear()
                for family, held in rows.items():
                    if family not in kept:
                        kept[family] = [c.slice(held[0], 1) for c in part.columns[:n]], np.zeros(n_perm)
                delta = part.column(n + 1).fill_null(0.0).to_numpy(zero_copy_only=False)
                tails = [b"" if k is None else b":" + k.encode() for k in place]
                step = max(1, CELLS // len(tails))
                for lo in range(0, n_perm, step):
                    hi = min(n_perm, lo + step)
                    signs = 1.0 - 2.0 * (first_words([f"{seed}:{p}".encode() for p in range(lo, hi)], tails) >> np.uint32(4) & np.uint32(1))  # the first hex digit is even or odd
                    for family, held in rows.items():
                        kept[family][1][lo:hi] += signs[:, columns[held]] @ delta[held]
                if len(kept) > KEPT_FAMILIES:
                    yield from passed_on(kept)
                    kept.clear()
        yield from passed_on(kept)

    return d.toDF(*[f"c{j}" for j in range(n)], "_k", "_d").mapInArrow(run, out).toDF(*by, "_p", "_s")


def permutation(pairs: DataFrame, key: str, by: list[str] = (), n_perm: int = 10_000, seed: int = 42) -> DataFrame:
    """Monte Carlo with hashed signs: (k + 1) / (n_perm + 1). Each pair's signs come from the MD5 of seed:permutation:key; sums combine before the shuffle."""
    d = pairs.select(*by, F.col(key).cast("string").alias("_k"), (F.col("v2") - F.col("v1")).cast("double").alias("_d"))
    obs = d.groupBy(*by).agg(F.abs(F.sum("_d")).alias("_o"), F.count("*").alias("n"))
    s = _signed_sums(d, list(by), n_perm, seed).groupBy(*by, "_p").agg(F.abs(F.sum("_s")).alias("_s"))
    s = s.join(obs, by) if by else s.crossJoin(obs)
    g = s.groupBy(*by).agg(F.max("n").alias("n"), F.count(F.when(F.col("_s") >= F.col("_o") - 1e-12, 1)).alias("_k"))
    return g.withColumn("p_value", (F.col("_k") + 1.0) / (n_perm + 1)).drop("_k")


def paired_permutation(pairs: DataFrame, key: str, by: list[str] = (), n_perm: int = 10_000, seed: int = 42) -> DataFrame:
    """(n, observed, p_value) for families of any size: all sign patterns up to EXACT_PAIRS pairs, ``n_perm`` hashed ones beyond."""
    g = pairs.groupBy(*by).agg(F.count("*").alias("n"), F.avg(F.col("v2") - F.col("v1")).alias("observed"))
    named = lambda df: df.select(*[F.col(c).alias(f"_k_{c}") for c in by], F.col("p_value"))
    of = lambda p: [g[c].eqNullSafe(p[f"_k_{c}"]) for c in by] if by else F.lit(True)  # noqa: E731  without families one row meets one row
    many = g.filter(F.col("n") > EXACT_PAIRS).select(*[F.col(c).alias(f"_m_{c}") for c in by], F.lit(True).alias("_many"))
    large = pairs.join(many, [pairs[c].eqNullSafe(many[f"_m_{c}"]) for c in by] if by else F.lit(True)).select(*pairs.columns)
    exact, drawn = named(permutation_exact(pairs, key, by)), named(permutation(large, key, by, n_perm, seed)).withColumnRenamed("p_value", "_p")
    g = g.join(exact, of(exact), "left").drop(*[f"_k_{c}" for c in by])
    g = g.join(drawn, of(drawn), "left").drop(*[f"_k_{c}" for c in by])
    return g.select(*by, "n", "observed", F.coalesce("p_value", "_p").alias("p_value"))


def hashed_index(seed: int, replicate: Column, place: Column, n: Column) -> Column:
    """A reproducible draw from 0..n-1: the first seven hex digits of MD5 of seed:replicate:place."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), replicate.cast("string"), place.cast("string"))), 1, 7), 16, 10).cast("long") % n


#: Pairs up to which a family's deltas are one array in a task; a larger family's draws are rows that meet them in a join.
HELD_PAIRS = 1 << 18


def _drawn_means(d: DataFrame, by: list[str], replicates: int, seed: int) -> DataFrame:
    """(by, _n, _m): the mean of each replicate's draws, from (by, _d, _i, _n) of families of HELD_PAIRS at most. Replicates are dealt in ranges, the deltas with each."""
    n = len(by)
    g = d.groupBy(*by, "_n").agg(F.transform(F.array_sort(F.collect_list(F.struct("_i", "_d"))), lambda s: s["_d"]).alias("_ds"))
    size = F.greatest(F.lit(1), F.floor(F.lit(4 * CELLS) / F.col("_n"))).cast("int")
    g = g.withColumn("_lo", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1), size))).select(*by, "_n", "_ds", "_lo", F.least(F.lit(replicates), F.col("_lo") + size).alias("_hi")).repartition(_tasks(d))
    out = StructType([*[StructField(f"c{j}", f.dataType) for j, f in enumerate(g.schema.fields[:n])], StructField("_n", LongType()), StructField("_m", DoubleType())])

    def run(batches):
        for batch in batches:
            for r in range(batch.num_rows):
                count, lo, hi = (batch.column(k)[r].as_py() for k in (n, n + 2, n + 3))
                deltas = batch.column(n + 1)[r].values
                there = deltas.is_valid().to_numpy(zero_copy_only=False)
                deltas = deltas.fill_null(0.0).to_numpy(zero_copy_only=False)
                tails, step, means = [b"%d" % k for k in range(count)], max(1, CELLS // count), []
                for at in range(lo, hi, step):
                    picks = (first_words([b"%d:%d:" % (seed, b) for b in range(at, min(hi, at + step))], tails).byteswap() >> np.uint32(4)) % np.uint32(count)  # seven hex digits
                    known = there[picks].sum(axis=1)
                    means += [t / k if k else None for t, k in zip(deltas[picks].sum(axis=1).tolist(), known.tolist(), strict=True)]
                row = pa.array(np.full(len(means), r))
                yield pa.RecordBatch.from_arrays([*[batch.column(k).take(row) for k in range(n + 1)], pa.array(means, pa.float64())], names=out.names)

    return g.toDF(*[f"c{j}" for j in range(n)], "_n", "_ds", "_lo", "_hi").mapInArrow(run, out).toDF(*by, "_n", "_m")


def bootstrap_ci(pairs: DataFrame, key: str, by: list[str] = (), replicates: int = 2000, seed: int = 42, level: float = 0.95, resolution: int | None = None) -> DataFrame:
    """(n, ci_low, ci_high) of the mean delta: rows drawn by hashed place, percentiles with linear interpolation."""
    family = W.partitionBy(*by) if by else W.partitionBy(F.lit(0))  # a family of pairs: one row a subject
    d = pairs.withColumn("_d", (F.col("v2") - F.col("v1")).cast("double")).withColumn("_i", F.row_number().over(family.orderBy(key)) - 1).withColumn("_n", F.count(F.lit(1)).over(family)).select(*by, "_d", "_i", "_n")
    large = d.filter(F.col("_n") > HELD_PAIRS)
    drawn = large.select(*by, F.col("_i").alias("_place"), "_n").withColumn("_b", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1)))).withColumn("_i", hashed_index(seed, F.col("_b"), F.col("_place"), F.col("_n")))
    means = drawn.join(large.drop("_n"), [*by, "_i"]).groupBy(*by, "_b").agg(F.avg("_d").alias("_m"), F.max("_n").alias("_n"))
    means = _drawn_means(d.filter(F.col("_n") <= HELD_PAIRS), list(by), replicates, seed).unionByName(means.select(*by, "_n", "_m"))
    lo = (1 - level) / 2
    return means.groupBy(*by).agg(F.max("_n").alias("n"), F.percentile("_m", lo).alias("ci_low"), F.percentile("_m", 1 - lo).alias("ci_high"))


#: The chances that a Poisson number of mean 1 is at most 0, 1, 2, ...
POISSON = (0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563, 0.9994058151824183, 0.999916758850712, 0.9999897508033253, 0.999998874797402)
BOOTSTRAP_METRICS = ("roc_auc", "average_precision", "accuracy", "precision", "recall", "f1")


def bootstrap_metric(df: DataFrame, score: str, label: str, key: str, metric: str = "roc_auc", by: list[str] = (), replicates: int = 1000, seed: int = 0, level: float = 0.95, threshold: float = 0.5) -> DataFrame:
    """(original_score, ci_low, ci_high) of a metric of scores against a 0/1 label, by family.

    A row counts a Poisson number of times in a replicate, drawn by the MD5 of seed:replicate:key, so rows need no numbers and no join; sums combine before the shuffle.
    Threshold metrics take one pass; ranking metrics count by distinct score. Replicates without a value (one class only) don't count."""
    if metric not in BOOTSTRAP_METRICS:
        raise ValueError(f"no metric {metric!r}")
    u = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("_rep").cast("string"), F.col("_key"))), 1, 7), 16, 10).cast("long") / float(16**7)
    drawn = F.array_size(F.filter(F.array(*[F.lit(p) for p in POISSON]), lambda p: p <= u))
    rows = df.filter(F.col(label).isin(0, 1) & F.col(score).isNotNull()).select(*by, F.col(score).cast("double").alias("score"), F.col(label).cast("int").alias("_y"), F.col(key).cast("string").alias("_key"))
    rows = rows.withColumn("_rep", F.explode(F.sequence(F.lit(-1), F.lit(replicates - 1)))).withColumn("_w", F.when(F.col("_rep") < 0, 1).otherwise(drawn)).filter("_w > 0")
    keys = [*by, "_rep"]
    if metric in ("roc_auc", "average_precision"):
        s = rows.groupBy(*keys, "score").agg(F.sum(F.col("_w") * F.col("_y")).alias("pos"), F.sum(F.col("_w") * (1 - F.col("_y"))).alias("neg"))
        s = counted_below(s, keys, "score", "pos", "neg")
        if metric == "roc_auc":
            value = F.sum(F.col("pos") * (F.col("neg_below") + F.col("neg") / 2.0)) / F.nullif((F.max("pos_all") * F.max("neg_all")).cast("double"), F.lit(0.0))
        else:
            hits, shown = F.col("pos_all") - F.col("pos_below"), F.col("pos_all") - F.col("pos_below") + F.col("neg_all") - F.col("neg_below")
            value = F.sum(F.col("pos") * hits / shown) / F.nullif(F.max("pos_all").cast("double"), F.lit(0.0))
        m = s.groupBy(*keys).agg(value.alias("v"))
    else:
        said = F.when(F.col("score") >= threshold, 1).otherwise(0)
        g = rows.groupBy(*keys).agg(F.sum(F.col("_w") * said * F.col("_y")).alias("tp"), F.sum(F.col("_w") * said).alias("p"), F.sum(F.col("_w") * F.col("_y")).alias("t"), F.sum("_w").alias("n"))
        tp, p, t, n = (F.col(c).cast("double") for c in ("tp", "p", "t", "n"))
        over = lambda a, b: a / F.nullif(b, F.lit(0.0))
        value = {"accuracy": over(n - p - t + 2 * tp, n), "precision": over(tp, p), "recall": over(tp, t), "f1": over(2 * tp, p + t)}[metric]
        m = g.select(*keys, value.alias("v"))
    lo, drawn = (1 - level) / 2, F.when(F.col("_rep") >= 0, F.col("v"))
    return m.groupBy(*by).agg(F.max(F.when(F.col("_rep") < 0, F.col("v"))).alias("original_score"), F.percentile(drawn, lo).alias("ci_low"), F.percentile(drawn, 1 - lo).alias("ci_high"))


def compare(a: DataFrame, b: DataFrame, key: str, metrics: list[str], test: str = "permutation", round_to: int = 6, n_perm: int = 10_000, replicates: int = 2000, names: tuple[str, str] = ("Pipeline_A", "Pipeline_B")) -> DataFrame:
    """One row per metric: both means and deviations, delta, statistic, p, effect size, interval. Metrics with fewer than two pairs have an error instead of a p."""
    long = lambda df: df.select(key, F.expr("stack({}, {}) as (metric, value)".format(len(metrics), ", ".join(f"'{m}', cast({m} as double)" for m in metrics)))).filter("value IS NOT NULL").groupBy(key, "metric").agg(F.max("value").alias("value"))
    pairs = long(a).withColumnRenamed("value", "v1").join(long(b).withColumnRenamed("value", "v2"), [key, "metric"])
    path = shared_path(pairs.sparkSession, "pairs")
    pairs.write.parquet(path)  # a few numbers a key, read by each statistic; what made them may be large
    pairs = pairs.sparkSession.read.parquet(path)
    by = ["metric"]
    out = effect(pairs, by)
    if test == "t":
        p = paired_t(pairs, by).select("metric", F.col("t_stat").alias("statistic"), "p_value")
    elif test == "wilcoxon":
        p = wilcoxon(pairs, by).select("metric", "statistic", "p_value")
    else:
        p = paired_permutation(pairs, key, by, n_perm).select("metric", F.col("observed").alias("statistic"), "p_value")
    out = out.join(p, by, "left").join(bootstrap_ci(pairs, key, by, replicates).drop("n"), by, "left")
    asked = pairs.sparkSession.createDataFrame([(m,) for m in metrics], "metric string")
    few = F.coalesce("n", F.lit(0)) < 2
    out = asked.join(out, "metric", "left").withColumn("error", F.when(few, "fewer than two pairs")).withColumn("p_value", F.when(~few, F.col("p_value"))).withColumn("statistic", F.when(~few, F.col("statistic")))
    cols = [F.round(c, round_to).alias(c) for c in ("mean_1", "mean_2", "std_1", "std_2", "mean_delta", "std_delta", "statistic", "p_value", "cohens_d", "ci_low", "ci_high")]
    return out.select("metric", F.lit(names[0]).alias("name_1"), F.lit(names[1]).alias("name_2"), F.lit(test).alias("test_used"), F.coalesce("n", F.lit(0)).alias("n_subjects"), *cols, F.coalesce(F.col("p_value") < 0.05, F.lit(False)).alias("significant"), "error")


def delong(df: DataFrame, by: list[str], score_1: str, score_2: str, label: str) -> DataFrame:
    """(auc_1, auc_2, z, p_value) for two scores of the same rows against a 0/1 label, by structural components.

    A positive's component is the share of negatives below its score, a negative's that of positives above, ties by half; counted by distinct score, so no family is sorted in one task."""
    rows = df.filter(F.col(label).isin(0, 1)).select(*by, F.col(label).alias("_y"), F.col(score_1).alias("_s1"), F.col(score_2).alias("_s2"))
    for k in (1, 2):
        s = rows.groupBy(*by, F.col(f"_s{k}").alias("score")).agg(F.sum("_y").alias("pos"), F.sum(1 - F.col("_y")).alias("neg"))
        s = counted_below(s, by, "score", "pos", "neg")
        of_pos = (F.col("neg_below") + F.col("neg") / 2.0) / F.nullif("neg_all", F.lit(0))
        of_neg = 1.0 - (F.col("pos_below") + F.col("pos") / 2.0) / F.nullif("pos_all", F.lit(0))
        s = s.select(*[F.col(c).alias(f"_k_{c}") for c in by], F.col("score").alias("_score"), of_pos.alias(f"_p{k}"), of_neg.alias(f"_n{k}"))
        rows = rows.join(s, [*[rows[c].eqNullSafe(s[f"_k_{c}"]) for c in by], rows[f"_s{k}"].eqNullSafe(s["_score"])]).drop("_score", *[f"_k_{c}" for c in by])
    pos, neg = F.col("_y") == 1, F.col("_y") == 0
    g = rows.groupBy(*by).agg(
        F.sum("_y").cast("long").alias("m"), F.sum(1 - F.col("_y")).cast("long").alias("n"), F.avg(F.when(pos, F.col("_p1"))).alias("auc_1"), F.avg(F.when(pos, F.col("_p2"))).alias("auc_2"),
        F.var_samp(F.when(pos, F.col("_p1") - F.col("_p2"))).alias("_p"), F.var_samp(F.when(neg, F.col("_n1") - F.col("_n2"))).alias("_q"),
    )
    z = (F.col("auc_1") - F.col("auc_2")) / F.nullif(F.sqrt(F.col("_p") / F.nullif("m", F.lit(0)) + F.col("_q") / F.nullif("n", F.lit(0))), F.lit(0.0))
    return g.withColumn("z", z).withColumn("p_value", F.coalesce(normal_tail_udf("z"), F.lit(1.0))).drop("_p", "_q")


def holm(df: DataFrame, p: str = "p_value", by: list[str] = ()) -> DataFrame:
    """Adds p_holm within a family of tests."""
    fam = W.partitionBy(*by) if by else W.partitionBy(F.lit(0))
    r = df.withColumn("_r", F.row_number().over(fam.orderBy(p))).withColumn("_n", F.count(p).over(fam))
    return r.withColumn("p_holm", F.least(F.lit(1.0), F.max(F.col(p) * (F.col("_n") - F.col("_r") + 1)).over(fam.orderBy("_r")))).drop("_r", "_n")


def auc_to_odds_ratio(auc: float) -> dict[str, float]:
    z = normal_quantile(auc)
    d = z * math.sqrt(2)
    log_or = math.pi * d / math.sqrt(3)
    return {"z": z, "d": d, "ln_or": log_or, "odds_ratio": math.exp(log_or)}


def acceptance(comparison: DataFrame, least_delta: float = 0.02, most_p: float = 0.05, most_std: float = 0.10) -> DataFrame:
    return comparison.withColumn("accepted", (F.col("mean_delta") >= least_delta) & (F.col("p_value") < most_p) & (F.col("std_delta") < most_std))
