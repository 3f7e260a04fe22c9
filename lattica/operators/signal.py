"""Signal operators on long-form samples (subject_id, trial_id, channel, sample_idx, value), in SQL expressions only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

TRIAL = ["subject_id", "trial_id"]


def to_samples(trials: DataFrame, signal: str = "signal") -> DataFrame:
    """Long form of trials whose signal is array<array<double>> [channel][sample]."""
    keep = [c for c in trials.columns if c != signal]
    c = trials.select(*keep, F.posexplode(signal).alias("channel", "_x"))
    return c.select(*keep, "channel", F.posexplode("_x").alias("sample_idx", "value"))


def to_trials(samples: DataFrame) -> DataFrame:
    """Back to one row a trial; rows of a trial are bounded by the trial's size."""
    c = samples.groupBy(*TRIAL, "channel").agg(F.transform(F.array_sort(F.collect_list(F.struct("sample_idx", "value"))), lambda s: s["value"]).alias("_x"))
    return c.groupBy(*TRIAL).agg(F.transform(F.array_sort(F.collect_list(F.struct("channel", "_x"))), lambda s: s["_x"]).alias("signal"))


def drop_unlabelled(df: DataFrame, label: str = "label") -> DataFrame:
    return df.filter(F.col(label).isNotNull())


def car(samples: DataFrame) -> DataFrame:
    """Common average reference: less the mean of all channels at the sample."""
    mean = F.avg("value").over(W.partitionBy(*TRIAL, "sample_idx"))
    return samples.withColumn("value", F.col("value") - mean)


def laplacian(samples: DataFrame, neighbours: DataFrame) -> DataFrame:
    """Less the mean of the neighbours at the sample; channels without neighbours get the common average.

    neighbours (channel, neighbour) is a montage. Channels of a sample meet as one array in a window over the sample, so there is no self-join of samples."""
    pairs = neighbours.groupBy("channel").agg(F.sort_array(F.collect_set("neighbour")).alias("_near"))
    w = W.partitionBy(*TRIAL, "sample_idx")
    s = samples.withColumn("_all", F.map_from_entries(F.collect_list(F.struct("channel", "value")).over(w))).withColumn("_car", F.avg("value").over(w))
    s = s.join(F.broadcast(pairs) if pairs.count() <= 10_000 else pairs, "channel", "left")
    near = F.filter(F.transform("_near", lambda c: F.try_element_at("_all", c)), lambda v: v.isNotNull())
    mean = F.aggregate(near, F.lit(0.0), lambda a, v: a + v) / F.nullif(F.size(near), F.lit(0))
    return s.withColumn("value", F.col("value") - F.coalesce(F.when(F.col("_near").isNotNull(), mean), F.col("_car"))).select(*samples.columns)


def channel_baseline(samples: DataFrame) -> DataFrame:
    """(channel, base): population standard deviation over all trials."""
    return samples.groupBy("channel").agg(F.stddev_pop("value").alias("base"))


def asr(samples: DataFrame, baseline: DataFrame, tile: int, limit: float = 20.0) -> DataFrame:
    """Tiles whose deviation is above ``limit`` times the channel's baseline are scaled down to it. The last tile may be short."""
    s = samples.join(F.broadcast(baseline) if baseline.count() <= 100_000 else baseline, "channel").withColumn("_tile", F.floor(F.col("sample_idx") / tile))
    sd = F.stddev_pop("value").over(W.partitionBy(*TRIAL, "channel", "_tile"))
    top = F.col("base") * limit
    return s.withColumn("_sd", sd).withColumn("value", F.when(F.col("_sd") > top, F.col("value") * top / F.col("_sd")).otherwise(F.col("value"))).select(*samples.columns)


def quality_statistics(samples: DataFrame) -> DataFrame:
    """(trial, channel, var, kurt) per trial and channel: population variance and excess kurtosis."""
    return samples.groupBy(*TRIAL, "channel").agg(F.var_pop("value").alias("var"), F.coalesce(F.kurtosis("value"), F.lit(0.0)).alias("kurt"))


def signal_quality(samples: DataFrame, limit: float = 5.0) -> DataFrame:
    """(trial, channel, var, kurt, bad): bad where either is more than ``limit`` deviations above the channel's mean over trials; quiet channels stay."""
    st = quality_statistics(samples)
    m = st.groupBy("channel").agg(*[f(k).alias(f"{n}_{k}") for k in ("var", "kurt") for n, f in (("m", F.avg), ("s", F.stddev_pop))])
    j = st.join(F.broadcast(m) if m.count() <= 100_000 else m, "channel")
    z = lambda k: (F.col(k) - F.col(f"m_{k}")) / (F.col(f"s_{k}") + 1e-9) > limit
    return j.select(*TRIAL, "channel", "var", "kurt", (z("var") | z("kurt")).alias("bad"))


def repair(samples: DataFrame, limit: float = 5.0) -> DataFrame:
    """Bad channels become the mean of the trial's other channels."""
    q = signal_quality(samples, limit).select(*TRIAL, "channel", "bad")
    w = W.partitionBy(*TRIAL, "sample_idx")
    s = samples.join(q, [*TRIAL, "channel"])
    rest = (F.sum("value").over(w) - F.col("value")) / F.nullif(F.count("*").over(w) - 1, F.lit(0))
    return s.withColumn("_rest", rest).withColumn("value", F.when(F.col("bad"), F.coalesce("_rest", "value")).otherwise(F.col("value"))).select(*samples.columns)


def standardise(samples: DataFrame, by: list[str] = ("subject_id", "channel"), eps: float = 1e-8) -> DataFrame:
    """z-scores over all samples of a subject's channel. The statistics are a small aggregate joined back, not a window over a subject's rows."""
    st = samples.groupBy(*by).agg(F.avg("value").alias("_m"), F.stddev_pop("value").alias("_s"))
    return samples.join(st, list(by)).withColumn("value", (F.col("value") - F.col("_m")) / (F.col("_s") + eps)).select(*samples.columns)


def mean_std(samples: DataFrame) -> DataFrame:
    """(trial, channel, mean, std) as a deep placeholder takes them."""
    return samples.groupBy(*TRIAL, "channel").agg(F.avg("value").alias("mean"), (F.stddev_pop("value") + 1e-10).alias("std"))


def covariance_upper(samples: DataFrame) -> DataFrame:
    """(trial, i, j, cov) for channels i <= j, sample covariance. Sums of products from one array per sample; no self-join."""
    at = samples.groupBy(*TRIAL, "sample_idx").agg(F.array_sort(F.collect_list(F.struct("channel", "value"))).alias("v"))
    pairs = F.flatten(F.transform("v", lambda a: F.transform(F.filter("v", lambda b: b["channel"] >= a["channel"]), lambda b: F.struct(a["channel"].alias("i"), b["channel"].alias("j"), a["value"].alias("x"), b["value"].alias("y")))))
    return at.select(*TRIAL, F.explode(pairs).alias("p")).groupBy(*TRIAL, "p.i", "p.j").agg(F.covar_samp("p.x", "p.y").alias("cov"))


def psd_dft(samples: DataFrame, n: int, low: int, high: int) -> DataFrame:
    """(trial, channel, k, power) of the first n samples at whole frequencies k: sums of sines and cosines."""
    s = samples.filter(F.col("sample_idx") < n).select(*TRIAL, "channel", "sample_idx", "value", F.explode(F.sequence(F.lit(low), F.lit(high))).alias("k"))
    angle = F.lit(2 * 3.141592653589793) * F.col("k") * F.col("sample_idx") / float(n)
    g = s.groupBy(*TRIAL, "channel", "k").agg(F.sum(F.col("value") * F.cos(angle)).alias("re"), F.sum(F.col("value") * F.sin(angle)).alias("im"))
    return g.select(*TRIAL, "channel", "k", (F.col("re") ** 2 + F.col("im") ** 2).alias("power"))


def temporal_features(samples: DataFrame, tiles: int, length: int) -> DataFrame:
    """(trial, channel, tile, log_var, mobility): log variance and Hjorth mobility of equal tiles, by differences to the sample before."""
    w = W.partitionBy(*TRIAL, "channel").orderBy("sample_idx")
    s = samples.withColumn("_d", F.col("value") - F.lag("value").over(w)).withColumn("tile", F.floor(F.col("sample_idx") * tiles / length).cast("int"))
    g = s.groupBy(*TRIAL, "channel", "tile").agg(F.var_pop("value").alias("v"), F.var_pop("_d").alias("dv"))
    return g.select(*TRIAL, "channel", "tile", F.log(F.col("v") + 1e-10).alias("log_var"), F.sqrt(F.col("dv") / (F.col("v") + 1e-12)).alias("mobility"))
