"""Summaries over subjects, folds and latencies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def summary(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """(n, mean, std): population deviation, nulls left out."""
    return df.groupBy(*by).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.coalesce(F.stddev_pop(value), F.lit(0.0)).alias("std"))


def stability_report(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """(mean, std, cv, var): cv is 0 where the mean is."""
    g = df.groupBy(*by).agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), F.var_pop(value).alias("var"))
    return g.withColumn("cv", F.when(F.col("mean") == 0, 0.0).otherwise(F.col("std") / F.nullif(F.col("mean"), F.lit(0.0))))


def latency_stats(df: DataFrame, by: list[str], value: str, budget: float | None = None) -> DataFrame:
    """(n, mean, p50, p95, p99, max), exact percentiles with linear interpolation; over_budget where p95 or the mean is above the budget."""
    g = df.groupBy(*by).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), *[F.percentile(value, p).alias(f"p{int(100 * p)}") for p in (0.5, 0.95, 0.99)], F.max(value).alias("max"))
    return g if budget is None else g.withColumn("over_budget", (F.col("p95") > budget) | (F.col("mean") > budget))


def engine_latency(df: DataFrame, value: str) -> DataFrame:
    """One row (mean, median, max, min), zeros for an empty table."""
    z = lambda c: F.coalesce(c, F.lit(0.0))
    return df.agg(z(F.avg(value)).alias("mean"), z(F.median(value)).alias("median"), z(F.max(value)).alias("max"), z(F.min(value)).alias("min"))


def correction_accuracy(df: DataFrame, predicted: str, corrected: str) -> DataFrame:
    """Share of corrected rows whose prediction stands; null without any."""
    rows = df.filter(F.col(corrected).isNotNull())
    return rows.agg(F.avg(F.when(F.col(predicted) == F.col(corrected), 1.0).otherwise(0.0)).alias("correction_accuracy"), F.count("*").alias("n"))


def ablation(df: DataFrame, method: str, subject: str, value: str, reference: str, order: list[str]) -> DataFrame:
    """(pos, method, n, mean, std_sample, mean_delta, cohens_d) in a fixed order of methods, deltas paired with the reference by subject."""
    # A window over a subject's rows, not a join of two reads: means summed twice in another order would differ from themselves, and noise over noise is an effect.
    held = F.collect_list(F.when(F.col(method) == reference, F.struct(F.col(value).alias("v")))).over(W.partitionBy(subject))
    j = df.withColumn("_refs", F.when(F.col(subject).isNotNull(), held)).select("*", F.explode_outer("_refs").alias("_r")).withColumn("_d", F.col(value) - F.col("_r.v"))
    g = j.groupBy(method).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std_sample"), F.avg("_d").alias("mean_delta"), F.stddev_pop("_d").alias("_s"))
    pos = F.coalesce(F.array_position(F.array(*[F.lit(m) for m in order]), F.col(method)), F.lit(0))
    return g.withColumn("cohens_d", F.when(F.col("_s") > 0, F.col("mean_delta") / F.col("_s")).otherwise(0.0)).withColumn("pos", pos).drop("_s")


def subject_counts(df: DataFrame, subject: str, label: str) -> DataFrame:
    return df.filter(F.col(label).isNotNull()).groupBy(subject, label).agg(F.count("*").alias("n"))


def channel_name(name: Column, index: Column) -> Column:
    return F.coalesce(name, F.concat(F.lit("EEG"), index.cast("string")))


def config_hash(*columns: Column) -> Column:
    """16 hex digits of the SHA-256 of the columns as JSON."""
    return F.substring(F.sha2(F.to_json(F.struct(*columns)), 256), 1, 16)
