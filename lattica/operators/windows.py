"""Windows over sample arrays and over rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def step_of(window: int, overlap: float) -> int:
    return max(1, int(window * (1 - overlap)))


def seconds_step(fs: float, window_s: float, overlap_s: float) -> tuple[int, int]:
    """(window, step) in samples; the overlap is in seconds."""
    return int(fs * window_s), max(1, int(fs * (window_s - overlap_s)))


def sliding(df: DataFrame, signal: str, window: int, overlap: float = 0.5, step: int | None = None) -> DataFrame:
    """A row per full window: adds start, stop and window (a slice of the array); shorter arrays give none."""
    step = step or step_of(window, overlap)
    n = F.size(signal)
    starts = F.when(n >= window, F.transform(F.sequence(F.lit(0), F.floor((n - window) / step).cast("int")), lambda i: i * step)).otherwise(F.array().cast("array<int>"))
    return df.withColumn("start", F.explode(starts)).withColumn("stop", F.col("start") + window).withColumn("window", F.slice(signal, F.col("start") + 1, window))


def multichannel(df: DataFrame, signal: str, window: int, overlap: float = 0.5) -> DataFrame:
    """The same for signal[channel][sample]: window[channel] are slices."""
    step = step_of(window, overlap)
    n = F.size(F.col(signal)[0])
    starts = F.when(n >= window, F.transform(F.sequence(F.lit(0), F.floor((n - window) / step).cast("int")), lambda i: i * step)).otherwise(F.array().cast("array<int>"))
    rows = df.withColumn("start", F.explode(starts)).withColumn("stop", F.col("start") + window)
    return rows.withColumn("window", F.transform(signal, lambda c: F.slice(c, F.col("start") + 1, window)))


def tile(index: Column, width: int) -> Column:
    return F.floor(index / width).cast("long")


def full_tiles(df: DataFrame, by: list[str], index: str, width: int) -> DataFrame:
    """(by, tile, n, first, last) of tiles with all their samples."""
    g = df.withColumn("tile", tile(F.col(index), width)).groupBy(*by, "tile").agg(F.count("*").alias("n"), F.min(index).alias("first"), F.max(index).alias("last"))
    return g.filter(F.col("n") == width)


def edges(df: DataFrame, by: list[str], order: str, code: str, wanted: list) -> DataFrame:
    """Rows where a trigger begins: the code is wanted and differs from the one before."""
    prev = F.lag(code).over(W.partitionBy(*by).orderBy(order))
    return df.withColumn("_prev", prev).filter(F.col(code).isin(wanted) & (F.col("_prev").isNull() | (F.col("_prev") != F.col(code)))).drop("_prev")


def segments(events: DataFrame, samples: DataFrame, by: list[str], start: str, index: str, n: int, tile_width: int | None = None) -> DataFrame:
    """Samples within n of an event: a range join by tiles. Each event is copied to the tiles that its segment meets (two or so), and rows meet on
    equal tiles, so no sample is compared with far events. Adds offset, the sample's place in the segment."""
    w = tile_width or max(1, n)
    e = events.withColumn("_tile", F.explode(F.sequence(F.floor(F.col(start) / w), F.floor((F.col(start) + n - 1) / w))))
    s = samples.withColumn("_tile", F.floor(F.col(index) / w))
    return e.join(s, [*by, "_tile"]).filter((F.col(index) >= F.col(start)) & (F.col(index) < F.col(start) + n)).withColumn("offset", F.col(index) - F.col(start)).drop("_tile")


def rolling(df: DataFrame, by: list[str], order: list[str], value: Column, k: int, at_least: int, name: str) -> DataFrame:
    """Mean of the last k values in order, null before ``at_least`` of them."""
    w = W.partitionBy(*by).orderBy(*order).rowsBetween(-(k - 1), 0)
    return df.withColumn(name, F.when(F.count(F.lit(1)).over(w) >= at_least, F.avg(value).over(w)))


def low_run(df: DataFrame, by: list[str], order: list[str], value: str, m: int, floor: float, name: str) -> DataFrame:
    """Whether the last m values exist and are all below ``floor``."""
    w = W.partitionBy(*by).orderBy(*order).rowsBetween(-(m - 1), 0)
    return df.withColumn(name, F.coalesce((F.count(value).over(w) == m) & (F.max(value).over(w) < floor), F.lit(False)))


def newest(df: DataFrame, by: list[str], order: list[str], n: int) -> DataFrame:
    """The newest n rows of each group; none of a group that has fewer."""
    w = W.partitionBy(*by)
    r = df.withColumn("_r", F.row_number().over(w.orderBy(*[F.col(c).desc() for c in order]))).withColumn("_n", F.count(F.lit(1)).over(w))
    return r.filter((F.col("_r") <= n) & (F.col("_n") >= n)).drop("_r", "_n")


def latest(df: DataFrame, by: list[str], order: list[str], n: int) -> DataFrame:
    """At most the newest n rows of each group. The rank limit is applied before the shuffle too."""
    w = W.partitionBy(*by).orderBy(*[F.col(c).desc() for c in order])
    return df.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= n).drop("_r")


def chunk_stability(df: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """(by, n_chunks, stability): 1 less the population variance of chunk accuracies. Chunks of max(5, n // 5) rows whose start is below n - size."""
    w = W.partitionBy(*by)
    r = df.withColumn("_i", F.row_number().over(w.orderBy(*order)) - 1).withColumn("_n", F.count(F.lit(1)).over(w))
    size = F.greatest(F.lit(5), F.floor(F.col("_n") / 5))
    r = r.withColumn("_c", F.floor(F.col("_i") / size)).filter(F.col("_c") * size < F.col("_n") - size)
    c = r.groupBy(*by, "_c").agg(F.avg(F.when(F.col("y_true") == F.col("y_pred"), 1.0).otherwise(0.0)).alias("_a"))
    return c.groupBy(*by).agg(F.count("*").alias("n_chunks"), (1.0 - F.coalesce(F.var_pop("_a"), F.lit(0.0))).alias("stability"))
