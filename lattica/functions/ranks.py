"""Ranks and running sums over whole tables without a single-task sort.

A rank is the number of rows in lower buckets (one row a bucket, summed over a small table) plus the rank inside the own bucket, so
the largest sort is that of a bucket, not of the table or of a hot group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

BUCKETS = 1024


def quantile_bucket(df: DataFrame, column: str, buckets: int = BUCKETS) -> Column:
    """An expression that numbers a number's bucket, in order: about as many rows in each, whatever the distribution; rows with equal numbers share one. A bounded number of borders goes to the driver."""
    bounds = df.agg(F.percentile_approx(F.col(column).cast("double"), [i / buckets for i in range(1, buckets)], 10 * buckets)).first()[0]
    bounds = sorted(set(bounds or []))
    step = max(1, int(len(bounds) ** 0.5))
    x = F.col(column).cast("double")
    upto = lambda held: F.array_size(F.filter(held, lambda b: b <= x))
    array = lambda held: F.array(*[F.lit(b) for b in held])
    if not bounds:
        return F.lit(0)
    coarse = upto(array(bounds[step - 1 :: step]))
    return coarse * step + upto(F.slice(array(bounds), coarse * step + 1, step))


def seeded(seed: int, *ids: str) -> Column:
    """A reproducible order key: the MD5 of ``seed:id[:id...]``."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(c).cast("string") for c in ids]))


def _with_rank(df: DataFrame, by: list[str], bucket: Column, order: list, name: str, total: str | None) -> DataFrame:
    rows = df.withColumn("_bucket", bucket)
    sizes = rows.groupBy(*by, "_bucket").agg(F.count("*").alias("_size"))
    family = W.partitionBy(*by) if by else W.partitionBy(F.lit(0))  # rows here are buckets
    sizes = sizes.withColumn("_before", F.sum("_size").over(family.orderBy("_bucket")) - F.col("_size"))
    if total:
        sizes = sizes.withColumn(total, F.sum("_size").over(family))
    keys = [*by, "_bucket"]
    held = sizes.drop("_size").select(*[F.col(c).alias(f"_k_{c}") for c in keys], "_before", *([total] if total else []))
    on = [rows[c].eqNullSafe(held[f"_k_{c}"]) for c in keys]
    inner = F.row_number().over(W.partitionBy(*by, "_bucket").orderBy(*order))
    return rows.withColumn("_inner", inner).join(held, on).withColumn(name, F.col("_before") + F.col("_inner")).drop(*[f"_k_{c}" for c in keys], "_bucket", "_before", "_inner")


def hash_rank(df: DataFrame, key: str, name: str, by: list[str] = (), total: str | None = None) -> DataFrame:
    """1-based rank by a hex key within ``by``; ``total`` names a column for the size of the group. Buckets are the key's first three digits."""
    return _with_rank(df, list(by), F.substring(key, 1, 3), [key], name, total)


def value_rank(df: DataFrame, column: str, name: str, by: list[str] = (), ties: list[str] = (), total: str | None = None, ascending: bool = True) -> DataFrame:
    """1-based rank by a number within ``by``; ``ties`` decide between equal numbers. Buckets are cut at quantiles."""
    bucket, key = quantile_bucket(df, column), F.col(column)
    if not ascending:
        bucket, key = -bucket, key.desc()
    return _with_rank(df, list(by), bucket, [key, *ties], name, total)
