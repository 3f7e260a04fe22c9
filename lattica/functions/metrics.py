"""Evaluation metrics as aggregates over predictions.

Predictions have ``y_true`` and ``y_pred`` (whole numbers, null: unlabelled, left out), for some metrics ``proba array<double>``. Every function takes
the columns to group by and returns one row per group. Counts are aggregated first; what follows works on one row per class or pair of classes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lattica.functions.ranks import quantile_bucket

D = "double"


def labelled(df: DataFrame) -> DataFrame:
    return df.filter("y_true IS NOT NULL AND y_pred IS NOT NULL")


def hit() -> Column:
    return F.when(F.col("y_true") == F.col("y_pred"), 1.0).otherwise(0.0)


def accuracy(df: DataFrame, by: list[str]) -> DataFrame:
    return labelled(df).groupBy(*by).agg(F.avg(hit()).alias("accuracy"))


def confusion(df: DataFrame, by: list[str] = ()) -> DataFrame:
    """(by, y_true, y_pred, n)."""
    return labelled(df).groupBy(*by, "y_true", "y_pred").agg(F.count("*").alias("n"))


def confusion_matrix(df: DataFrame, classes: list[int]) -> DataFrame:
    """A row per true class and a column per predicted one."""
    return labelled(df).groupBy("y_true").pivot("y_pred", classes).agg(F.count(F.lit(1))).na.fill(0)


def _on(a: DataFrame, b: DataFrame, by: list[str], *more):
    cond = [a[c].eqNullSafe(b[f"_{c}"]) for c in by] + list(more)
    return cond or F.lit(True)


def per_class(df: DataFrame, by: list[str]) -> DataFrame:
    """(by, cls, tp, fp, fn) over the classes in y_true or y_pred: each row counts once for either side, in one aggregate."""
    cells = confusion(df, by)
    sides = F.array(F.struct(F.col("y_true").alias("cls"), F.when(F.col("y_true") == F.col("y_pred"), F.col("n")).otherwise(0).alias("tp"), F.lit(0).cast("long").alias("fp"), F.when(F.col("y_true") != F.col("y_pred"), F.col("n")).otherwise(0).alias("fn")),
                    F.struct(F.col("y_pred").alias("cls"), F.lit(0).cast("long").alias("tp"), F.when(F.col("y_true") != F.col("y_pred"), F.col("n")).otherwise(0).alias("fp"), F.lit(0).cast("long").alias("fn")))
    return cells.select(*by, F.explode(sides).alias("s")).groupBy(*by, "s.cls").agg(*[F.sum(f"s.{k}").alias(k) for k in ("tp", "fp", "fn")])


def kappa(df: DataFrame, by: list[str]) -> DataFrame:
    """Cohen's kappa; 0 where chance agreement is complete."""
    c = per_class(df, by)
    t, p = F.col("tp") + F.col("fn"), F.col("tp") + F.col("fp")
    g = c.groupBy(*by).agg(F.sum("tp").cast(D).alias("hits"), F.sum(t).cast(D).alias("n"), F.sum(t.cast(D) * p.cast(D)).alias("chance"))
    po, pe = F.col("hits") / F.col("n"), F.col("chance") / (F.col("n") * F.col("n"))
    return g.select(*by, F.when(pe == 1.0, 0.0).otherwise((po - pe) / (1.0 - pe)).alias("kappa"))


def f1_macro(df: DataFrame, by: list[str]) -> DataFrame:
    c = per_class(df, by)
    f1 = F.coalesce(2.0 * F.col("tp") / F.nullif(2 * F.col("tp") + F.col("fp") + F.col("fn"), F.lit(0)), F.lit(0.0))
    return c.groupBy(*by).agg(F.avg(f1).alias("f1_macro"))


def balanced_accuracy(df: DataFrame, by: list[str]) -> DataFrame:
    """Mean recall over the classes in y_true."""
    c = per_class(df, by).filter("tp + fn > 0")
    return c.groupBy(*by).agg(F.avg(F.col("tp").cast(D) / (F.col("tp") + F.col("fn"))).alias("balanced_accuracy"))


def class_scores(df: DataFrame, by: list[str]) -> DataFrame:
    """(by, cls, score, pos, neg): how many rows of the class and of others have each score for it."""
    long = df.filter("y_true IS NOT NULL").select(*by, "y_true", F.posexplode("proba").alias("cls", "score"))
    pos = F.when(F.col("y_true") == F.col("cls"), 1).otherwise(0)
    return long.groupBy(*by, "cls", "score").agg(F.sum(pos).alias("pos"), F.sum(1 - pos).alias("neg"))


def counted_below(s: DataFrame, keys: list[str], score: str, *counts: str) -> DataFrame:
    """s, a row for each score within ``keys``, with ``<count>_below`` and ``<count>_all``: sums over lower scores, and over all, of the same keys.

    A sum is that of lower buckets (cut at quantiles, summed over one row a bucket) plus that of lower scores of the own bucket, so no family is sorted in one task."""
    s = s.withColumn("_b", quantile_bucket(s, score))
    family = W.partitionBy(*keys) if keys else W.partitionBy(F.lit(0))  # rows here are buckets
    below = s.groupBy(*keys, "_b").agg(*[F.sum(c).alias(f"_n_{c}") for c in counts])
    below = below.select(
        *[F.col(c).alias(f"_k_{c}") for c in [*keys, "_b"]],
        *[(F.sum(f"_n_{c}").over(family.orderBy("_b")) - F.col(f"_n_{c}")).alias(f"_w_{c}") for c in counts], *[F.sum(f"_n_{c}").over(family).alias(f"{c}_all") for c in counts],
    )
    inner = W.partitionBy(*keys, "_b").orderBy(score).rowsBetween(W.unboundedPreceding, -1)
    s = s.select("*", *[F.coalesce(F.sum(c).over(inner), F.lit(0)).alias(f"_i_{c}") for c in counts])
    s = s.join(below, [s[c].eqNullSafe(below[f"_k_{c}"]) for c in [*keys, "_b"]])
    s = s.select("*", *[(F.col(f"_w_{c}") + F.col(f"_i_{c}")).alias(f"{c}_below") for c in counts])
    return s.drop("_b", *[f"_k_{c}" for c in [*keys, "_b"]], *[f"_{k}_{c}" for c in counts for k in "wi"])


def auc_by_class(df: DataFrame, by: list[str]) -> DataFrame:
    """(by, cls, auc, pos, neg) by rank sums with mid-ranks for ties; equal scores are counted first. auc is null for a class without positives or without negatives."""
    keys = [*by, "cls"]
    s = counted_below(class_scores(df, by), keys, "score", "neg")
    wins = F.col("pos") * (F.col("neg_below") + F.col("neg") / 2.0)
    g = s.groupBy(*keys).agg(F.sum(wins).alias("wins"), F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    return g.select(*keys, (F.col("wins") / F.nullif(F.col("pos").cast(D) * F.col("neg").cast(D), F.lit(0.0))).alias("auc"), "pos", "neg")


def roc_auc_macro(df: DataFrame, by: list[str]) -> DataFrame:
    """One class against the rest, averaged over classes that have both; 0 where none has."""
    return auc_by_class(df, by).groupBy(*by).agg(F.coalesce(F.avg("auc"), F.lit(0.0)).alias("roc_auc_macro"))


def itr_bits_per_trial(p: Column, k: int) -> Column:
    """Wolpaw's rate; 0 for no hits, log2 k for all. Positive below chance, as published."""
    p = p.cast(D)
    rest = F.log2(F.lit(float(k))) + p * F.log2(p) + (1.0 - p) * F.log2((1.0 - p) / F.lit(float(k - 1)))
    return F.when(p <= 0, 0.0).when(p >= 1, F.log2(F.lit(float(k)))).otherwise(rest)


def itr_bits_per_minute(p: Column, k: int, seconds: float) -> Column:
    return itr_bits_per_trial(p, k) * F.lit(60.0 / seconds) if seconds > 0 else F.lit(0.0)


def mutual_information(df: DataFrame, by: list[str], x: str, y: str) -> DataFrame:
    """In nats, of two discrete columns."""
    c = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(*by, x, y).agg(F.count("*").cast(D).alias("n"))
    over = lambda *cols: F.sum("n").over(W.partitionBy(*by, *cols) if by or cols else W.partitionBy(F.lit(0)))  # noqa: E731  one row a pair of values
    c = c.withColumn("nx", over(x)).withColumn("ny", over(y)).withColumn("t", over())
    return c.groupBy(*by).agg(F.sum(F.col("n") / F.col("t") * F.log(F.col("n") * F.col("t") / (F.col("nx") * F.col("ny")))).alias("mutual_information"))


def confidence(df: DataFrame, by: list[str]) -> DataFrame:
    return df.groupBy(*by).agg(F.avg(F.array_max("proba")).alias("confidence"))


def argmax(values: Column) -> Column:
    """0-based index of the largest value, the first of equals."""
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")


def all_metrics(df: DataFrame, by: list[str], classes: int, seconds: float) -> DataFrame:
    """Eight metrics, one row per group."""
    out = accuracy(df, by).withColumn("itr_bits_per_trial", itr_bits_per_trial(F.col("accuracy"), classes)).withColumn("itr_bits_per_minute", itr_bits_per_minute(F.col("accuracy"), classes, seconds))
    for part in (kappa(df, by), f1_macro(df, by), balanced_accuracy(df, by), roc_auc_macro(df, by), mutual_information(df, by, "y_true", "y_pred")):
        out = out.join(part, by)
    return out


def screening_metric(df: DataFrame, by: list[str], which: str) -> DataFrame:
    return {"accuracy": accuracy, "balanced_accuracy": balanced_accuracy, "kappa": kappa}[which](df, by)
