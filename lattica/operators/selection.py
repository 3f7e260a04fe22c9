"""Choosing among pipelines: specs, grids, pruning, ranking, and the relational helpers around them. Everything is SQL over ``pipeline_metrics``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

SPEC_SCHEMA = "pipeline string, feature string, classifier string, spatial string, adapter string, params map<string,string>"

#: Pipelines that are tried first, (feature, classifier).
PRIORITY = (("csp", "lda"), ("riemann_tangent", "logistic"), ("covariance", "mdm"), ("filter_bank_riemann", "logistic"))


def pipeline_name(feature: Column, classifier: Column, spatial: Column | None = None, advanced: Column | None = None) -> Column:
    """``baseline[_spatial][_advanced]_feature_classifier``; null parts are left out."""
    return F.concat_ws("_", F.lit("baseline"), spatial if spatial is not None else F.lit(None), advanced if advanced is not None else F.lit(None), feature, classifier)


def parse_spec(parts: list[str]) -> dict:
    """[feature, classifier], or the older [steps..., feature, classifier]."""
    if len(parts) < 2:
        raise ValueError("a spec needs a feature and a classifier")
    return {"steps": list(parts[:-2]), "feature": parts[-2], "classifier": parts[-1]}


def pipeline_grid(spark: SparkSession, features: list[str], classifiers: list[str], spatial: list[str | None] = (None,), most: int = 20) -> DataFrame:
    """Priority specs first, then the grid in order, each once, ``most`` at most: (pos, pipeline, feature, classifier, spatial)."""
    table = lambda name, values: spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i_{name} int, {name} string")
    grid = table("feature", features).crossJoin(table("classifier", classifiers)).crossJoin(table("spatial", list(spatial)))
    first = spark.createDataFrame([(k, a, b) for k, (a, b) in enumerate(PRIORITY)], "k int, feature string, classifier string")
    ranked = grid.join(F.broadcast(first), ["feature", "classifier"], "left")
    order = W.partitionBy(F.lit(0)).orderBy(F.coalesce("k", F.lit(1 << 20)), "i_feature", "i_classifier", "i_spatial")  # a grid of specs
    out = ranked.withColumn("pipeline", pipeline_name(F.col("feature"), F.col("classifier"), F.col("spatial"))).withColumn("pos", F.row_number().over(order))
    return out.filter(F.col("pos") <= most).select("pos", "pipeline", "feature", "classifier", "spatial")


def parameter_grid(spark: SparkSession, grid: dict[str, list]) -> DataFrame:
    """A row per combination, one string column a parameter."""
    out = spark.range(1).select()
    for name, values in grid.items():
        out = out.crossJoin(spark.createDataFrame([(str(v),) for v in values], f"`{name}` string"))
    return out


def distinct_first(df: DataFrame, value: str, pos: str) -> DataFrame:
    """Duplicates go; the first by position stays."""
    return df.withColumn("_r", F.row_number().over(W.partitionBy(value).orderBy(pos))).filter("_r = 1").drop("_r")


def linear_model(classifier: Column, kernel: Column | None = None) -> Column:
    svm = (classifier == "svm") & (kernel == "linear") if kernel is not None else F.lit(False)
    return F.coalesce((classifier == "lda") | svm, F.lit(False))


def ranking_accuracy() -> Column:
    return F.coalesce(F.col("cv_accuracy"), F.col("accuracy"))


#: The weights of the parts.
def composite(overfit_weight: float = 0.5) -> Column:
    """max(0, .4 accuracy + .3 kappa + .2 stability - .1 latency in seconds - w max(0, train - cv))."""
    gap = F.greatest(F.lit(0.0), F.col("train_accuracy") - F.coalesce("cv_accuracy", "train_accuracy"))
    s = 0.4 * ranking_accuracy() + 0.3 * F.col("kappa") + 0.2 * F.col("stability") - 0.1 * F.col("latency_ms") / 1000.0 - overfit_weight * F.coalesce(gap, F.lit(0.0))
    return F.greatest(F.lit(0.0), s)


def prune(specs: DataFrame, metrics: DataFrame, least_accuracy: float, most_latency_ms: float, most_instability: float) -> DataFrame:
    """Specs that pass the thresholds; specs without metrics stay."""
    m = metrics.withColumn("_m", F.lit(True))
    ok = (F.col("accuracy") >= least_accuracy) & (F.col("latency_ms") <= most_latency_ms) & (1 - F.col("stability") <= most_instability)
    return specs.join(m, "pipeline", "left").filter(F.col("_m").isNull() | F.coalesce(ok, F.lit(False))).drop("_m")


def valid(metrics: DataFrame) -> DataFrame:
    return metrics.filter(~F.coalesce("failed", F.lit(False)) & F.col("accuracy").isNotNull())


def top_n(metrics: DataFrame, n: int, linear: Column | None = None, overfit_weight: float = 0.5) -> DataFrame:
    """The n best by composite score; ties: linear models first, then lower latency, then name."""
    s = valid(metrics).withColumn("score", composite(overfit_weight)).withColumn("_l", (linear if linear is not None else F.lit(False)).cast("int"))
    return s.orderBy(F.col("score").desc(), F.col("_l").desc(), "latency_ms", "pipeline").limit(n).drop("_l")


def best(metrics: DataFrame) -> DataFrame:
    """One row: the pipeline of highest ranking accuracy, the first by name of equals."""
    return valid(metrics).orderBy(ranking_accuracy().desc(), "pipeline").limit(1)


def family(name: Column) -> Column:
    low = F.lower(name)
    return F.when(low.contains("filter_bank") | low.contains("fbr"), "filter_bank_riemann").when(low.contains("mdm"), "mdm").when(low.contains("riemann") | low.contains("tangent"), "riemann").when(low.contains("csp"), "csp").otherwise("other")


def best_per_family(metrics: DataFrame) -> DataFrame:
    f = valid(metrics).withColumn("family", family(F.col("pipeline")))
    g = f.groupBy("family").agg(F.min(F.struct((-ranking_accuracy()).alias("a"), F.col("pipeline").alias("p"))).alias("b"))
    return g.select("family", F.col("b.p").alias("pipeline"), (-F.col("b.a")).alias("accuracy"))


def leaderboard(metrics: DataFrame, by: str, n: int, pruned: DataFrame | None = None, selected: str | None = None) -> DataFrame:
    """The n best by any column, with rank and flags. Top-n before any sort of the rest."""
    top = metrics.orderBy(F.col(by).desc_nulls_last(), "pipeline").limit(n)
    top = top.withColumn("rank", F.row_number().over(W.partitionBy(F.lit(0)).orderBy(F.col(by).desc_nulls_last(), "pipeline")))  # n rows
    if pruned is not None:
        top = top.join(pruned.select("pipeline", F.lit(True).alias("pruned")), "pipeline", "left").withColumn("pruned", F.coalesce("pruned", F.lit(False)))
    return top.withColumn("selected", F.col("pipeline").eqNullSafe(F.lit(selected)))


def screening_keep(n: int, least: int = 3, most: int = 10, share: float = 0.5) -> int:
    return min(most, max(least, int(share * n)))


def screened(metrics: DataFrame, score: str, keep: int) -> DataFrame:
    return metrics.withColumn("_r", F.rank().over(W.partitionBy(F.lit(0)).orderBy(F.col(score).desc(), "pipeline"))).filter(F.col("_r") <= keep).drop("_r")  # one row a pipeline


def rank_correlation(a: DataFrame, b: DataFrame, key: str, score: str) -> DataFrame:
    """Spearman's correlation of two rankings of the same few items."""
    r = lambda d, n: d.select(key, F.row_number().over(W.partitionBy(F.lit(0)).orderBy(F.col(score).desc(), key)).alias(n))
    return r(a, "_a").join(r(b, "_b"), key).agg(F.corr("_a", "_b").alias("rank_correlation"), F.count("*").alias("n"))


def condition_pairs(df: DataFrame, name: str) -> DataFrame:
    """(a, b) for every pair of conditions, a before b: a theta join of a small dimension."""
    return df.select(F.col(name).alias("a")).distinct().join(df.select(F.col(name).alias("b")).distinct(), F.col("a") < F.col("b"))


def metric_projection(df: DataFrame, metrics: str, names: list[str], key: str = "subject_id") -> DataFrame:
    """Known metrics of a map column as columns, null where missing; rows without a key go."""
    return df.filter(F.col(key).isNotNull()).select(key, *[F.try_element_at(metrics, F.lit(n)).cast("double").alias(n) for n in names])


def halving_rounds(n: int, keep: int) -> list[int]:
    """How many pipelines each round of progressive halving keeps."""
    out = []
    while n > keep:
        n = max(keep, n // 2)
        out.append(n)
    return out


def early_stop(scores: list[float], folds: int, best_so_far: float) -> bool:
    """Whether even perfect remaining folds can't reach the best complete mean."""
    return (sum(scores) + folds - len(scores)) / folds < best_so_far
