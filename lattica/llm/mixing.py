"""Mixing sources to target weights by hierarchical budgeting, in DataFrame expressions only.

Leaves of a tree (domain, language, source) have a supply of tokens, times the epochs allowed. A budget goes down the tree: each node deals its
own among its children by weight, none beyond what the child's subtree holds; what a child can't take goes to its siblings, and a whole
family's shortage has by then gone to the parent's siblings, as the parent got no more than its subtree holds. With children sorted by
supply over weight, running sums give the level at which all is dealt: one window per level over the nodes, in whole numbers.

Each leaf then takes whole epochs, and of the next epoch a prefix in an order seeded by (seed, epoch, id). Prefixes are cut without sorting a leaf:
tokens are summed by the first three hex digits of the order key, and only the bucket in which the cut falls is sorted. The table of leaves is broadcast
only while it has ``BROADCAST_LEAVES`` rows at most, else joined. Documents aren't shuffled at all.

Defined results: null texts count as empty and have no tokens; null languages, domains or sources are values of their own; rows with equal order keys (one id repeated in a leaf) are taken
together; a weight of 0 or null takes nothing; a leaf without tokens takes nothing; whole-number division leaves at most a token for each node unused; an empty table gives an
empty mix; texts may be of any length; columns of the input, whatever their names, stay as they are, but that ``mix`` puts its four in the place of columns named like them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lattica.llm.util import Tables, quoted, whole_row

BROADCAST_LEAVES = 50_000
LEVELS = ("_mix_domain", "_mix_lang", "_mix_source")


def estimated_tokens(text: Column) -> Column:
    """Four bytes a token, rounded up."""
    return F.floor((F.coalesce(F.octet_length(text), F.lit(0)) + 3) / 4).cast("long")


def weight_of(value: Column, weights: dict, otherwise: int = 1) -> Column:
    """The weight of a node from a table {value: whole number}."""
    out = F.lit(otherwise)
    for k, v in weights.items():
        out = F.when(value.eqNullSafe(F.lit(k)), v).otherwise(out)
    return out.cast("long")


def dealt(nodes: DataFrame, parent: list[str], budget: Column, weight: str, holds: str) -> DataFrame:
    """Adds _share: what each node of a family (rows with equal ``parent``) gets of the family's budget. Whole numbers throughout."""
    family = W.partitionBy(*parent) if parent else W.partitionBy(F.lit(0))  # nodes of one family, not rows of documents
    by = family.orderBy(F.col(holds) / F.col(weight), *[c for c in nodes.columns if c.startswith("_mix_")])
    full_before = F.coalesce(F.sum(holds).over(by.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    weight_left = F.sum(weight).over(by.rowsBetween(W.currentRow, W.unboundedFollowing))
    n = nodes.withColumn("_b", budget.cast("long")).withColumn("_before", full_before).withColumn("_left", weight_left)
    n = n.withColumn("_full", F.col(holds) * F.col("_left") <= F.col(weight) * (F.col("_b") - F.col("_before")))
    taken = F.coalesce(F.sum(F.when(F.col("_full"), F.col(holds))).over(family), F.lit(0))
    rest = F.coalesce(F.sum(F.when(~F.col("_full"), F.col(weight))).over(family), F.lit(1))
    n = n.withColumn("_taken", taken).withColumn("_rest", rest)
    share = F.when(F.col("_full"), F.col(holds)).otherwise(F.expr(f"(`{weight}` * (_b - _taken)) div _rest"))
    return n.withColumn("_share", share.cast("long")).drop("_b", "_before", "_left", "_full", "_taken", "_rest")


def leaf_budgets(leaves: DataFrame, budget: int, weights: tuple[Column, Column, Column], epochs: int) -> DataFrame:
    """leaves: the three levels and _tokens, a row per leaf. Adds _alloc, the leaf's budget."""
    d, g, s = LEVELS
    n = leaves.withColumn("_w1", weights[0]).withColumn("_w2", weights[1]).withColumn("_w3", weights[2])
    n = n.filter("_tokens > 0 AND _w1 > 0 AND _w2 > 0 AND _w3 > 0").withColumn("_holds", F.col("_tokens") * epochs)
    top = n.groupBy(d).agg(F.max("_w1").alias("_w"), F.sum("_holds").alias("_h"))
    top = dealt(top, [], F.lit(budget), "_w", "_h").select(d, F.col("_share").alias("_db"))
    mid = n.groupBy(d, g).agg(F.max("_w2").alias("_w"), F.sum("_holds").alias("_h")).withColumnRenamed(d, "_d")
    mid = mid.join(top, mid["_d"].eqNullSafe(top[d])).drop("_d")
    mid = dealt(mid, [d], F.col("_db"), "_w", "_h").select(F.col(d).alias("_d"), F.col(g).alias("_g"), F.col("_share").alias("_gb"))
    low = n.join(mid, n[d].eqNullSafe(mid["_d"]) & n[g].eqNullSafe(mid["_g"])).drop("_d", "_g")
    return dealt(low, [d, g], F.col("_gb"), "_w3", "_holds").select(d, g, s, "_tokens", F.col("_share").alias("_alloc"))


def _mixed(docs: DataFrame, domain: Column, lang: Column, source: Column, weights: tuple[dict, dict, dict], fraction: tuple[int, int] = (1, 2), epochs: int = 2, seed: int = 17, tokens: Column | None = None, id_col: str = "doc_id") -> DataFrame:
    """(doc, _mix_domain, _mix_lang, _mix_source, _mix_tokens, _mix_copies) of the documents taken; doc is the input's row."""
    tables = Tables(docs.sparkSession)
    d, g, s = LEVELS
    rows = docs.select(whole_row(docs).alias("doc"), F.col(id_col).alias("id"), domain.alias(d), lang.alias(g), source.alias(s), (estimated_tokens(F.col("text")) if tokens is None else tokens).alias("_mix_tokens"))
    leaves = tables.stored(rows.groupBy(*LEVELS).agg(F.sum("_mix_tokens").cast("long").alias("_tokens")), "leaves")
    supply = leaves.agg(F.sum("_tokens")).first()[0] or 0
    level_weights = tuple(weight_of(F.col(c), w) for c, w in zip(LEVELS, weights, strict=True))
    plan = leaf_budgets(leaves, supply * fraction[0] // fraction[1], level_weights, epochs)
    plan = plan.withColumn("_whole", F.expr("_alloc div _tokens")).withColumn("_part", F.expr("_alloc % _tokens"))
    plan = tables.stored(plan.select(*[F.col(c).alias(f"_p{c}") for c in LEVELS], "_whole", "_part"), "plan")
    small = plan.count() <= BROADCAST_LEAVES

    def met(left: DataFrame, right: DataFrame) -> DataFrame:
        on = [left[c].eqNullSafe(right[f"_p{c}"]) for c in LEVELS]
        return left.join(F.broadcast(right) if small else right, on).drop(*[f"_p{c}" for c in LEVELS])

    key = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("_whole").cast("string"), F.coalesce(F.col("id").cast("string"), F.lit("null"))))
    slim = met(rows.select("id", *LEVELS, "_mix_tokens"), plan).withColumn("_key", key).withColumn("_bucket", F.col("_key").substr(1, 3))
    sums = slim.groupBy(*LEVELS, "_bucket").agg(F.sum("_mix_tokens").alias("_t"), F.max("_part").alias("_part"))
    run = F.sum("_t").over(W.partitionBy(*LEVELS).orderBy("_bucket"))  # 4096 rows a leaf at most
    cut = sums.withColumn("_run", run).filter("_run > _part").groupBy(*LEVELS).agg(F.min(F.struct("_bucket", (F.col("_run") - F.col("_t")).alias("_before"))).alias("_c"))
    cut = tables.stored(cut.select(*[F.col(c).alias(f"_p{c}") for c in LEVELS], F.col("_c._bucket").alias("_cut"), F.col("_c._before").alias("_before")), "cut")
    edge = met(slim, cut).filter("_bucket = _cut")
    inside = F.sum("_mix_tokens").over(W.partitionBy(*LEVELS).orderBy("_key").rangeBetween(W.unboundedPreceding, W.currentRow))  # one bucket of each leaf
    last = edge.withColumn("_in", inside).filter("_before + _in <= _part").groupBy(*LEVELS).agg(F.max("_key").alias("_last"))
    last = last.select(*[F.col(c).alias(f"_q{c}") for c in LEVELS], "_last")
    bounds = plan.join(cut.select(*[F.col(f"_p{c}").alias(f"_r{c}") for c in LEVELS], "_cut"), [plan[f"_p{c}"].eqNullSafe(F.col(f"_r{c}")) for c in LEVELS], "left")
    bounds = bounds.join(last, [F.col(f"_p{c}").eqNullSafe(F.col(f"_q{c}")) for c in LEVELS], "left")
    # a prefix ends with the last key inside the cut bucket, or just before that bucket; without a cut the leaf is taken to its end
    bounds = tables.stored(bounds.select(*[f"_p{c}" for c in LEVELS], "_whole", F.coalesce("_last", "_cut", F.lit("g")).alias("_to")), "bounds")
    taken = met(rows, bounds).withColumn("_mix_copies", (F.col("_whole") + (key <= F.col("_to")).cast("long")).cast("int"))
    tables.drop(bounds)
    return taken.filter("_mix_copies > 0").select("doc", *LEVELS, "_mix_tokens", "_mix_copies")


def mix(docs: DataFrame, *args, **options) -> DataFrame:
    """The documents taken, with their columns, _mix_domain, _mix_lang, _mix_source, _mix_tokens and _mix_copies (how often each is taken).

    Takes docs, the levels' columns domain, lang and source, and weights: {value: whole number} by level; values not named weigh 1. Options: fraction, the budget as part of all
    tokens (numerator, denominator), (1, 2); epochs, 2; seed, 17; tokens, a column, four bytes each if not given; id_col, doc_id."""
    own = [*LEVELS, "_mix_tokens", "_mix_copies"]
    return _mixed(docs, *args, **options).select(*[F.col(f"doc.{quoted(c)}") for c in docs.columns if c not in own], *own)


def taken_once(docs: DataFrame, *args, **options) -> DataFrame:
    """The documents taken, with their columns only. Options as of ``mix``."""
    return _mixed(docs, *args, **options).select("doc.*")
