"""Connected components of a graph that no single machine has to hold."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.llm.util import Tables


class UnionFind:
    """Over any hashable nodes."""

    def __init__(self):
        self.up: dict = {}

    def root(self, x):
        at = self.up.setdefault(x, x)
        while at != self.up[at]:
            self.up[at] = self.up[self.up[at]]
            at = self.up[at]
        self.up[x] = at
        return at

    def join(self, a, b) -> bool:
        a, b = self.root(a), self.root(b)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        return True


#: Edges, 16 bytes each, that one task joins alone.
ONE_TASK = 1 << 20


def _stars(held: UnionFind) -> pa.RecordBatch:
    stars = [(x, held.root(x)) for x in held.up]
    stars = [(x, r) for x, r in stars if x != r]
    return pa.RecordBatch.from_arrays([pa.array(np.array([s[k] for s in stars], np.int64)) for k in (0, 1)], names=["u", "v"])


def _local(batches):
    """Within a batch, each component becomes a star around its least node: no edge more than nodes."""
    for b in batches:
        held = UnionFind()
        for x, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            held.join(x, y)
        yield _stars(held)


def _whole(batches):
    """The same over all batches of a task."""
    held = UnionFind()
    for b in batches:
        for x, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            held.join(x, y)
    yield _stars(held)


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of edges (a, b), both long: root is the least node of its component.

    Stars of each batch; if no more than ONE_TASK edges are left, one task joins them, else large-star and small-star steps in turn, each an aggregate and a
    join, until nothing moves. Steps are written to the shared folder."""
    tables = Tables(edges.sparkSession)
    e = edges.select(F.col("a").cast("long").alias("u"), F.col("b").cast("long").alias("v")).filter("u <> v")
    e = tables.stored(e.mapInArrow(_local, "u long, v long").distinct(), "stars")
    rooted = lambda e: e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()
    if e.count() <= ONE_TASK:
        return rooted(e.coalesce(1).mapInArrow(_whole, "u long, v long"))
    known = None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(low, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = tables.stored(moved.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), "stars")
        tables.drop(e)
        now = e.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first()
        if now == known:
            return rooted(e)
        known = now
