"""Exact top-k by inner product over norm buckets.

Vectors become integers, floor(64 x) of each component. Candidates are grouped by length in buckets over the whole table, each spanning one hundredth of a power of e,
and dealt in order of length to blocks of bounded size. Rounds take the blocks, longest first, each round four times as many as the one before. After a round each query's
k-th best score is its threshold; threshold over the query's length is the least length that a candidate needs, so a query takes part in the next round only up to the bucket
of that length, and blocks that no query needs are neither read nor shuffled. Within a block the threshold over the largest possible product of lengths is the local cosine
threshold. Above 1 the rest is left out. Where it is high, coordinate pruning keeps the candidates whose unit vector lies in the band that the threshold leaves around the
query's largest coordinates; where it is low, only the length bound is used. What is left is verified by whole integer products.

A stated query set against all rows costs its product where lengths are alike, whatever the plan; queries and candidates then meet in blocks of ``BLOCK_BYTES``, so
memory doesn't grow. The table of buckets goes to the driver; lengths of doubles can't have more than 150,000.

Defined results: vectors that are null, or hold null or non-finite components, take no part, nor do rows without an id; an empty vector has
product 0 with any other; vectors of unequal lengths are compared as if zeros followed; ties go to the smaller id; a candidate
with the query's own id is never returned, so rows repeated with one id don't find each other, and a repeated query id is asked once, with the
smallest of its vectors; columns of the input other than the two named are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lattica.llm.util import Tables

#: Bytes of vectors in a block of candidates; a block of queries has half. Blocks have so many rows at least.
BLOCK_BYTES, LEAST_ROWS = 16 << 20, 1024
#: Buckets of lengths for each power of e, and the bucket of length 0.
PER_E, ZERO = 100, -100_000
#: Blocks of a round, as a multiple of those of the round before.
GROWTH = 4
BUCKET = 512
#: Products that are held at once.
HELD = 1 << 21
#: From this local cosine threshold on, coordinates are looked at.
COORDINATE_FROM = 0.7
FOCUS = 3


def _matrix(column) -> np.ndarray:
    """Rows of whole numbers as float64, zeros behind shorter ones."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat, off = np.asarray(column.flatten(), np.float64), np.asarray(column.offsets, np.int64)
    sizes = np.diff(off)
    out = np.zeros((len(column), int(sizes.max(initial=0))))
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(flat)) - np.repeat(off[:-1] - off[0], sizes)] = flat
    return out


def _products(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Whole products; exact in doubles while they stay below 2**53, else by whole numbers of any size."""
    if len(q) and len(c) and np.abs(q).max(initial=0) * np.abs(c).max(initial=0) * q.shape[1] >= 2.0**52:
        exact = np.vectorize(int, otypes=[object])
        return exact(q) @ exact(c).T
    return q @ c.T


def search(q_ids, q, c_ids, c, k: int, known=None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of the query, id, score) of the k best for each query, none below the scores ``known``."""
    width = max(q.shape[1], c.shape[1])
    q, c = (np.pad(x, ((0, 0), (0, width - x.shape[1]))) for x in (q, c))
    q_len, c_len = np.sqrt((q * q).sum(1)), np.sqrt((c * c).sum(1))
    order = np.argsort(-c_len, kind="stable")
    c, c_ids, c_len = c[order], c_ids[order], c_len[order]
    q_unit = q / np.maximum(q_len, 1e-300)[:, None]
    focus = np.argsort(-np.abs(q_unit), axis=1)[:, :FOCUS]
    best = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
    beat = np.full(len(q), -np.inf) if known is None else known.astype(np.float64)
    at = 0
    while at < len(c):
        to = min(len(c), at + (BUCKET if at else max(BUCKET, 4 * k)))
        longest = c_len[at]
        with np.errstate(divide="ignore", invalid="ignore"):
            local = np.where(q_len * longest > 0, beat / (q_len * longest), np.where(beat > 0, np.inf, -np.inf))
        live = local <= 1 + 1e-9
        if not live.any():
            break
        by_coordinate = np.flatnonzero(live & (local >= COORDINATE_FROM))
        found = []
        if 0 < len(by_coordinate):
            unit = c[at:to] / np.maximum(c_len[at:to], 1e-300)[:, None]
            for i in by_coordinate:
                t = min(1.0, local[i])
                f = focus[i]
                # |q|=|c|=1, q.c >= t: no coordinate of c is further from t q than the rest of the unit sphere allows
                room = np.sqrt(max(0.0, 1 - t * t)) * np.sqrt(np.maximum(0.0, 1 - q_unit[i, f] ** 2)) + 1e-9
                lo, hi = t * q_unit[i, f] - room, t * q_unit[i, f] + room
                hi = np.where(q_unit[i, f] >= t, 1 + 1e-9, hi)  # where q's own coordinate is beyond t, the band reaches the pole
                lo = np.where(-q_unit[i, f] >= t, -1 - 1e-9, lo)
                rows = np.flatnonzero(((unit[:, f] >= lo) & (unit[:, f] <= hi)).all(1))
                if len(rows):
                    s = _products(q[i : i + 1], c[at:to][rows])[0]
                    keep = (s >= beat[i]) & (c_ids[at:to][rows] != q_ids[i])
                    found.append((np.full(keep.sum(), i), c_ids[at:to][rows][keep], s[keep]))
        others = np.flatnonzero(live & ~(local >= COORDINATE_FROM))
        step = max(1, HELD // (to - at))
        for rest in (others[i : i + step] for i in range(0, len(others), step)):
            s = _products(q[rest], c[at:to])
            own = q_ids[rest][:, None] == c_ids[at:to][None]
            if s.dtype == object:
                least = np.array([sorted(r, reverse=True)[min(k, len(r) - 1)] for r in s], object)
            else:
                least = -np.partition(-s, min(k, to - at - 1), 1)[:, min(k, to - at - 1)]  # one more than k, for the query's own row
            i, j = np.nonzero((s >= least[:, None]) & (s >= beat[rest][:, None]) & ~own)
            found.append((rest[i], c_ids[at:to][j], s[i, j]))
        if any(len(f[0]) for f in found):
            rows, ids, scores = (np.concatenate(x) for x in zip(*best, *found, strict=True))
            o = np.lexsort((ids, -scores, rows))
            rows, ids, scores = rows[o], ids[o], scores[o]
            start = np.searchsorted(rows, np.arange(len(q)))
            rank = np.arange(len(rows)) - start[rows]
            keep = rank < k
            last = rank == k - 1
            beat[rows[last]] = scores[last].astype(np.float64)
            best = [(rows[keep], ids[keep], scores[keep])]
        at = to
    return best[0]


def top_k(df: DataFrame, is_query, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 64) -> DataFrame:
    """(query_id, rank, id, score): for each row that the condition ``is_query`` picks, its k best among all other rows."""
    spark = df.sparkSession
    tables = Tables(spark)
    shuffled = int(spark.conf.get("spark.sql.shuffle.partitions"))
    v = F.col(vector_col)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = df.filter(F.col(id_col).isNotNull() & v.isNotNull() & finite)
    rows = rows.select(F.col(id_col).cast("long").alias("id"), F.transform(v, lambda x: F.floor(F.lit(scale) * x.cast("double")).cast("double")).alias("v"), is_query.alias("is_query"))
    length = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
    bucket = lambda x: F.coalesce(F.floor(F.log(x) * PER_E).cast("int"), F.lit(ZERO))  # noqa: E731  the logarithm of 0 is null
    rows = rows.withColumn("len", length).withColumn("key", bucket(F.col("len")))
    seen = rows.groupBy("key").agg(F.count("*").alias("n"), F.count(F.when(F.col("is_query"), 1)).alias("q"), F.max(F.size("v")).alias("width")).orderBy(F.col("key").desc()).collect()
    empty = spark.createDataFrame([], f"query_id long, rank int, `{id_col}` long, score long")
    n, nq = sum(r["n"] for r in seen), sum(r["q"] for r in seen)
    if not nq:
        return empty
    of_bytes = BLOCK_BYTES // (8 * max(1, *(r["width"] for r in seen)))
    cb = max(LEAST_ROWS, min(of_bytes, -(-n // shuffled)))
    qb = max(LEAST_ROWS, of_bytes // 2)
    blocks, query_blocks = -(-n // cb), -(-nq // qb)
    # for every bucket between the longest and the shortest: rows before it, its rows, the last block that its rows or longer ones are in
    before, table, held = 0, [], {r["key"]: r["n"] for r in seen}
    low = min((key for key in held if key != ZERO), default=ZERO)
    for key in [*range(max(held), low - 1, -1), *([ZERO] if ZERO in held and low != ZERO else [])]:
        here = held.get(key, 0)
        table.append((key, before, here, max(0, (before + here - 1) // cb)))
        before += here
    table = F.broadcast(spark.createDataFrame(table, "key int, before long, here long, last long"))  # 150,000 rows at most
    place = F.col("before") + F.floor(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) * F.col("here") / (1 << 30))
    dealt = rows.join(table, "key").select("id", "v", "is_query", "len", F.floor(place / cb).cast("long").alias("block"))
    dealt = tables.stored(dealt.repartitionByRange(max(shuffled, blocks), "block").sortWithinPartitions("block"), "vectors")  # a round reads its blocks' files only
    queries = tables.stored(dealt.filter("is_query").groupBy("id").agg(F.min(F.struct("v", "len")).alias("x")).select("id", "x.v", "x.len", F.pmod(F.xxhash64("id"), F.lit(query_blocks)).cast("int").alias("q")), "queries")

    def run(mine: pa.Table, others: pa.Table) -> pa.Table:
        if not mine.num_rows or not others.num_rows:
            return pa.table({"query_id": pa.array([], pa.int64()), "id": pa.array([], pa.int64()), "score": pa.array([], pa.int64())})
        ids = np.asarray(mine["id"])
        known = np.asarray(mine["beat"].to_pylist(), np.float64)
        i, found, scores = search(ids, _matrix(mine["v"]), np.asarray(others["id"]), _matrix(others["v"]), k, known)
        whole = [max(-(2**63), min(2**63 - 1, int(s))) for s in scores]
        return pa.table({"query_id": pa.array(ids[i], pa.int64()), "id": pa.array(found, pa.int64()), "score": pa.array(whole, pa.int64())})

    best, start, width = None, 0, 1
    while start < blocks:
        end = min(blocks, start + width) - 1
        asked = queries.withColumn("beat", F.lit(float("-inf")))
        if best is not None:
            beat = best.groupBy("query_id").agg(F.when(F.count("*") >= k, F.min("score")).alias("b"))
            asked = queries.join(beat, queries["id"] == beat["query_id"], "left").withColumn("beat", F.coalesce(F.col("b").cast("double"), F.lit(float("-inf")))).drop("query_id", "b")
        # the bucket of the least length that a candidate needs, and one more for rounding; no bound where scores of 0 and less count
        least = F.when((F.col("beat") <= 0) | (F.col("len") == 0), F.lit(ZERO)).otherwise(bucket(F.col("beat") / F.nullif(F.col("len"), F.lit(0.0))) - 1)
        top, bottom = max(held), low if ZERO not in held else ZERO
        least = F.when(least < low, F.lit(bottom)).otherwise(F.least(least, F.lit(top)))
        asked = asked.withColumn("key", least).join(table, "key").filter(F.col("last") >= start)
        left = asked.select("id", "v", "beat", "q", F.explode(F.sequence(F.lit(start).cast("long"), F.least("last", F.lit(end).cast("long")))).alias("block"))
        wanted = left.select(F.col("q").alias("to_q"), F.col("block").alias("to_block")).distinct()
        right = dealt.filter(F.col("block").between(start, end)).join(wanted, F.col("block") == F.col("to_block")).select(F.col("id").alias("id"), F.col("v").alias("v"), F.col("to_q").alias("q"), F.col("to_block").alias("block"))
        found = left.groupBy("q", "block").cogroup(right.groupBy("q", "block")).applyInArrow(run, "query_id long, id long, score long")
        if best is not None:
            found = found.unionByName(best)
        rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.col("score").desc(), "id"))
        best = tables.stored(found.withColumn("rank", rank).filter(F.col("rank") <= k).drop("rank"), "best")
        start, width = end + 1, width * GROWTH
    tables.drop(best)
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.col("score").desc(), "id"))
    return best.select("query_id", rank.alias("rank"), F.col("id").alias(id_col), "score")
