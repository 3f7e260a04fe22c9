"""Removal of repeated byte strings by suffix arrays over shards.

A byte goes if a string of ``min_len`` bytes that covers it also starts earlier. All copies of such a string must meet, without all texts meeting:

1. Each string of ``min_len`` bytes names one of its grams, the one of least hash: its anchor. Equal strings name equal anchors, so they meet in the
   anchor's bucket. A document sends an anchor once for each place, with a hash of the neighbourhood that holds just the strings it
   stands for. Anchors found once in the corpus end here. A task combines its own before the shuffle: of equal neighbourhoods one goes on, and of an anchor's different ones
   ``MOST_OF_A_TASK`` go to the anchor's bucket; the rest, which certainly have others to be compared with, are dealt by anchor and neighbourhood. So a passage
   in very many texts puts a few rows a task in one bucket, not a row a text. (A neighbourhood that came both ways is only compared once more than it need be.)
2. Of neighbourhoods with equal hashes all but one of a task, and all but the first of those that meet, are claimed to repeat an earlier one whole. Claims of a document that continue each other are one claim, so a copy of
   a text makes one or a few. Each is verified on the bytes of both texts: a BLAKE2b digest of 256 bits of the stretch, made on either side. Anchors with a claim that fails
   are taken up again in step 3, with all their neighbourhoods.
3. Anchors with several different neighbourhoods are left, one document's text for each neighbourhood. Their texts go to shards by anchor.
   There, strings are told apart by their distance to the anchor in ``PARTS`` parts; those of a part share a stretch around the anchor, and where no other neighbourhood
   has that stretch they can't repeat and are cut off. Of the rest a shard's
   suffix array comes from induced sorting, its permuted common prefixes from the array; runs of suffixes with ``min_len`` bytes or more in common are
   equal strings, of which the earliest stays.
4. Anchors with more than ``MOST_IN_A_SHARD`` neighbourhoods (edges of a passage that very many texts share) go the exact way for the rest:
   their strings are grouped by value (a BLAKE2b digest of 256 bits, as strong as the claims' check), with the least place combined before the shuffle, and joined back.

So whole copies are settled in step 2, which is most of the bytes where copies are common; what texts share in part is decided by the suffix arrays.
Buckets and shards have a fixed size, so their number grows with the input.

Defined results: null counts as empty; texts shorter than ``min_len`` bytes keep all; ids order the documents, rows of one id with different texts are different documents,
ordered by 60 bits of their texts' MD5, which tell them apart; rows with equal id and text are one document (each gets its result, none removes the other); a null id is
replaced by a hash of the text, behind equal ids; columns of the input may have any names and stay as they are; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.llm.induced import permuted_prefixes, suffix_array
from lattica.llm.util import Rolling, Tables, chunks, flat, mixed, partitions, quoted, slice_hashes, total_bytes, whole_row

MOST_IN_A_SHARD = 20_000
#: Bits of a neighbourhood's hash that are used.
NEAR_BITS = 64
#: Bytes of neighbourhoods in one suffix array.
ARRAY_BYTES = 1 << 20
#: Bytes of text whose anchors a task combines at a time, and different neighbourhoods of an anchor that it sends to the anchor's bucket from each.
HELD_TEXT, MOST_OF_A_TASK = 32 << 20, 32
#: Bytes of text for a bucket of anchors, and neighbourhoods for a shard.
BUCKET_TEXT, SHARD_ROWS = 24 << 20, 24_000


def _slide(x: np.ndarray, w: int, op) -> np.ndarray:
    """op over every window of w values."""
    p = 1
    while 2 * p <= w:
        x = op(x[:-p], x[p:])
        p *= 2
    return op(x[: len(x) - (w - p)], x[w - p :]) if w > p else x


def gram_size(min_len: int) -> int:
    return max(4, min(32, min_len // 2))


def anchors(data: np.ndarray, off: np.ndarray, min_len: int):
    """For texts end to end: (document, start of the gram, neighbourhood's start and end, gram hash, neighbourhood hash) of every anchor.

    A neighbourhood holds the strings in which no gram has a smaller hash than the anchor; every string is in that of its anchor."""
    k = gram_size(min_len)
    n, w = len(data), min_len - k + 1
    if n < min_len:
        return (np.zeros(0, np.int64),) * 6
    hashes = Rolling(data)
    gram = hashes.grams(k)
    low = (gram >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
    least = _slide(low, w, np.minimum)  # by the start of a string
    size = np.diff(off)
    ends = np.repeat(off[1:], size)
    least[ends[: len(least)] - np.arange(len(least)) < min_len] = 0
    padded = np.zeros(len(least) + 2 * (w - 1), np.uint32)
    padded[w - 1 : w - 1 + len(least)] = least
    at = np.flatnonzero(low == _slide(padded, w, np.maximum)[: len(low)])
    doc = np.searchsorted(off, at, "right") - 1
    first, last = np.maximum(off[doc], at - w + 1), np.minimum(off[doc + 1] - min_len, at)
    value = low[at]
    for side, bound in ((-1, first), (1, last)):  # the nearest smaller anchor on either side ends the range of strings
        live, step = np.arange(len(at)), 1
        while len(live):
            other = live + side * step
            live = live[(other >= 0) & (other < len(at))]
            other = live + side * step
            near = np.abs(at[other] - at[live]) < w
            live, other = live[near], other[near]
            smaller = value[other] < value[live]
            hit = live[smaller]
            bound[hit] = np.maximum(bound[hit], at[other[smaller]] + 1) if side < 0 else np.minimum(bound[hit], at[other[smaller]] - w)
            live = live[~smaller]
            step += 1
    a, b = first, last + min_len
    return doc, at, a, b, gram[at], slice_hashes(data, a, b)[0] ^ mixed((at - a).astype(np.uint64))


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc, d, t, text): the input's row, the two numbers that name and order a document, and its text."""
    rows = docs.select(whole_row(docs).alias("doc"), F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    h = F.conv(F.substring(F.md5("text"), 1, 15), 16, 10).cast("long")
    return rows.select("doc", F.coalesce("id", F.xxhash64("text")).alias("d"), F.when(F.col("id").isNull(), h + F.lit(1 << 60)).otherwise(h).alias("t"), "text")


_PACKED = {"g": np.uint64, "c": np.uint64, "d": np.int64, "t": np.int64, "s": np.int64, "n": np.int32, "i": np.int32, "d0": np.int64, "t0": np.int64, "s0": np.int64}
#: What a packed row holds: neighbourhoods that meet by anchor, others of an anchor that is common in its task, and claims that are made already.
BY_ANCHOR, BY_BOTH, CLAIMED = 0, 1, 2


def _ordered(kind, g, c, d, t, s):
    """(order, same anchor as the row before, same neighbourhood as the row before, the neighbourhood's first row, whether a row is that place itself), the last four in that order."""
    o = np.lexsort((s, t, d, c, g, kind))
    kind, g, c, d, t, s = (x[o] for x in (kind, g, c, d, t, s))
    same_g = np.r_[False, (g[1:] == g[:-1]) & (kind[1:] == kind[:-1])][: len(g)]
    same = same_g & np.r_[False, c[1:] == c[:-1]][: len(g)]
    first = np.maximum.accumulate(np.where(same, 0, np.arange(len(g))))
    return o, same_g, same, first, (d == d[first]) & (t == t[first]) & (s == s[first])  # the last: the first itself, or the same row again


def _combined(held: list[np.ndarray], most: int):
    """Of a task's neighbourhoods (g, c, d, t, s, n, i): (kind, bucket's hash, the columns of _PACKED). Equal ones leave one, the others become claims on it here, before
    anything is shuffled; claims of a document that continue each other become one, without an anchor."""
    o, same_g, same, first, own = _ordered(np.zeros(len(held[0]), np.int8), *held[:5])
    g, c, d, t, s, n, i = (x[o] for x in held)
    rank = np.cumsum(~same)
    rank -= rank[np.maximum.accumulate(np.where(same_g, 0, np.arange(len(g))))] if len(g) else 0  # which of its anchor's different ones
    claim, left = np.flatnonzero(~own), np.flatnonzero(~same)
    at = claim[np.lexsort((t[claim], d[claim]))]
    new = np.r_[True, (d[at][1:] != d[at][:-1]) | (t[at][1:] != t[at][:-1])][: len(at)]
    doc, cs, d0, t0, s0, cn = _runs(np.cumsum(new) - 1, s[at], n[at], d[first[at]], t[first[at]], s[first[at]])
    cd, ct = d[at[new]][doc], t[at[new]][doc]
    none, zero = np.zeros(len(doc), np.uint64), np.zeros(len(left), np.int64)
    kind = np.r_[np.where(rank[left] >= most, BY_BOTH, BY_ANCHOR), np.full(len(doc), CLAIMED)].astype(np.int8)
    place = np.r_[np.where(rank[left] >= most, mixed(g[left] ^ mixed(c[left])), mixed(g[left])), mixed(mixed(cd.view(np.uint64)) ^ cs.view(np.uint64))]
    held = [(g[left], none), (c[left], none), (d[left], cd), (t[left], ct), (s[left], cs), (n[left], cn.astype(np.int32)), (i[left], none.astype(np.int32)), (zero, d0), (zero, t0), (zero, s0)]
    return kind, place, [np.concatenate(x) for x in held]


def _bucketed(rows: DataFrame, min_len: int, buckets: int, only: np.ndarray | None = None, combine: bool = True) -> DataFrame:
    """(b, kind, and columns of anchors packed as bytes): one row per HELD_TEXT bytes of texts, bucket and kind. With ``only`` all neighbourhoods of those anchors; then, and without ``combine``, none is combined."""
    used, most, room = np.uint64((1 << NEAR_BITS) - 1), MOST_OF_A_TASK, HELD_TEXT

    def packed(parts):
        held = [np.concatenate(x) for x in zip(*parts, strict=True)]
        if only is None and combine:
            kind, place, held = _combined(held, most)
        else:
            kind, place, held = np.zeros(len(held[0]), np.int8), mixed(held[0]), [*held, *held[2:5]]
        bucket = (place % np.uint64(buckets)).astype(np.int32)
        o = np.lexsort((kind, bucket))
        cut = np.r_[np.flatnonzero(np.r_[True, (bucket[o][1:] != bucket[o][:-1]) | (kind[o][1:] != kind[o][:-1])][: len(o)]), len(o)]
        head = o[cut[:-1]]
        claimed = (kind[head] == CLAIMED).tolist()
        columns = []
        for k, x in zip(_PACKED, held, strict=True):
            x = x[o]
            columns.append([b"" if k in (("g", "c", "i") if yes else ("d0", "t0", "s0")) else x[p:q].tobytes() for p, q, yes in zip(cut[:-1].tolist(), cut[1:].tolist(), claimed, strict=True)])
        for p in range(0, len(head), 4096):
            q = slice(p, p + 4096)
            yield pa.RecordBatch.from_arrays([pa.array(bucket[head[q]]), pa.array(kind[head[q]]), *(pa.array(x[q], pa.binary()) for x in columns)], names=["b", "kind", *_PACKED])

    def run(batches):
        parts, size = [], 0
        for part in chunks(batches, "text"):
            data, off = flat(part.column(2))
            doc, at, a, b, gram, near = anchors(data, off, min_len)
            if only is not None:
                of = np.isin(gram, only)
                doc, at, a, b, gram, near = (x[of] for x in (doc, at, a, b, gram, near))
            if not len(doc):
                continue
            d, t = (np.asarray(part.column(k), np.int64)[doc] for k in (0, 1))
            parts.append((gram, near & used, d, t, (a - off[doc]).astype(np.int64), (b - a).astype(np.int32), (at - a).astype(np.int32)))
            size += len(data)
            if size >= room:
                yield from packed(parts)
                parts, size = [], 0
        if parts:
            yield from packed(parts)

    return rows.select("d", "t", "text").mapInArrow(run, "b int, kind byte, " + ", ".join(f"{k} binary" for k in _PACKED))


_MET = "d long, t long, s long, n int, i int, g long, settled boolean, d0 long, t0 long, s0 long"


def _met(only: np.ndarray | None = None):
    """Of a bucket: claims that a neighbourhood repeats another, earlier one whole (settled), and the neighbourhoods to be compared (g is their anchor). With ``only`` all neighbourhoods of those anchors are to be compared."""

    def run(table: pa.Table) -> pa.Table:
        kinds, packed = np.asarray(table["kind"]), {k: table[k].to_pylist() for k in _PACKED}
        got = lambda k, of: np.frombuffer(b"".join(packed[k][j] for j in of), _PACKED[k])
        claims = np.flatnonzero(kinds == CLAIMED).tolist()
        claimed = {k: got(k, claims) for k in _PACKED}
        claimed |= {k: np.zeros(len(claimed["d"]), _PACKED[k]) for k in "gi"}
        open_ = np.flatnonzero(kinds != CLAIMED).tolist()
        held = [got(k, open_) for k in list(_PACKED)[:7]]
        kind = np.repeat(kinds[open_], [len(packed["g"][j]) // 8 for j in open_])
        o = np.lexsort((held[0], kind))
        new = np.r_[True, (held[0][o][1:] != held[0][o][:-1]) | (kind[o][1:] != kind[o][:-1])][: len(o)]
        size = np.diff(np.r_[np.flatnonzero(new), len(o)])
        o = o[(np.repeat(size, size) > 1) | (kind[o] == BY_BOTH)]  # an anchor found once ends here
        kind, held = kind[o], [x[o] for x in held]
        o, same_g, same, first, own = _ordered(kind, *held[:5])
        kind = kind[o]
        g, c, d, t, s, n, i = (x[o] for x in held)
        group = np.cumsum(~same_g) - 1
        several = (np.bincount(group, ~same)[group] > 1) | (kind == BY_BOTH) if len(g) else own
        settled = ~own if only is None else np.zeros(len(g), bool)
        keep = settled | (several & ~same) if only is None else np.ones(len(g), bool)
        settled = np.r_[settled[keep], np.ones(len(claimed["g"]), bool)]
        both = lambda k, x: np.r_[x[keep], claimed[k]]
        refer = lambda k, x: pa.array(both(k, x[first]), pa.int64(), mask=~settled)
        out = {k: both(k, x) for k, x in zip("dtsnig", (d, t, s, n, i, g), strict=True)}
        return pa.table({**out, "g": out["g"].view(np.int64), "settled": settled, "d0": refer("d0", d), "t0": refer("t0", t), "s0": refer("s0", s)})

    return run


#: Parts of the strings of a neighbourhood, by their distance to the anchor.
PARTS = 4


def _trimmed(g, i, texts: list[bytes], min_len: int):
    """(kept, from, to): the neighbourhoods, and the stretch of each, in which strings may repeat those of another one of the same anchor."""
    w = min_len - gram_size(min_len) + 1
    step = -(-w // PARTS)
    size = np.array([len(x) for x in texts])
    off = np.r_[0, np.cumsum(size)]
    hashes = Rolling(np.frombuffer(b"".join(texts), np.uint8))
    most, least = i, i - (size - min_len)  # distances from the start of a string to the anchor
    live = np.zeros((len(texts), PARTS), bool)
    for k in range(PARTS):
        lo, hi = k * step, min(w, (k + 1) * step) - 1
        v = np.flatnonzero((lo <= most) & (hi >= least)) if hi >= lo else np.zeros(0, int)
        if len(v):
            at = off[v] + i[v]
            h = hashes(at - lo, at - hi + min_len) ^ mixed(g[v].view(np.uint64))
            live[v, k] = (lambda inverse, count: count[inverse] > 1)(*np.unique(h, return_inverse=True, return_counts=True)[1:])
    kept = np.flatnonzero(live.any(1))
    first, last = live[kept].argmax(1), PARTS - 1 - live[kept][:, ::-1].argmax(1)
    far, near = np.minimum(most[kept], np.minimum(w, (last + 1) * step) - 1), np.maximum(least[kept], first * step)
    return kept, i[kept] - far, i[kept] - near + min_len


def _earlier_in_shard(d, t, s, texts: list[bytes], min_len: int):
    """Of neighbourhoods: (index, first, last start) runs of strings of min_len bytes that also start earlier in another, by a suffix array."""
    sizes = np.array([len(x) for x in texts])
    starts = np.r_[0, np.cumsum(sizes + 1)[:-1]]
    joined = np.frombuffer(b"\x00".join(texts) + b"\x00", np.uint8).astype(np.int64) + 2
    joined[starts + sizes] = 1
    joined = np.append(joined, 0)
    order = suffix_array(joined)
    shared = permuted_prefixes(joined, order, starts, 4 * min_len + 64)
    piece = np.append(np.repeat(np.arange(len(texts)), sizes + 1), len(texts) - 1)
    room = starts[piece] + sizes[piece] - np.arange(len(joined))  # bytes left in the neighbourhood
    fits = room[order] >= min_len
    order = order[fits]
    joins = (shared[order] >= min_len) & np.r_[False, np.diff(np.flatnonzero(fits)) == 1][: len(order)]
    if not joins.any():
        return np.zeros((0, 3), np.int64)
    rank = np.unique(np.rec.fromarrays((d, t), names="d,t"), return_inverse=True)[1]
    place = (rank.astype(np.int64) << 44) + s  # texts are shorter than 2**44 bytes
    place = place[piece[order]] + order - starts[piece[order]]
    head = np.flatnonzero(~joins)
    least = np.repeat(np.minimum.reduceat(place, head), np.diff(np.r_[head, len(order)]))
    at = np.sort(order[place > least])
    if not len(at):
        return np.zeros((0, 3), np.int64)
    cut = np.flatnonzero(np.diff(at, prepend=-2) != 1)
    first, last = at[cut], at[np.r_[cut[1:], len(at)] - 1]
    return np.column_stack((piece[first], first - starts[piece[first]], last - starts[piece[last]]))


def _shard(min_len: int):
    def run(table: pa.Table) -> pa.Table:
        g, d, t, s, i = (np.asarray(table[k]) for k in ("g", "d", "t", "s", "i"))
        texts = table["x"].to_pylist()
        if texts:
            kept, a, b = _trimmed(g, i.astype(np.int64), texts, min_len)
            texts = [texts[k][p:q] for k, p, q in zip(kept.tolist(), a.tolist(), b.tolist(), strict=True)]
            g, d, t, s = g[kept], d[kept], t[kept], s[kept] + a
        o = np.argsort(g, kind="stable")
        out, part, held = [], [], 0
        cuts = np.r_[np.flatnonzero(np.r_[True, g[o][1:] != g[o][:-1]][: len(o)]), len(o)]

        def done():
            i = np.array(part)
            for k, a, b in _earlier_in_shard(d[i], t[i], s[i], [texts[j] for j in i], min_len):
                out.append((d[i[k]], t[i[k]], s[i[k]] + a, b - a + min_len))

        for a, b in zip(cuts[:-1], cuts[1:], strict=True):  # an anchor's neighbourhoods stay together
            part += o[a:b].tolist()
            held += sum(len(texts[j]) for j in o[a:b])
            if held >= ARRAY_BYTES:
                done()
                part, held = [], 0
        if part:
            done()
        cols = list(zip(*out, strict=True)) if out else [[]] * 4
        return pa.table({k: pa.array(np.array(c, np.int64), v) for k, c, v in zip(("d", "t", "s", "n"), cols, (pa.int64(), pa.int64(), pa.int64(), pa.int32()), strict=True)})

    return run


def _runs(doc, s, n, d0, t0, s0):
    """Claims of documents that continue each other, as one: (document, start, first's d, t and start, length)."""
    o = np.lexsort((s, s - s0, t0, d0, doc))
    doc, s, n, d0, t0, s0 = (x[o] for x in (doc, s, n, d0, t0, s0))
    new = np.ones(len(o), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (d0[1:] != d0[:-1]) | (t0[1:] != t0[:-1]) | (s[1:] - s0[1:] != s[:-1] - s0[:-1]) | (s[1:] > s[:-1] + n[:-1])
    head = np.flatnonzero(new)
    end = np.maximum.reduceat(s + n, head) if len(o) else s
    return doc[head], s[head], d0[head], t0[head], s0[head], end - s[head]


def _digest(raw: bytes) -> bytes:
    return hashlib.blake2b(raw, digest_size=32).digest()


def _read(rows: DataFrame, met: DataFrame) -> DataFrame:
    """The texts meet their own list of places. For neighbourhoods to be compared (g, d, t, s, x, i) with x their bytes, for claims (d, t, s, n, h): the first's stretch and the digest that it should have."""
    claim, place = (F.struct(*names) for names in (("s", "n", "d0", "t0", "s0"), ("s", "n", "g", "i")))
    lists = met.groupBy(F.col("d").alias("e"), F.col("t").alias("u")).agg(F.collect_list(F.when(~F.col("settled"), place)).alias("w"), F.collect_list(F.when(F.col("settled"), claim)).alias("k"))
    joined = rows.select("d", "t", "text").join(lists, (F.col("d") == F.col("e")) & (F.col("t") == F.col("u"))).select("d", "t", "text", "w", "k")
    names = ["g", "d", "t", "s", "x", "i", "n", "h"]
    kinds = [pa.int64()] * 4 + [pa.binary(), pa.int32(), pa.int64(), pa.binary()]

    def listed(column, fields):
        column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
        inner = column.flatten()
        return np.repeat(np.arange(len(column)), np.diff(np.asarray(column.offsets))), *(np.asarray(inner.field(k)).astype(np.int64) for k in range(fields))

    def made(**columns):
        n = len(next(iter(columns.values())))
        return pa.RecordBatch.from_arrays([pa.array(columns[k], t) if k in columns else pa.nulls(n, t) for k, t in zip(names, kinds, strict=True)], names=names)

    def run(batches):
        for part in chunks(batches, "text"):
            data, off = flat(part.column(2))
            raw = data.tobytes()
            d, t = (np.asarray(part.column(k), np.int64) for k in (0, 1))
            doc, s, n, g, i = listed(part.column(3), 4)
            a = off[doc] + s
            for at in range(0, len(a), 8192):
                k = slice(at, at + 8192)
                yield made(g=g[k], d=d[doc[k]], t=t[doc[k]], s=s[k], x=[raw[p : p + q] for p, q in zip(a[k].tolist(), n[k].tolist(), strict=True)], i=i[k])
            doc, s, d0, t0, s0, n = _runs(*listed(part.column(4), 5))
            a = off[doc] + s
            if len(a):
                yield made(d=d0, t=t0, s=s0, n=n, h=[_digest(raw[p : p + q]) for p, q in zip(a.tolist(), n.tolist(), strict=True)])

    return joined.mapInArrow(run, "g long, d long, t long, s long, x binary, i int, n long, h binary").dropDuplicates(["g", "d", "t", "s", "i", "n", "h"])


def _failed(rows: DataFrame, claims: DataFrame) -> DataFrame:
    """(d, t, s, n): stretches of first texts whose bytes aren't those that a claim says. claims: (d, t, s, n, h)."""
    lists = claims.groupBy(F.col("d").alias("e"), F.col("t").alias("u")).agg(F.collect_list(F.struct("s", "n", "h")).alias("k"))
    joined = rows.select("d", "t", "text").join(lists, (F.col("d") == F.col("e")) & (F.col("t") == F.col("u"))).select("d", "t", "text", "k")

    def run(batches):
        for part in chunks(batches, "text"):
            out = []
            for d, t, text, k in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), part.column(2), part.column(3), strict=True):
                raw = text.as_buffer()
                out += [(d, t, c["s"], c["n"]) for c in k.as_py() if _digest(raw[c["s"] : c["s"] + c["n"]]) != c["h"]]
            yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in out], pa.int64()) for j in range(4)], names=["d", "t", "s", "n"])

    return joined.mapInArrow(run, "d long, t long, s long, n long").distinct()


def _by_value(texts: DataFrame, min_len: int, tables: Tables) -> DataFrame:
    """The exact way for anchors with very many neighbourhoods: strings grouped by value (a digest of 256 bits of their bytes, as for claims), the least place combined before the shuffle."""

    def run(batches):
        for part in chunks(batches, "x", 1 << 19):
            data, off = flat(part.column(4))
            if len(data) < min_len:
                continue
            size = np.maximum(np.diff(off) - min_len + 1, 0)
            doc = np.repeat(np.arange(part.num_rows), size)
            o = np.arange(len(doc)) - np.repeat(np.cumsum(size) - size, size)
            at = off[doc] + o
            raw = data.tobytes()
            d, t = (part.column(k).take(pa.array(doc)) for k in (1, 2))
            digests = pa.array([_digest(raw[p : p + min_len]) for p in at.tolist()], pa.binary())
            yield pa.RecordBatch.from_arrays([digests, d, t, pa.array(np.asarray(part.column(3))[doc] + o)], names=["h", "d", "t", "s"])

    windows = tables.stored(texts.mapInArrow(run, "h binary, d long, t long, s long"), "windows")
    least = windows.groupBy("h").agg(F.min(F.struct("d", "t", "s")).alias("m"))
    later = windows.join(least, "h").filter(F.struct("d", "t", "s") > F.col("m"))
    return later.select("d", "t", "s", F.lit(min_len).alias("n"))


def spans(rows: DataFrame, min_len: int, most_in_a_shard: int = MOST_IN_A_SHARD) -> DataFrame:
    """(d, t, spans), a written table: stretches to remove, n bytes from byte s; they may overlap. rows: from _keyed()."""
    spark = rows.sparkSession
    tables = Tables(spark)
    buckets = partitions(spark, total_bytes(rows, "text"), BUCKET_TEXT)

    def claimed(combine: bool):
        met = tables.stored(_bucketed(rows, min_len, buckets, combine=combine).groupBy("b").applyInArrow(_met(), _MET), "anchors")
        read = tables.stored(_read(rows, met), "neighbourhoods")
        return met, read, tables.stored(_failed(rows, read.filter("h IS NOT NULL").select("d", "t", "s", "n", "h")), "failed")

    met, read, failed = claimed(True)
    if not failed.isEmpty():  # claims that tasks made don't name their anchors: once more, with claims that do
        met, read, failed = claimed(False)
    settled = met.filter("settled")
    texts = read.filter("h IS NULL").select("g", "d", "t", "s", "x", "i")
    if not failed.isEmpty():  # two neighbourhoods of one anchor with equal hashes: expected never
        of = failed.select(*[F.col(c).alias(f"f_{c}") for c in failed.columns])
        inside = (F.col("d0") == F.col("f_d")) & (F.col("t0") == F.col("f_t")) & (F.col("s0") >= F.col("f_s")) & (F.col("s0") + F.col("settled.n") <= F.col("f_s") + F.col("f_n"))
        again = tables.stored(settled.alias("settled").join(of, inside).select("g").distinct(), "again")
        only = np.asarray(again.toArrow()["g"], np.int64).view(np.uint64)
        settled = settled.join(again, "g", "left_anti")
        met = tables.stored(_bucketed(rows, min_len, buckets, only).groupBy("b").applyInArrow(_met(only), _MET), "anchors")
        more = tables.stored(_read(rows, met), "neighbourhoods")
        texts = texts.join(again, "g", "left_anti").unionByName(more.select(*texts.columns))
    counts = texts.groupBy("g").agg(F.count("*").alias("k"))
    n, most = counts.agg(F.coalesce(F.sum("k"), F.lit(0)), F.coalesce(F.max("k"), F.lit(0))).first()
    out = settled.select("d", "t", "s", "n")
    few = texts
    if most > most_in_a_shard:
        crowd = tables.stored(counts.filter(F.col("k") > most_in_a_shard).select("g"), "crowded")  # rows / most_in_a_shard of them at most
        few = texts.join(crowd, "g", "left_anti")
        out = out.unionByName(_by_value(texts.join(crowd, "g", "left_semi").select("g", "d", "t", "s", "x"), min_len, tables))
    shards = partitions(spark, n, SHARD_ROWS)
    found = few.withColumn("b", F.pmod(F.xxhash64("g"), F.lit(shards)).cast("int")).groupBy("b").applyInArrow(_shard(min_len), "d long, t long, s long, n int")
    done = tables.stored(out.unionByName(found).groupBy("d", "t").agg(F.collect_list(F.struct("s", "n")).alias("spans")), "spans")
    tables.drop(done)
    return done


def kept_spans(n_bytes: int, starts, sizes) -> tuple[list[tuple[int, int]], int]:
    """What is left of a text as (start, end), and the number of maximal removed runs."""
    kept, at, runs = [], 0, 0
    last = -1
    for a, b in sorted((s, s + n) for s, n in zip(starts, sizes, strict=True)):
        if a > last:
            runs += 1
            if a > at:
                kept.append((at, a))
        last = max(last, b)
        at = max(at, b)
    if at < n_bytes:
        kept.append((at, n_bytes))
    return kept, runs


def _with_spans(docs: DataFrame, min_len: int, id_col: str, text_col: str, most_in_a_shard: int) -> DataFrame:
    """(doc, text, spans)"""
    rows = _keyed(docs, id_col, text_col)
    found = spans(rows, min_len, most_in_a_shard).select(F.col("d").alias("e"), F.col("t").alias("u"), "spans")
    return rows.join(found, (F.col("d") == F.col("e")) & (F.col("t") == F.col("u")), "left").select("doc", "text", "spans")


def removal_report(docs: DataFrame, min_len: int = 100, id_col: str = "doc_id", text_col: str = "text", most_in_a_shard: int = MOST_IN_A_SHARD) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept_sha256) for every document."""
    rows = _with_spans(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), min_len, "id", "text", most_in_a_shard)
    kind = docs.schema[id_col].dataType.simpleString()
    names = [id_col, "n_bytes", "n_removed", "n_spans", "kept_sha256"]

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                out = []
                for text, places in zip(part.column(1), part.column(2), strict=True):
                    raw = (text.as_py() or "").encode()
                    places = places.as_py() or []
                    kept, runs = kept_spans(len(raw), [p["s"] for p in places], [p["n"] for p in places])
                    left = b"".join(raw[i:j] for i, j in kept)
                    out.append((len(raw), len(raw) - len(left), runs, hashlib.sha256(left).hexdigest()))
                cols = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True))], names=names)

    return rows.select("doc.id", "text", "spans").mapInArrow(run, f"{quoted(id_col)} {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def without_repeats(docs: DataFrame, min_len: int = 100, id_col: str = "doc_id", text_col: str = "text", most_in_a_shard: int = MOST_IN_A_SHARD) -> DataFrame:
    """The documents, with their columns, without the repeated bytes. A character of which a part was removed goes whole."""
    names = docs.columns
    at = names.index(text_col)
    rows = _with_spans(docs, min_len, id_col, text_col, most_in_a_shard)
    rows = rows.select(*[F.col("doc").getField(c).alias(f"c{k}") for k, c in enumerate(names)], "spans")  # by place: names of the input may be any

    def run(batches):
        for b in batches:
            texts = []
            for text, places in zip(b.column(at), b.column(b.num_columns - 1), strict=True):
                places = places.as_py()
                if not places:
                    texts.append(text.as_py())
                    continue
                raw = text.as_py().encode()
                kept, _ = kept_spans(len(raw), [p["s"] for p in places], [p["n"] for p in places])
                texts.append("".join(raw[i:j].decode("utf-8", "ignore") for i, j in kept))
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if i == at else b.column(i) for i in range(b.num_columns - 1)], names=names)

    return rows.mapInArrow(run, docs.schema)
