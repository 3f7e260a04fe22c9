"""Exact similarity join of documents by the Jaccard similarity of their word n-grams, with signature trees.

Texts with equal sets are one node, so copies never meet each other. Two sets as similar as asked share several grams among those that come first in a
common order of grams (rare ones first, those that very many documents hold last): of the first n - ceil(percent n / 100) + l of each, l at least. So a document
with fewer than l of its first grams in any other document is done, and of the rest only documents that share such a gram can be links: a group
for each gram; groups with the same members count once. A group's documents form a signature tree: a node holds the bits that any (OR) and all (AND) of its documents
set and the range of their sizes. Two trees are walked together, and a pair of nodes is left where the sizes exclude each other or the largest
possible overlap is too small: every bit that all on one side set and none on the other is a gram that isn't shared.
All pairs come from the trees; each is then verified on the words of both texts, without hashes.

Pairs within a component need no comparison. So trees are walked three times: first only from a leaf to itself and to the next one, as far as pairs may join
what isn't joined yet; then, for groups whose documents still are in several components and share enough such groups, whole trees against each other for a forest of the
pairs left; then for all pairs left. No link between components is lost, and a large group of near copies costs about one comparison a document.

Groups larger than ``MOST_IN_A_TREE`` are cut into blocks in order of size; of two blocks only those whose sizes allow a link meet. Grams are 64-bit hashes whose
collisions could only add pairs to verify; sets are named by 128 bits (two unlike hashes of all grams), and rows by id and 128 bits of the text.

Defined results: null counts as empty; an empty set links with nothing and is its own component; repeated rows have equal sets and so one component; rows of one id with
different texts are different documents; a null id is never a component's id unless all its ids are null; other columns of the input, whatever their names,
aren't read by the report and stay as they are in ``first_of_groups``; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lattica.llm.components import UnionFind, components
from lattica.llm.util import Tables, chunks, flat, mixed, partitions, slice_hashes, total_bytes, whole_row

#: Grams in more than this share of documents come last in the order; so many of them at most, 24 bytes each, go to the tasks.
COMMON_SHARE, MOST_COMMON = 1 / 500, 1 << 19
#: Bits of a signature for each gram of the set.
BITS_PER_GRAM = 8
#: A signature is first compared folded to a quarter of its width: whoever has no partner then is done.
FIRST_FOLD = 4
#: So many keys of sets to be compared are broadcast at most; more meet their texts in a shuffled join.
BROADCAST_SETS = 100_000
BUCKET_TEXT = 32 << 20
#: Documents of a common gram that meet in one bucket, about; more are dealt to several.
BUCKET_ROWS = 50_000
LEAF, FANOUT = 16, 8
#: Documents of a block of a group.
MOST_IN_A_TREE = 2000
#: Members, about 2 kB each with their signature, that a task of the trees handles.
TREE_ROWS = 3000

_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[ord("A") : ord("Z") + 1] += 32


def _chained(word: np.ndarray, at: np.ndarray, last: np.ndarray, words: int, seed: int) -> np.ndarray:
    """Hashes of runs of words from ``at`` on, none beyond ``last``."""
    gram = np.full(len(at), seed, np.uint64)
    for k in range(words):
        inside = at + k < last
        gram = np.where(inside, mixed(gram * np.uint64(0x9E3779B97F4A7C15) + word[np.minimum(at + k, len(word) - 1)]), gram)
    return gram


def gram_sets(data: np.ndarray, off: np.ndarray, words: int, wide: bool = False) -> tuple[np.ndarray, ...]:
    """Of texts end to end: the sorted distinct gram hashes of each text, and their n + 1 offsets; with ``wide`` also a second hash of each gram."""
    n = len(off) - 1
    data = _FOLD[data]
    doc_of = np.repeat(np.arange(n), np.diff(off))
    blank = _BLANK[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[off] = True
    start = np.flatnonzero(~blank & (edge[:-1] | np.r_[True, blank[:-1]][: len(data)]))
    end = np.flatnonzero(~blank & (edge[1:] | np.r_[blank[1:], True][: len(data)])) + 1
    doc = doc_of[start]
    count = np.bincount(doc, minlength=n)
    first = np.cumsum(count) - count
    size = np.where(count >= words, count - words + 1, (count > 0).astype(count.dtype))
    owner = np.repeat(np.arange(n), size)
    at = np.arange(len(owner)) - np.repeat(np.cumsum(size) - size, size) + first[owner]
    last = first[owner] + count[owner]
    grams = [_chained(word, at, last, words, seed) for word, seed in zip(slice_hashes(data, start, end, wide), (0x5EED, 0xFEED), strict=False)]
    o = np.lexsort((grams[0], owner))
    owner, grams = owner[o], [g[o] for g in grams]
    new = np.r_[True, (grams[0][1:] != grams[0][:-1]) | (owner[1:] != owner[:-1])][: len(owner)]
    owner, grams = owner[new], [g[new] for g in grams]
    return grams[0], np.r_[0, np.cumsum(np.bincount(owner, minlength=n))], *grams[1:]


def _set_ids(gram: np.ndarray, off: np.ndarray) -> np.ndarray:
    """A 64-bit name of each set: equal sets have equal names."""
    total = np.r_[np.uint64(0), np.cumsum(mixed(gram ^ np.uint64(0xA5A5A5A55A5A5A5A)), dtype=np.uint64)]
    return mixed((total[off[1:]] - total[off[:-1]]) ^ mixed(np.diff(off).astype(np.uint64))).view(np.int64)


def _named(data: np.ndarray, off: np.ndarray, words: int, shared: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Grams, offsets and names. Sets whose first name is one of ``shared`` (held by two different sets) go by their second."""
    gram, off, *other = gram_sets(data, off, words, wide=len(shared) > 0)
    sid = _set_ids(gram, off)
    return gram, off, np.where(np.isin(sid, shared), _set_ids(other[0], off), sid) if other else sid


def overlap(x: bytes, y: bytes, words: int) -> tuple[int, int, int]:
    """Sizes of two texts' sets of grams and of what they share, by the words themselves."""
    number: dict[bytes, int] = {}
    x, y = (np.array([number.setdefault(w, len(number)) for w in t.lower().split()], np.int64) for t in (x, y))  # bytes split at the six blanks
    if min(len(x), len(y)) < words:  # a short sequence is one gram, which only its equal holds
        size = lambda t: int(len(t) > 0) if len(t) < words else overlap(b" ".join(b"%d" % w for w in t.tolist()), b" ".join([b"x"] * words), words)[0]
        return size(x), size(y), int(len(x) > 0 and np.array_equal(x, y))
    cut = len(x) - words + 1
    gram = np.r_[x[:cut], y[: len(y) - words + 1]]
    for k in range(1, words):
        if len(number) ** (k + 1) >= 1 << 62:  # numbers anew, so that products fit
            gram = np.unique(gram, return_inverse=True)[1]
        gram = gram * len(number) + np.r_[x[k : k + cut], y[k : k + len(y) - words + 1]]
    a, b = np.unique(gram[:cut]), np.unique(gram[cut:])
    return len(a), len(b), len(np.intersect1d(a, b, True))


def signature(gram: np.ndarray) -> np.ndarray:
    """Bits of a set: their number is the power of two from BITS_PER_GRAM bits a gram on, 64 at least; a wider signature folds onto a narrower one."""
    width = 64
    while width < BITS_PER_GRAM * len(gram):
        width *= 2
    bit = gram >> np.uint64(20) & np.uint64(width - 1)
    out = np.zeros(width, bool)
    out[bit] = True
    return np.packbits(out, bitorder="little").view(np.uint64)


def folded(sig: np.ndarray, words: int) -> np.ndarray:
    """Signatures (rows) narrowed to ``words`` words: bit i goes to i modulo the width."""
    while sig.shape[-1] > words:
        half = sig.shape[-1] // 2
        sig = sig[..., :half] | sig[..., half:]
    return sig


def enough(overlap, sizes, percent: int):
    """Whether 100 * overlap >= percent * union, with sizes the sum of both."""
    return (100 + percent) * overlap >= percent * sizes


def least_overlap(size, percent: int):
    return -(-percent * size // 100)


def shared_firsts(size, percent: int):
    """l: how many of their first grams two documents of this size or more share at least."""
    return np.maximum(1, (size - least_overlap(size, percent) + 1) // 3)


def equal_groups(met: DataFrame) -> DataFrame:
    """(gram, w): of groups (gram, sid) with equal members the one of the least gram, and how many they are; groups of one go. Hashes of sids are summed as decimals: a bigint overflows on large groups."""
    mark = F.xxhash64("sid")
    same = met.groupBy("gram").agg(F.count("*").alias("k"), F.bit_xor(mark).alias("x"), F.sum(mark.cast("decimal(38,0)")).alias("y")).filter("k > 1")
    return same.groupBy("k", "x", "y").agg(F.min("gram").alias("gram"), F.count("*").alias("w")).select("gram", "w")


class _Tree:
    """levels[0]: a node for each LEAF documents, in order of size; each higher level a node for FANOUT below."""

    def __init__(self, size: np.ndarray, sig: np.ndarray):
        self.size, self.sig, self.levels = size, sig, []
        step, cur = LEAF, (sig, sig, size, size)
        while True:
            head = np.arange(0, len(cur[2]), step)
            cur = (np.bitwise_or.reduceat(cur[0], head), np.bitwise_and.reduceat(cur[1], head), np.minimum.reduceat(cur[2], head), np.maximum.reduceat(cur[3], head))
            self.levels.append(cur)
            step = FANOUT
            if len(head) == 1:
                return


def _possible(a, b, percent):
    """For nodes (any, all, least, most): whether documents of both may be as similar as asked."""
    by_a = a[3] - np.bitwise_count(a[1] & ~b[0]).sum(-1, dtype=np.int64)
    by_b = b[3] - np.bitwise_count(b[1] & ~a[0]).sum(-1, dtype=np.int64)
    return enough(np.minimum(by_a, by_b), a[2] + b[2], percent)


def tree_pairs(size, sig, other_size=None, other_sig=None, percent: int = 85, near: bool = False):
    """Index pairs (i, j) that the dual walk leaves, i < j for a tree with itself. Rows are in order of size. With ``near`` (a tree with itself) only from a leaf to itself and the next."""
    own = other_size is None
    a = _Tree(size, sig)
    b = a if own else _Tree(other_size, other_sig)
    leaves = len(a.levels[0][2])
    walk = [(0, i, 0, j) for i in range(leaves) for j in (i, i + 1) if j < leaves] if near else [(len(a.levels) - 1, 0, len(b.levels) - 1, 0)]
    out = []
    while walk:
        la, i, lb, j = walk.pop()
        node_a, node_b = (tuple(x[i] for x in a.levels[la]), tuple(x[j] for x in b.levels[lb]))
        if not _possible(node_a, node_b, percent):
            continue
        if la == lb == 0:
            p, q = np.arange(i * LEAF, min(len(a.size), (i + 1) * LEAF)), np.arange(j * LEAF, min(len(b.size), (j + 1) * LEAF))
            x, y = (a.sig[p][:, None], a.sig[p][:, None], a.size[p][:, None], a.size[p][:, None]), (b.sig[q][None], b.sig[q][None], b.size[q][None], b.size[q][None])
            left, right = np.nonzero(_possible(x, y, percent))
            left, right = p[left], q[right]
            if own and i == j:
                left, right = left[left < right], right[left < right]
            out.append(np.column_stack((left, right)))
            continue
        if la >= lb:
            for k in range(i * FANOUT, min(len(a.levels[la - 1][2]), (i + 1) * FANOUT)):
                if own and la == lb:
                    walk += [(la - 1, k, lb - 1, m) for m in range(j * FANOUT, min(len(b.levels[lb - 1][2]), (j + 1) * FANOUT)) if k <= m]
                else:
                    walk.append((la - 1, k, lb, j))
        else:
            walk += [(la, i, lb - 1, m) for m in range(j * FANOUT, min(len(b.levels[lb - 1][2]), (j + 1) * FANOUT))]
    return np.concatenate(out) if out else np.zeros((0, 2), np.int64)


def group_pairs(size: np.ndarray, sigs: list[np.ndarray], percent: int, near: bool = False):
    """Index pairs of a group that signatures leave. Documents are put together by the width of their signatures, each width with itself and those as wide as the similarity allows.
    With ``near`` each width with itself, leaves with their neighbours; documents are then in order of the first bits, which near copies share, and of size."""
    width = np.array([len(s) for s in sigs])
    by, out = {}, []
    for w in np.unique(width):
        i = np.flatnonzero(width == w)
        i = i[np.argsort(size[i], kind="stable")]
        by[int(w)] = i, np.stack([sigs[k] for k in i])
    for w, (i, s) in by.items():
        if len(i) > 1:
            p = tree_pairs(size[i], s, percent=percent, near=near)
            out.append(np.column_stack((i[p[:, 0]], i[p[:, 1]])))
        if near and len(i) > 2 * LEAF:
            o = np.lexsort((size[i], s[:, 0]))
            p = tree_pairs(size[i][o], s[o], percent=percent, near=True)
            out.append(np.column_stack((i[o][p[:, 0]], i[o][p[:, 1]])))
        wider = 2
        while (wider == 2 or wider * percent < 200) and not near:  # of two similar sets the larger has 100 / percent times the grams at most
            if wider * w in by:
                j, t = by[wider * w]
                p = tree_pairs(size[i], s, size[j], folded(t, w), percent)
                out.append(np.column_stack((i[p[:, 0]], j[p[:, 1]])))
            wider *= 2
    return np.concatenate(out) if out else np.zeros((0, 2), np.int64)


class _Join:
    def __init__(self, docs: DataFrame, words: int, percent: int, id_col: str, text_col: str):
        self.words, self.percent, self.spark = words, percent, docs.sparkSession
        self.tables = Tables(self.spark)
        self.rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).withColumn("th", F.md5("text"))
        self.bytes = total_bytes(self.rows, "text")
        self._scan()

    def _scan(self):
        """One pass: each row's set (its names, size, signature), and the grams that many rows of a chunk share."""
        words = self.words
        kind = self.rows.schema["id"].dataType.simpleString()
        names = ["id", "th", "n", "sid", "sid2", "sig", "small", "gram", "k"]

        def run(batches):
            for part in chunks(batches, "text"):
                gram, off, other = gram_sets(*flat(part.column(1)), words, wide=True)
                size, sid, sid2 = np.diff(off), _set_ids(gram, off), _set_ids(other, off)
                sigs = [signature(gram[a:b]) if b > a else None for a, b in zip(off[:-1], off[1:], strict=True)]
                small = [None if x is None else folded(x, max(1, len(x) // FIRST_FOLD)).tobytes() for x in sigs]
                sigs = [None if x is None else x.tobytes() for x in sigs]
                n = part.num_rows
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(size.astype(np.int64)), pa.array(sid, mask=size == 0), pa.array(sid2, mask=size == 0), pa.array(sigs, pa.binary()), pa.array(small, pa.binary()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64())], names=names)
                held, k = np.unique(gram, return_counts=True)
                many = k >= max(2, COMMON_SHARE * n)
                held, k = held[many], k[many]
                m = len(held)
                if m:
                    yield pa.RecordBatch.from_arrays([pa.nulls(m, part.column(0).type), *(pa.nulls(m, t) for t in (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary())), pa.array(held.view(np.int64)), pa.array(k.astype(np.int64))], names=names)

        scan = self.scan = self.tables.stored(self.rows.mapInArrow(run, f"id {kind}, th string, n long, sid long, sid2 long, sig binary, small binary, gram long, k long"), "sets")
        # two sets of one name are expected once among 10**10; they go by their second name
        self.shared = np.sort(np.asarray(scan.filter("sid IS NOT NULL").groupBy("sid").agg(F.min("sid2").alias("x"), F.max("sid2").alias("y")).filter("x <> y").select("sid").toArrow()["sid"], np.int64))
        if len(self.shared):
            scan = scan.withColumn("sid", F.when(F.col("sid").isin(self.shared.tolist()), F.col("sid2")).otherwise(F.col("sid")))
        self.base = scan.filter("gram IS NULL").select("id", "th", "n", "sid")
        self.sigs = scan.filter("sid IS NOT NULL").select("sid", "sig", "small")
        n = self.base.count()
        common = scan.filter("gram IS NOT NULL").groupBy("gram").agg(F.sum("k").alias("k")).filter(F.col("k") >= max(8, COMMON_SHARE * n / 2))
        common = common.orderBy(F.col("k").desc(), "gram").limit(MOST_COMMON).toArrow()  # any choice keeps the result; this one keeps groups small
        gram, k = np.asarray(common["gram"], np.int64).view(np.uint64), np.asarray(common["k"], np.int64)
        o = np.argsort(gram)
        self.common = gram[o], (len(gram) - np.arange(len(gram)))[o], -(-k // BUCKET_ROWS)[o]  # the most frequent last; the buckets of each

    def groups(self) -> DataFrame:
        """(gram, sid, n, need, w): sets that share one of their first grams with a different set; of groups with equal members one, w says how many they are."""
        words, percent, shared = self.words, self.percent, self.shared
        buckets = partitions(self.spark, self.bytes, BUCKET_TEXT)
        common = self.spark.sparkContext.broadcast(self.common)

        def firsts(batches):
            held, late, deals = common.value
            for part in chunks(batches, "text"):
                gram, off, sid = _named(*flat(part.column(0)), words, shared)
                size = np.diff(off)
                owner = np.repeat(np.arange(len(size)), size)
                deal = np.ones(len(gram), np.int64)
                if len(held) and len(gram):
                    at = np.minimum(np.searchsorted(held, gram), len(held) - 1)
                    is_common = held[at] == gram
                    o = np.lexsort((gram, np.where(is_common, late[at], 0), owner))
                    gram, deal = gram[o], np.where(is_common, deals[at], 1)[o]
                first = size - least_overlap(size, percent) + shared_firsts(size, percent)
                keep = np.arange(len(gram)) - off[owner] < first[owner]
                gram, owner, deal = gram[keep], owner[keep], deal[keep]
                sid, n = sid[owner], size[owner].astype(np.int32)
                o = np.lexsort((sid, gram))
                gram, sid, n, deal = gram[o], sid[o], n[o], deal[o]
                new = np.r_[True, (gram[1:] != gram[:-1]) | (sid[1:] != sid[:-1])][: len(gram)]  # copies within the chunk once
                gram, sid, n, deal = gram[new], sid[new], n[new], deal[new]
                salt = mixed(sid.view(np.uint64)) % deal.astype(np.uint64)  # a set's copies meet in the same one
                bucket = (mixed(gram + salt) % np.uint64(buckets)).astype(np.int32)
                n = np.where(deal > 1, -n, n)  # dealt to several: may be alone in a bucket without being alone
                o = np.argsort(bucket, kind="stable")
                cut = np.r_[np.flatnonzero(np.diff(bucket[o], prepend=-1)), len(o)]
                packed = [[x[o[i:j]].tobytes() for i, j in zip(cut[:-1], cut[1:], strict=True)] for x in (gram, sid, n)]
                yield pa.RecordBatch.from_arrays([pa.array(bucket[o[cut[:-1]]]), *(pa.array(x, pa.binary()) for x in packed)], names=["b", "g", "s", "n"])

        def meet(table: pa.Table) -> pa.Table:
            g, s, n = (np.frombuffer(b"".join(table[k].to_pylist()), v) for k, v in (("g", np.uint64), ("s", np.int64), ("n", np.int32)))
            o = np.lexsort((s, g))
            g, s, n = g[o], s[o], n[o]
            new = np.r_[True, (g[1:] != g[:-1]) | (s[1:] != s[:-1])][: len(g)]
            g, s, n = g[new], s[new], n[new]
            head = np.r_[True, g[1:] != g[:-1]][: len(g)]
            size = np.diff(np.r_[np.flatnonzero(head), len(g)])
            many = np.repeat(size > 1, size) | (n < 0)
            n = np.abs(n[many])
            need = shared_firsts(least_overlap(n.astype(np.int64), percent), percent)  # of the smallest partner there may be
            return pa.table({"gram": g[many].view(np.int64), "sid": s[many], "n": n, "need": need.astype(np.int32)})

        met = self.rows.select("text").mapInArrow(firsts, "b int, g binary, s binary, n binary").groupBy("b").applyInArrow(meet, "gram long, sid long, n int, need int")
        met = self.tables.stored(met, "members")
        rich = met.groupBy("sid").agg(F.count("*").alias("k"), F.first("need").alias("need")).filter("k >= need").select("sid")
        met = self.tables.stored(met.join(rich, "sid", "left_semi"), "members")
        return self.tables.stored(met.join(equal_groups(met), "gram"), "groups")

    def compared(self, pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) that are links, by the words of a text of each set."""
        words, percent, shared = self.words, self.percent, self.shared
        wanted = pairs.select(F.col("a").alias("sid")).unionByName(pairs.select(F.col("b").alias("sid"))).distinct()
        n_pairs = pairs.count()
        if not n_pairs:
            return pairs
        if 2 * n_pairs > BROADCAST_SETS:
            wanted = self.tables.stored(wanted, "wanted")
        texts = self.base.join(wanted, "sid", "left_semi").groupBy("sid").agg(F.min("th").alias("th")).select("th").distinct()
        small = 2 * n_pairs <= BROADCAST_SETS or wanted.count() <= BROADCAST_SETS

        def run(batches):
            for part in chunks(batches, "text"):
                sid = _named(*flat(part.column(0)), words, shared)[2]
                yield pa.RecordBatch.from_arrays([pa.array(sid), part.column(0)], names=["sid", "text"])

        read = self.rows.join(F.broadcast(texts) if small else texts, "th", "left_semi").select("text", "th")
        read = read.groupBy("th").agg(F.first("text").alias("text")).select("text")  # copies are read once
        sets = self.tables.stored(read.mapInArrow(run, "sid long, text string").dropDuplicates(["sid"]), "wanted-sets")

        def verified(batches):
            for b in batches:
                keep = []
                for x, y in zip(b.column(2), b.column(3), strict=True):
                    n, m, both = overlap(x.as_buffer().to_pybytes(), y.as_buffer().to_pybytes(), words)
                    keep.append(bool(both and enough(both, n + m, percent)))
                yield pa.RecordBatch.from_arrays([c.filter(pa.array(keep, pa.bool_())) for c in b.columns[:2]], names=["a", "b"])

        met = pairs.join(sets.select(F.col("sid").alias("a"), F.col("text").alias("x")), "a").join(sets.select(F.col("sid").alias("b"), F.col("text").alias("y")), "b")
        return self.tables.stored(met.select("a", "b", "x", "y").mapInArrow(verified, "a long, b long"), "links")

    def _signatures(self, members: DataFrame, n: int, column: str) -> DataFrame:
        """(sid, sig) of the sets in members, which have n rows."""
        needed = members.select("sid").distinct()
        few = n <= BROADCAST_SETS or needed.count() <= BROADCAST_SETS
        return self.sigs.join(F.broadcast(needed) if few else needed, "sid", "left_semi").select("sid", F.col(column).alias("sig")).dropDuplicates(["sid"])

    def residual(self, groups: DataFrame, roots: DataFrame) -> DataFrame:
        """(gram, sid, n, root): members of groups with several components that share enough such groups to have a link to another component."""

        def several(m):
            mixed_groups = m.groupBy("gram").agg(F.min("root").alias("x"), F.max("root").alias("y")).filter("x <> y").select("gram")
            return m.join(mixed_groups, "gram", "left_semi")

        members = self.tables.stored(several(self._rooted(groups, roots)), "members")
        rich = members.groupBy("sid").agg(F.sum("w").alias("k"), F.first("need").alias("need")).filter("k >= need").select("sid")
        return self.tables.stored(several(members.join(rich, "sid", "left_semi")).select("gram", "sid", "n", "root"), "members")

    def _rooted(self, members: DataFrame, roots: DataFrame) -> DataFrame:
        return members.join(roots.select(F.col("node").alias("sid"), "root"), "sid", "left").withColumn("root", F.coalesce("root", "sid"))

    def _blocks(self, members: DataFrame, most: int, near: bool) -> DataFrame:
        """members with blk, and i and j, a pair of blocks of the group that a row goes to; the largest group has ``most`` rows. Blocks follow each other by size; rows of one size are dealt by hash, so no group is sorted in one task."""
        whole = [F.lit(0).alias(c) for c in ("blk", "i", "j")]
        if most <= MOST_IN_A_TREE:
            return members.select("*", *whole)
        large = members.groupBy("gram").agg(F.count("*").alias("k")).filter(F.col("k") > MOST_IN_A_TREE).select("gram")
        large = self.tables.stored(large, "large")  # members / MOST_IN_A_TREE rows at most
        few = members.join(large, "gram", "left_anti").select("*", *whole)
        many = members.join(large, "gram", "left_semi")
        sizes = many.groupBy("gram", "n").agg(F.count("*").alias("k"))
        sizes = sizes.select("gram", "n", "k", (F.sum("k").over(W.partitionBy("gram").orderBy("n")) - F.col("k")).alias("before"))  # a row for each size
        place = F.col("before") + F.floor(F.pmod(F.xxhash64("sid"), F.lit(1 << 20)) * F.col("k") / (1 << 20))
        many = many.join(sizes, ["gram", "n"]).withColumn("blk", F.floor(place / MOST_IN_A_TREE).cast("int")).drop("k", "before")
        if near:
            return few.unionByName(many.select("*", F.col("blk").alias("i"), F.col("blk").alias("j")))
        spans = self.tables.stored(many.groupBy("gram", "blk").agg(F.min("n").alias("least"), F.max("n").alias("most")), "blocks")
        a, b = (spans.select("gram", *[F.col(c).alias(f"{c}_{s}") for c in ("blk", "least", "most")]) for s in "ij")
        met = a.join(b, "gram").filter((F.col("blk_i") <= F.col("blk_j")) & (F.col("most_i") * 100 >= F.col("least_j") * self.percent))
        met = met.select("gram", F.col("blk_i").alias("i"), F.col("blk_j").alias("j"))
        met = met.select("gram", F.explode(F.array_distinct(F.array("i", "j"))).alias("blk"), "i", "j")
        return few.unionByName(many.join(met, ["gram", "blk"]).select(*few.columns))

    def _by_tree(self, members: DataFrame, column: str, made, schema: str, named: bool = False, near: bool = False) -> DataFrame:
        """``made(pairs left by group, sids, roots, the first gram that two rows share)`` over the groups of members (gram, sid, n, root); large groups in blocks."""
        percent = self.percent
        rows, most = members.groupBy("gram").agg(F.count("*").alias("k")).agg(F.coalesce(F.sum("k"), F.lit(0)), F.coalesce(F.max("k"), F.lit(0))).first()
        m = self._blocks(members.select("gram", "sid", "n", "root"), most, near)
        shards = max(int(self.spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // TREE_ROWS))
        sigs = self._signatures(members, rows, column)
        if named:  # each set's grams, no more than its first ones
            sigs = sigs.join(members.groupBy("sid").agg(F.sort_array(F.collect_list("gram")).alias("own")), "sid")
        m = m.join(sigs, "sid").select("gram", "i", "j", "blk", "sid", "n", "root", "sig", *["own"] * named)

        def run(table: pa.Table) -> pa.Table:
            gram, first, second, blk, sid, n, root = (np.asarray(table[k]).astype(np.int64) for k in ("gram", "i", "j", "blk", "sid", "n", "root"))
            sigs = table["sig"].combine_chunks()
            if named:
                own = table["own"].combine_chunks()
                listed, at = np.asarray(own.flatten()), np.asarray(own.offsets) - (own.offsets[0].as_py() if len(own) else 0)

            def first_shared(x, y):
                return np.intersect1d(listed[at[x] : at[x + 1]], listed[at[y] : at[y + 1]], True)[0]

            o = np.lexsort((sid, n, second, first, gram))
            key = np.column_stack((gram, first, second))[o]
            cut = np.r_[np.flatnonzero(np.r_[True, (key[1:] != key[:-1]).any(1)][: len(o)]), len(o)]

            def left():
                for a, b in zip(cut[:-1], cut[1:], strict=True):
                    i = o[a:b]
                    if len(i) < 2:
                        continue
                    p = group_pairs(n[i], [np.frombuffer(sigs[int(k)].as_buffer(), np.uint64) for k in i], percent, near)
                    x, y = i[p[:, 0]], i[p[:, 1]]
                    ok = root[x] != root[y]
                    if first[i[0]] != second[i[0]]:
                        ok &= blk[x] != blk[y]
                    yield int(gram[i[0]]), x[ok], y[ok]

            return made(left(), sid, root, first_shared)

        return m.withColumn("b", F.pmod(F.xxhash64("gram", "i", "j"), F.lit(shards)).cast("int")).groupBy("b").applyInArrow(run, schema).distinct()

    def hopeful(self, members: DataFrame) -> DataFrame:
        """The members that narrow signatures leave a partner in another component."""

        def made(groups, sid, root, first_shared):
            grams, sids = [], []
            for gram, x, y in groups:
                s = np.unique(sid[np.r_[x, y]])
                grams.append(np.full(len(s), gram, np.int64))
                sids.append(s)
            none = [np.zeros(0, np.int64)]
            return pa.table({"gram": np.concatenate(grams or none), "sid": np.concatenate(sids or none)})

        kept = self._by_tree(members, "small", made, "gram long, sid long")
        return self.tables.stored(members.drop("root").join(kept, ["gram", "sid"], "left_semi"), "hopeful")

    def across(self, members: DataFrame, column: str, forest: bool, near: bool = False) -> DataFrame:
        """Pairs of a group in different components that the signature trees leave; with forest only as many as may join all.

        Of the groups that a pair shares only that of the least gram names it, where all pairs are wanted."""

        def made(groups, sid, root, first_shared):
            pairs, held = set(), UnionFind()
            for gram, x, y in groups:
                for i, j in zip(x.tolist(), y.tolist(), strict=True):
                    if not forest and first_shared(i, j) != gram:
                        continue
                    if not forest or held.join(int(root[i]), int(root[j])):
                        pairs.add((min(int(sid[i]), int(sid[j])), max(int(sid[i]), int(sid[j]))))
            p = np.array(sorted(pairs), np.int64).reshape(-1, 2)
            return pa.table({"a": p[:, 0], "b": p[:, 1]})

        return self._by_tree(members, column, made, "a long, b long", named=not forest, near=near)

    def roots(self) -> DataFrame:
        """(node, root) of sets that have links."""
        groups = self.groups()
        tried = self.tables.stored(self.across(groups.withColumn("root", F.col("sid")), "small", forest=True, near=True), "pairs")
        links = self.compared(tried)
        roots = self.tables.stored(components(links), "roots")
        members = self.residual(groups, roots)
        some = not members.isEmpty()
        members = self.hopeful(members) if some else members
        for forest in (True, False) if some else ():
            rooted = self._rooted(members, roots)
            mixed_groups = rooted.groupBy("gram").agg(F.min("root").alias("x"), F.max("root").alias("y")).filter("x <> y").select("gram")
            rooted = self.tables.stored(rooted.join(mixed_groups, "gram", "left_semi"), "members")
            if rooted.isEmpty():
                break
            pairs = self.tables.stored(self.across(rooted, "sig", forest).join(tried, ["a", "b"], "left_anti"), "pairs")
            found = self.compared(pairs)
            if found is not pairs:
                links, tried = links.unionByName(found), tried.unionByName(pairs)
                roots = self.tables.stored(components(links), "roots")
        self.tables.drop(self.scan, roots)
        return roots


def _grouped(docs, words, percent, id_col, text_col) -> DataFrame:
    """(id, th, n, least): least is (o, i, t), the row of the component that comes first by id and text; null for empty sets.

    The least of each set, then of each component, are aggregates that combine before the shuffle; written tables carry them back, so that no join sits on an aggregate's partitioning
    and Spark can split a component or set that very many rows are in."""
    j = _Join(docs, words, percent, id_col, text_col)
    roots = j.roots()
    order = F.struct(F.col("id").isNull().alias("o"), F.col("id").alias("i"), F.col("th").alias("t"))
    sets = j.base.filter("sid IS NOT NULL").groupBy("sid").agg(F.min(order).alias("own"))
    sets = j.tables.stored(sets.join(roots.select(F.col("node").alias("sid"), "root"), "sid", "left").withColumn("root", F.coalesce("root", "sid")), "sets")
    least = j.tables.stored(sets.groupBy("root").agg(F.min("own").alias("least")), "least")
    named = j.tables.stored(sets.join(least, "root").select("sid", "least"), "named")
    j.tables.drop(j.scan, named)
    return j.base.join(named, "sid", "left").select("id", "th", "n", "least")


def component_report(docs: DataFrame, words: int = 4, percent: int = 85, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_shingles, component_id) for every document; component_id is the smallest id that links reach."""
    g = _grouped(docs, words, percent, id_col, text_col)
    return g.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("least.i", "id").alias("component_id"))


def first_of_groups(docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents, with their columns, that come first by id in their component; all documents without grams; of rows with equal id and text all or none."""
    g = _grouped(docs, words, percent, id_col, text_col)
    first = F.col("id").eqNullSafe(F.col("least.i")) & (F.col("th") == F.col("least.t"))
    gone = g.filter(F.col("least").isNotNull() & ~first).select(F.col("id").alias("gone"), F.col("th").alias("gone_th")).distinct()
    rows = docs.select(whole_row(docs).alias("doc"), F.col(id_col).alias("id"), F.md5(F.coalesce(F.col(text_col).cast("string"), F.lit(""))).alias("th"))
    return rows.join(gone, F.col("id").eqNullSafe(F.col("gone")) & (F.col("th") == F.col("gone_th")), "left_anti").select("doc.*")
