"""Periodic runs of words: stretches that repeat a period several times over, found in linear structures.

The method is Gusfield and Stoye's. Over a suffix tree of the words:

1. The text is cut into Lempel-Ziv blocks, each the longest piece that also starts earlier. A square (a piece twice in a row) whose type is new touches a block border in one of two ways, so
   common extensions at the borders give for every type of square a leftmost one or one that rotates into it: the leftmost-covering squares.
2. From each, suffix-link walks go through the tree: the square's first word is taken off and asked for at the end. Steps that stay on one place of the text are taken all at once.
   The walks complete the vocabulary: every type of square, each a place in the tree.
3. The leaves below a place are the occurrences of its square. Occurrences of one period that follow each other merge into runs.

Only squares whose half is no repetition itself are kept, so a run's period is its smallest. The tree is held as a suffix array with common prefixes (a node is an interval and a depth), made by doubling;
the tables of the doubling answer common extensions to the right and to the left. All steps are array operations over a batch of texts, joined by words that are found once; texts don't see each other.

Words that no run of the asked length can hold are cut out first: a run of length L and period q repeats each of its pieces of ``least - least // exponent`` words, as L - q is no less. So only stretches
that such repeated pieces cover (compared by 64-bit hashes: a collision costs time, no result) are looked at. Memory is bounded by a chunk of texts or the longest text.

Defined results: null counts as the empty text; texts without words have no runs; texts of any length are searched whole; repeated rows get equal results; an empty table gives an empty result; columns other
than those named are not read, and in ``collapsed`` stay as they are whatever their names.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from fractions import Fraction
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from lattica.llm.util import chunks, mixed, quoted

#: Bytes of text of which one batch of arrays is made (a longer text is a batch of its own).
BATCH_BYTES = 4 << 20


class Tree:
    """Suffix tree of an array of whole numbers whose last element is found once, as suffix array, ranks, common prefixes and tables of doubling."""

    def __init__(self, symbols: np.ndarray):
        self.n = n = len(symbols)
        self.symbols = np.unique(symbols, return_inverse=True)[1].astype(np.int64)
        self.names = [self.symbols.astype(np.int32)]  # by level: order of the pieces of 2**level symbols
        while (top := self.names[-1]).max() + 1 < n:
            step = 1 << (len(self.names) - 1)
            after = np.zeros(n, np.int64)
            after[:-step] = top[step:] + 1
            self.names.append(np.unique(top * np.int64(n + 1) + after, return_inverse=True)[1].astype(np.int32))
        self.rank = self.names[-1].astype(np.int64)
        self.order = np.empty(n, np.int64)
        self.order[self.rank] = np.arange(n)
        common = np.zeros(n, np.int64)
        common[1:] = self.right(self.order[:-1], self.order[1:])
        self.least = [common]  # by level: the least common prefix of 2**level neighbours, from each on
        while (1 << len(self.least)) < n:
            low, step = self.least[-1], 1 << (len(self.least) - 1)
            self.least.append(np.minimum(low[:-step], low[step:]) if len(low) > step else low[:0])

    def right(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How far the texts from i and from j on are equal (i differs from j; both below n)."""
        out = np.zeros(len(i), np.int64)
        for level in range(len(self.names) - 2, -1, -1):
            name = self.names[level]
            out += (name[i + out] == name[j + out]).astype(np.int64) << level
        return out

    def left(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How far the texts up to i and up to j, those included, are equal; -1 is before the text."""
        out = np.zeros(len(i), np.int64)
        for level in range(len(self.names) - 2, -1, -1):
            name, a, b = self.names[level], i - out - (1 << level) + 1, j - out - (1 << level) + 1
            out += ((a >= 0) & (b >= 0) & (name[np.maximum(a, 0)] == name[np.maximum(b, 0)])).astype(np.int64) << level
        return out

    def place(self, at: np.ndarray, depth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where in the tree the text from ``at`` on ends after ``depth`` symbols: first and last rank of the leaves below."""
        low, high = self.rank[at].copy(), self.rank[at].copy()
        for level in range(len(self.least) - 1, -1, -1):
            table, step = self.least[level], 1 << level
            if not len(table):
                continue
            a = low - step + 1
            ok = (a >= 1) & (table[np.clip(a, 0, len(table) - 1)] >= depth)
            low[ok] -= step
            b = high + 1
            ok = (b < len(table)) & (table[np.minimum(b, len(table) - 1)] >= depth)
            high[ok] += step
        return low, high

    def child(self, low: np.ndarray, high: np.ndarray, depth: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        """First rank in the place whose suffix goes on with ``symbol`` after ``depth`` symbols, or -1."""
        a, b = low.copy(), high + 1
        value = lambda r: self.symbols[np.minimum(self.order[np.minimum(r, self.n - 1)] + depth, self.n - 1)]
        while (live := a < b).any():
            m = (a + b) // 2
            less = live & (value(m) < symbol)
            a = np.where(less, m + 1, a)
            b = np.where(live & ~less, m, b)
        return np.where((a <= high) & (value(a) == symbol), a, -1)

    def blocks(self) -> np.ndarray:
        """Starts of the Lempel-Ziv blocks, and n: the longest earlier piece is at a suffix's nearest neighbours, in order, that start earlier."""
        order, n = self.order.tolist(), self.n
        before, after, stack = np.full(n, -1, np.int64), np.full(n, -1, np.int64), []
        for p in order:
            while stack and stack[-1] > p:
                after[stack.pop()] = p
            if stack:
                before[p] = stack[-1]
            stack.append(p)
        longest = np.ones(n, np.int64)
        for other in (before, after):
            i = np.flatnonzero(other >= 0)
            longest[i] = np.maximum(longest[i], self.right(i, other[i]))
        longest, out, at = longest.tolist(), [], 0
        while at < n:
            out.append(at)
            at += longest[at]
        return np.array([*out, n], np.int64)


def _upto(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows 0..counts[g]-1 of every group g, as (group, row)."""
    group = np.repeat(np.arange(len(counts)), counts)
    return group, np.arange(len(group)) - np.repeat(np.cumsum(counts) - counts, counts)


def leftmost_squares(tree: Tree) -> tuple[np.ndarray, np.ndarray]:
    """(start, half) of squares at block borders: for every type of square one that is, or rotates to the right into, its leftmost occurrence."""
    cuts = tree.blocks()
    size = np.diff(cuts)
    found = []
    # across the border to the next block, the left half's start in this block
    g, k = _upto(np.where(cuts[1:] < tree.n, size, 0))
    k += 1
    border = cuts[g + 1]
    found.append((border - k, border, k))
    # around this block's start, up to the end of the next block
    g, k = _upto(np.minimum(size + np.append(size[1:], 0), tree.n - 1 - cuts[:-1]))
    k += 1
    found.append((cuts[g], cuts[g] + k, k))
    one, two, k = (np.concatenate(x) for x in zip(*found))
    ahead = tree.right(one, two)
    keep = ahead > 0
    one, two, k, ahead = one[keep], two[keep], k[keep], ahead[keep]
    back = tree.left(one - 1, two - 1)
    keep = ahead + back >= k
    one, k, back = one[keep], k[keep], back[keep]
    return np.maximum(one - back, one - k + 1), k


def primitive(tree: Tree, at: np.ndarray, half: np.ndarray) -> np.ndarray:
    """Whether the half of the square is no repetition: of none of its prime parts is the square periodic."""
    ok = np.ones(len(at), bool)
    if not len(at):
        return ok
    factor = np.arange(int(half.max()) + 1)  # the smallest prime factor
    for p in range(2, int(len(factor) ** 0.5) + 1):
        if factor[p] == p:
            of = factor[p * p :: p]
            of[of == np.arange(p * p, len(factor), p)] = p
    rest = half.copy()
    live = np.flatnonzero(rest > 1)
    while len(live):
        p = factor[rest[live]]
        part = half[live] // p
        ok[live] &= tree.right(at[live], at[live] + part) < 2 * half[live] - part
        rest[live] //= p
        live = live[(rest[live] > 1) & ok[live]]
    return ok


def vocabulary(tree: Tree) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Every type of primitive square as (first rank, last rank, half)."""
    at, half = leftmost_squares(tree)
    keep = primitive(tree, at, half)
    at, half = at[keep], half[keep]
    base, seen_runs, seen = tree.n + 1, set(), set()
    places = []
    while len(at):
        # the stretch of text around each square that keeps its period; a stretch is walked once
        start = at - tree.left(at - 1, at + half - 1)
        key, first = np.unique(start * base + half, return_index=True)
        fresh = first[[x not in seen_runs for x in key.tolist()]]
        seen_runs.update(key.tolist())
        start, half = start[fresh], half[fresh]
        if not len(start):
            break
        end = start + half + tree.right(start, start + half)
        turns = np.minimum(half, end - start - 2 * half + 1)  # steps of the walk that stay here
        g, k = _upto(turns)
        low, high = tree.place(start[g] + k, 2 * half[g])
        key, first = np.unique(low * base + half[g], return_index=True)
        fresh = first[[x not in seen for x in key.tolist()]]
        seen.update(key.tolist())
        places.append((low[fresh], high[fresh], half[g][fresh]))
        # steps that leave it: the link from the last square, then its first word again, wherever that is found
        on = np.flatnonzero(turns < half)
        last = start[on] + turns[on] - 1
        half = half[on]
        low, high = tree.place(last + 1, 2 * half - 1)
        rank = tree.child(low, high, 2 * half - 1, tree.symbols[last])
        keep = rank >= 0
        keep[keep] = [x not in seen for x in (rank[keep] * base + half[keep]).tolist()]
        at, half = tree.order[rank[keep]], half[keep]
    return tuple(np.concatenate(x) for x in zip(*places)) if places else (np.zeros(0, np.int64),) * 3


def runs_of(symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, period) of all runs that hold a square, in order of period and start. The last symbol, and those between texts, are found once."""
    none = (np.zeros(0, np.int64),) * 3
    if len(symbols) < 3:
        return none
    tree = Tree(symbols)
    low, high, half = vocabulary(tree)
    if not len(low):
        return none
    g, k = _upto(high - low + 1)
    at, half = tree.order[low[g] + k], half[g]
    order = np.lexsort((at, half))
    at, half = at[order], half[order]
    new = np.append(True, (np.diff(at) != 1) | (np.diff(half) != 0))
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(at)) - 1
    return at[first], at[last] - at[first] + 2 * half[first], half[first]


def _stretches(words: np.ndarray, ends: np.ndarray, piece: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the stretches that pieces of so many words cover, each found twice or more in its text. words: numbers end to end; ends: where texts end."""
    n, none = len(words), (np.zeros(0, np.int64),) * 2
    if n < piece + 1:
        return none
    held, width, have = mixed(words.astype(np.uint64) + np.uint64(1)), 1, None
    done = 0
    while done < piece:  # hashes of pieces of the binary parts of its length
        if piece & width:
            have = held[: n - piece + 1] if have is None else mixed(have * np.uint64(0x9E3779B97F4A7C15) + held[done : done + n - piece + 1])
            done += width
        if done < piece:
            held = mixed(held[:-width] * np.uint64(0xD1B54A32D192ED03) + held[width:]) if len(held) > width else held[:0]
            width *= 2
    text = np.searchsorted(ends, np.arange(len(have)), "right")
    ok = np.flatnonzero(np.arange(len(have)) + piece <= ends[np.minimum(text, len(ends) - 1)])
    key = mixed(have[ok] + text[ok].astype(np.uint64) * _ODD)
    order = np.argsort(key, kind="stable")
    same = key[order[1:]] == key[order[:-1]]
    twice = np.zeros(len(ok), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    at = ok[twice]
    cover = np.zeros(n + 1, np.int64)
    np.add.at(cover, at, 1)
    np.add.at(cover, at + piece, -1)
    inside = np.cumsum(cover[:-1]) > 0
    turn = np.diff(np.concatenate(([0], inside.astype(np.int8), [0])))
    a, b = np.flatnonzero(turn == 1), np.flatnonzero(turn == -1)
    # a stretch that crosses texts is cut at their ends
    inner = ends[:-1][(ends[:-1] > 0) & (ends[:-1] < n)] if len(ends) > 1 else ends[:0]
    inner = np.unique(inner)
    inner = inner[inside[inner] & inside[inner - 1]] if len(inner) else inner
    return np.sort(np.concatenate((a, inner))), np.sort(np.concatenate((b, inner)))


_ODD = np.uint64(0xBF58476D1CE4E5B9)


def runs_of_texts(words: np.ndarray, ends: np.ndarray, least: int, exponent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, start in it, length, period) of runs of ``least`` words and ``exponent`` (2 or more) periods at least, by text, start and period."""
    if exponent < 2 or least < 2:
        raise ValueError("runs hold two periods and two words at least")
    start, end = _stretches(words, ends, least - least // exponent)
    if not len(start):
        return (np.zeros(0, np.int64),) * 4
    # the stretches one after the other, a number of its own after each
    g, k = _upto(end - start + 1)
    source = start[g] + k
    symbols = np.where(source < end[g], words[np.minimum(source, len(words) - 1)], int(words.max()) + 1 + g)
    at, length, period = runs_of(symbols)
    keep = length >= np.maximum(least, exponent * period)
    at, length, period = source[at[keep]], length[keep], period[keep]
    text = np.searchsorted(ends, at, "right")
    order = np.lexsort((period, at, text))
    begin = np.append(0, ends[:-1])[text]
    return text[order], (at - begin)[order], length[order], period[order]


class Batch:
    """The words (bytes without ASCII white space) of some texts and their runs."""

    def __init__(self, texts: list[bytes | None], least: int, exponent: int, ids: list | None = None, edit=None):
        self.words = [(t or b"").split() for t in texts]
        if edit is not None:
            self.words = [edit(i, w) for i, w in zip(ids, self.words)]
        number = defaultdict(count().__next__)
        ends = np.cumsum([len(w) for w in self.words], dtype=np.int64)
        flat = np.fromiter((number[x] for w in self.words for x in w), np.int64, int(ends[-1]) if len(ends) else 0)
        text, *found = runs_of_texts(flat, ends, least, exponent)
        cuts = np.searchsorted(text, np.arange(len(texts) + 1)).tolist()
        found = list(zip(*(x.tolist() for x in found)))
        self.runs = [found[a:b] for a, b in zip(cuts, cuts[1:])]

    def kept(self, k: int) -> list[bytes]:
        """Words of text k that no run holds after its first period."""
        words, runs = self.words[k], self.runs[k]
        if not runs:
            return words
        turn = np.zeros(len(words) + 1, np.int64)
        for start, length, period in runs:
            turn[start + period] += 1
            turn[start + length] -= 1
        return [words[i] for i in np.flatnonzero(np.cumsum(turn[:-1]) == 0).tolist()]


def _batches(batches, column: str = "text"):
    for part in chunks(batches, column, BATCH_BYTES):
        yield part, part.column(part.schema.get_field_index(column)).to_pylist()


def runs(df: DataFrame, least: int = 24, exponent: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, start, length, period): a row for each run, counted in words from 0."""
    source = df.select(F.col(quoted(id_col)).alias("id"), F.col(quoted(text_col)).cast("string").cast("binary").alias("text"))
    out = StructType([source.schema["id"], *[StructField(c, LongType()) for c in ("start", "length", "period")]])

    def run(batches):
        for part, texts in _batches(batches):
            found = [(k, *r) for k, rs in enumerate(Batch(texts, least, exponent).runs) for r in rs]
            k, *rest = zip(*found) if found else ((),) * 4
            yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(k, pa.int64())), *[pa.array(x, pa.int64()) for x in rest]], names=out.names)

    return source.mapInArrow(run, out).withColumnRenamed("id", id_col)


def collapsed(df: DataFrame, least: int = 24, exponent: int = 3, text_col: str = "text") -> DataFrame:
    """The input's columns; a text with runs keeps of each its first period, its words joined by single spaces; texts without runs, and null, stay as they are."""
    at = df.columns.index(text_col)
    source = df.toDF(*[f"c{k}" for k in range(len(df.columns))])  # by place: names of the input may be any
    source = source.select(*source.columns, F.col(f"c{at}").cast("string").cast("binary").alias("text"))
    fields = [StructField(f.name, StringType()) if k == at else f for k, f in enumerate(df.schema.fields)]

    def run(batches):
        for part, texts in _batches(batches):
            batch = Batch(texts, least, exponent)
            new = [b" ".join(batch.kept(k)) if rs else texts[k] for k, rs in enumerate(batch.runs)]
            columns = list(part.columns[:-1])
            columns[at] = pa.array(new, pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in fields])

    return source.mapInArrow(run, StructType(fields))


def report(df: DataFrame, least: int = 24, exponent: int = 3, id_col: str = "doc_id", text_col: str = "text", edit=None) -> DataFrame:
    """(id, n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256): the run of most periods (ties: smallest start, then period), digests of all runs and of the words kept.
    edit: a function of (decimal id as bytes, empty for null; words) that gives the words to search in place of the text's."""
    source = df.select(F.col(quoted(id_col)).alias("id"), F.coalesce(F.col(quoted(id_col)).cast("string"), F.lit("")).cast("binary").alias("key"), F.col(quoted(text_col)).cast("string").cast("binary").alias("text"))
    longs = ("n_runs", "start", "length", "period", "exponent_milli")
    out = StructType([source.schema["id"], *[StructField(c, LongType()) for c in longs], *[StructField(c, StringType()) for c in ("runs_sha256", "collapsed_sha256")]])

    def run(batches):
        for part, texts in _batches(batches):
            batch = Batch(texts, least, exponent, part.column(1).to_pylist(), edit)
            rows = []
            for k, found in enumerate(batch.runs):
                best = min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if found else (None,) * 3
                listed = "".join(f"{s},{n},{q}\n" for s, n, q in found)
                rows.append((len(found), *best, 1000 * best[1] // best[2] if found else None, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(b" ".join(batch.kept(k))).hexdigest()))
            columns = list(zip(*rows)) if rows else [()] * 7
            yield pa.RecordBatch.from_arrays([part.column(0), *[pa.array(c, pa.int64()) for c in columns[:5]], *[pa.array(c, pa.string()) for c in columns[5:]]], names=out.names)

    return source.mapInArrow(run, out).withColumnRenamed("id", id_col)
