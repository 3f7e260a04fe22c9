"""Suffix arrays by induced sorting, and permuted common prefixes, over arrays.

Suffixes are classified as smaller or larger than their right neighbour; leftmost smaller ones are sorted by their substrings, these get names, and the string
of names is sorted recursively; from the order of the leftmost smaller suffixes the whole array is induced in two linear passes.
With a small alphabet a pass goes bucket by bucket and moves a whole front of suffixes at once; strings of names, of which there are
at most half as many with each level, are handled one suffix at a time.
"""

from __future__ import annotations

import numpy as np

#: Alphabets up to this size are induced front by front.
SMALL_ALPHABET = 1024


def suffix_array(text: np.ndarray) -> np.ndarray:
    """text: whole numbers from 0, the last one 0 and the only 0."""
    text = np.asarray(text)
    if len(text) < 2:
        return np.arange(len(text))
    alphabet = int(text.max()) + 1
    return _fronts(text.astype(np.int64), alphabet) if alphabet <= SMALL_ALPHABET else np.array(_one_by_one(text.tolist(), alphabet), np.int64)


def _types(t: np.ndarray) -> np.ndarray:
    """True where the suffix is smaller than its right neighbour; runs of equal symbols take the type of what follows them."""
    n = len(t)
    at = np.where(t[:-1] != t[1:], np.arange(n - 1), n)
    at = np.minimum.accumulate(at[::-1])[::-1]
    return np.append((t[:-1] < t[1:])[np.minimum(at, n - 2)], True)


def _grouped(symbols: np.ndarray, alphabet: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A stable order by symbol, each one's rank among its equals in that order, and the counts."""
    order = np.argsort(symbols.astype(np.uint16) if alphabet <= 65536 else symbols, kind="stable")
    counts = np.bincount(symbols, minlength=alphabet)
    held = symbols[order]
    return order, np.arange(len(symbols)) - (np.cumsum(counts) - counts)[held], counts


def _induce(t, smaller, seeds, alphabet, start, end):
    """The order of all suffixes, given that of ``seeds`` (leftmost smaller suffixes, or a guess at it)."""
    n = len(t)
    out = np.full(n, -1, np.int64)
    order, rank, counts = _grouped(t[seeds], alphabet)
    placed = seeds[order]
    seed_start = end - counts
    out[seed_start[t[placed]] + rank] = placed
    head = start.copy()

    def forward(front):
        j = front - 1
        j = j[j >= 0]
        j = j[~smaller[j]]
        if len(j):
            o, r, k = _grouped(t[j], alphabet)
            j = j[o]
            out[head[t[j]] + r] = j
            np.add(head, k, out=head)

    present = np.flatnonzero(end > start)
    for c in present:
        at = start[c]
        while at < head[c]:
            to = head[c]
            forward(out[at:to])
            at = to
        if counts[c]:
            forward(out[seed_start[c] : end[c]])
    larger_end, tail = head.copy(), end.copy()

    def backward(front):
        j = front[::-1] - 1
        j = j[j >= 0]
        j = j[smaller[j]]
        if len(j):
            o, r, k = _grouped(t[j], alphabet)
            j = j[o]
            out[tail[t[j]] - 1 - r] = j
            np.subtract(tail, k, out=tail)

    for c in present[::-1]:
        to = end[c]
        while tail[c] < to:
            at = tail[c]
            backward(out[at:to])
            to = at
        backward(out[start[c] : larger_end[c]])
    out[0] = n - 1
    return out


def _names(t, leftmost, in_order):
    """Equal substrings, from one leftmost smaller suffix to the next, get equal names; returns the names in text order and how many there are."""
    n = len(t)
    length = np.zeros(n, np.int64)
    length[leftmost] = np.append(np.diff(leftmost) + 1, 1)
    a, b = in_order[:-1], in_order[1:]
    differ = length[a] != length[b]
    live, d = np.flatnonzero(~differ), 0
    while len(live):
        unequal = t[a[live] + d] != t[b[live] + d]
        differ[live[unequal]] = True
        d += 1
        live = live[~unequal & (length[a[live]] > d)] if len(live) else live
    name = np.zeros(n, np.int64)
    name[in_order] = np.append(0, np.cumsum(differ))
    return name[leftmost], int(differ.sum()) + 1


def _fronts(t: np.ndarray, alphabet: int) -> np.ndarray:
    smaller = _types(t)
    leftmost = np.flatnonzero(smaller[1:] & ~smaller[:-1]) + 1
    end = np.cumsum(np.bincount(t, minlength=alphabet))
    start = np.append(0, end[:-1])
    guess = _induce(t, smaller, leftmost, alphabet, start, end)
    is_leftmost = np.zeros(len(t), bool)
    is_leftmost[leftmost] = True
    in_order = guess[is_leftmost[guess]]
    names, n = _names(t, leftmost, in_order)
    if n < len(leftmost):  # else the substrings all differ, and their order is that of the suffixes
        in_order = leftmost[suffix_array(names)]
    return _induce(t, smaller, in_order, alphabet, start, end)


def _one_by_one(t: list[int], alphabet: int) -> list[int]:
    """The same for strings of names, whose buckets are too small for fronts."""
    n = len(t)
    if n == 1:
        return [0]
    smaller = _types(np.array(t)).tolist()
    counts = np.bincount(t, minlength=alphabet)
    ends = np.cumsum(counts)
    starts = (ends - counts).tolist()
    ends = ends.tolist()
    leftmost = [i for i in range(1, n) if smaller[i] and not smaller[i - 1]]

    def induced(seeds):
        out = [-1] * n
        tail = ends[:]
        for i in reversed(seeds):
            tail[t[i]] -= 1
            out[tail[t[i]]] = i
        head = starts[:]
        for i in out:  # grows to the right of the reader only
            if i > 0 and not smaller[i - 1]:
                c = t[i - 1]
                out[head[c]] = i - 1
                head[c] += 1
        tail = ends[:]
        for k in range(n - 1, -1, -1):
            i = out[k]
            if i > 0 and smaller[i - 1]:
                c = t[i - 1]
                tail[c] -= 1
                out[tail[c]] = i - 1
        out[0] = n - 1
        return out

    guess = induced(leftmost)
    marked = set(leftmost)
    in_order = [i for i in guess if i in marked]
    names, k = _names(np.array(t), np.array(leftmost), np.array(in_order))
    if k < len(leftmost):
        in_order = [leftmost[i] for i in suffix_array(names).tolist()]
    return induced(in_order)


def permuted_prefixes(text: np.ndarray, order: np.ndarray, starts: np.ndarray, deepest: int) -> np.ndarray:
    """By text position: how long a prefix the suffix shares with the one before it in ``order``; exact up to ``deepest`` within pieces of
    fewer symbols than half of it, whose first positions are ``starts``.

    Where the symbols to the left of both suffixes are equal, the value is the one to the left less 1; only the others are compared."""
    n = len(text)
    before = np.full(n, -1, np.int64)
    before[order[1:]] = order[:-1]
    left = np.append(text[0] + 1, text[:-1])  # symbol to the left
    compared = np.ones(n, bool)
    inner = before > 0
    compared[inner] = left[inner] != text[before[inner] - 1]
    compared[0] = True
    compared[starts] = True
    t = np.append(text, np.zeros(4, text.dtype)).astype(np.uint64)
    four = t[:-3] | t[1:-2] << np.uint64(16) | t[2:-1] << np.uint64(32) | t[3:] << np.uint64(48)
    at = np.flatnonzero(compared)
    value = np.zeros(len(at), np.int64)
    live = np.flatnonzero(before[at] >= 0)
    while len(live):
        a, b = at[live] + value[live], before[at[live]] + value[live]
        ok = (a < n) & (b < n)
        live, a, b = live[ok], a[ok], b[ok]
        same = four[a] == four[b]
        stop = live[~same]
        x = four[a[~same]] ^ four[b[~same]]
        value[stop] += ((x & np.uint64(0xFFFF)) == 0).astype(np.int64) + ((x & np.uint64(0xFFFFFFFF)) == 0) + ((x & np.uint64(0xFFFFFFFFFFFF)) == 0)
        live = live[same]
        value[live] += 4
        live = live[value[live] < deepest]
    last = np.zeros(n, np.int64)
    last[at] = np.arange(len(at))
    last = np.maximum.accumulate(last)
    out = value[last] + at[last] - np.arange(n)
    out[order[0]] = 0
    return np.maximum(out, 0)
