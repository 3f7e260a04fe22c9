"""The first 32 bits of MD5 for every number with every key, as arrays: what ``md5(concat_ws(':', seed, number, key))`` gives in SQL, without a row for each."""

from __future__ import annotations

import hashlib
import math

import numpy as np

#: MD5's constants and rotations (RFC 1321).
_SINES = [int(abs(math.sin(i + 1)) * 2**32) for i in range(64)]
_TURNS = [t for four in ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)) for t in four * 4]
_START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)

#: Hashes made at once: the arrays of a step stay in a core's cache.
AT_ONCE = 32768
#: Bytes of text that fit a block beside the mark of its end and its length.
ONE_BLOCK = 55


def _words(texts: list[bytes], at: int) -> np.ndarray:
    """(16, texts): a block's words, holding the texts from byte ``at`` on."""
    block = np.zeros((len(texts), 64), np.uint8)
    block[:, at : at + len(texts[0])] = np.frombuffer(b"".join(texts), np.uint8).reshape(len(texts), -1)
    return np.ascontiguousarray(block.view("<u4").T)


def _one_block(heads: np.ndarray, tails: np.ndarray, length: int) -> np.ndarray:
    """(heads, tails): the first word of the digest of head then tail, ``length`` bytes in all."""
    shape = heads.shape[1], tails.shape[1]
    tails[length // 4] |= np.uint32(0x80 << 8 * (length % 4))
    tails[14] = 8 * length
    words: list = []
    for head, tail in zip(heads, tails, strict=True):  # a word of zeros needs no step, one of a side alone a row or a column
        both = [w for w in (head[:, None], tail[None, :]) if w.any()]
        words.append(both[0] | both[1] if len(both) == 2 else both[0] if both else None)
    a, b, c, d = (np.full(shape, v, np.uint32) for v in _START)
    f, g = np.empty(shape, np.uint32), np.empty(shape, np.uint32)
    for i in range(64):
        if i < 16:
            k = i
            np.bitwise_xor(c, d, out=f)
            f &= b
            f ^= d
        elif i < 32:
            k = (5 * i + 1) % 16
            np.bitwise_xor(b, c, out=f)
            f &= d
            f ^= c
        elif i < 48:
            k = (3 * i + 5) % 16
            np.bitwise_xor(b, c, out=f)
            f ^= d
        else:
            k = 7 * i % 16
            np.invert(d, out=f)
            f |= b
            f ^= c
        f += a
        sine = np.uint32(_SINES[i])
        if words[k] is None or words[k].shape == shape:
            f += sine
            if words[k] is not None:
                f += words[k]
        else:
            f += words[k] + sine  # a row or a column
        np.right_shift(f, np.uint32(32 - _TURNS[i]), out=g)
        f <<= np.uint32(_TURNS[i])
        f |= g
        f += b
        a, d, c, b, f = d, c, b, f, a
    return a + np.uint32(_START[0])


def first_words(heads: list[bytes], tails: list[bytes]) -> np.ndarray:
    """(heads, tails) as uint32: the digest's first four bytes, the first one lowest. Texts over a block's length are hashed one by one."""
    out = np.empty((len(heads), len(tails)), np.uint32)
    sizes = lambda texts: {n: np.array([k for k, t in enumerate(texts) if len(t) == n]) for n in sorted({len(t) for t in texts})}
    for n, hs in sizes(heads).items():
        for m, ts in sizes(tails).items():
            if n + m > ONE_BLOCK:
                for h in hs:
                    out[h, ts] = np.frombuffer(b"".join(hashlib.md5(heads[h] + tails[t]).digest()[:4] for t in ts), "<u4")
                continue
            for j in range(0, len(ts), AT_ONCE):
                some = ts[j : j + AT_ONCE]
                words, step = _words([tails[t] for t in some], n), max(1, AT_ONCE // len(some))
                for i in range(0, len(hs), step):
                    part = hs[i : i + step]
                    out[np.ix_(part, some)] = _one_block(_words([heads[h] for h in part], 0), words.copy(), n + m)
    return out
