"""Byte-level BPE by prefix dynamic programming.

For every prefix of a byte string there is exactly one token that can be the last of the prefix's encoding. The table of those last tokens
grows to the right: the last token of a longer prefix is the one vocabulary suffix that may follow the last token before it; an automaton
over the beginnings of tokens, made as texts need it, names those suffixes at each byte. So an append
continues the table, and after an edit the table is recomputed only until it meets the old one again. Reading the table backwards gives the ids.

Whether token b may follow a is decided by undoing merges from both sides of their border until one that joins across it ranks lower.

Defined results: null and empty texts have no ids and the digests of no bytes; texts of any length are encoded whole, in time linear in their
length; repeated rows stay; columns of the input other than the two named are not read.
"""

from __future__ import annotations

import base64
import hashlib
from array import array

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StructField, StructType

from lattica.llm.util import quoted

#: Distinct pieces whose ids a task keeps; then it starts anew, so memory is bounded.
KEPT_PIECES = 500_000
#: Pairs of tokens whose verdict a task keeps.
KEPT_PAIRS = 1_000_000
#: Characters of texts that are cut into pieces at once; a longer text is cut one piece at a time.
LONG_TEXT = 1 << 20


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class PrefixBPE:
    """Tables of one vocabulary; picklable, a few MB, its size that of the vocabulary."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of: dict[int, bytes] = {r: t for t, r in ranks.items()}
        self.halves: dict[int, tuple[int, int]] = {}
        self.joined: dict[tuple[int, int], int] = {}
        self.reachable: dict[bytes, int] = {}
        for rank in sorted(self.bytes_of):  # a token's halves have lower ranks, so they are known
            token = self.bytes_of[rank]
            if len(token) > 1:
                for k in range(1, len(token)):
                    a, b = self.reachable.get(token[:k]), self.reachable.get(token[k:])
                    if a is not None and b is not None and self._follows(a, b):
                        self.halves[rank] = a, b
                        self.joined[a, b] = rank
                        break
                else:
                    continue  # no merge makes it: it is only found as a whole piece
            self.reachable[token] = rank
        self.most = max(map(len, self.reachable), default=0)

        self._restart()

    def _restart(self) -> None:
        """Empty stores, filled as texts need them."""
        self.verdicts: dict[int, dict[int, bool]] = {}  # by token, those before it
        self.kept_verdicts = 0
        self.heads: set[bytes] = set()  # all beginnings of tokens
        self.places: dict[bytes, int] = {b"": 0}  # those met, numbered: the places of an automaton that holds the longest beginning a text ends in
        self.names: list[bytes] = [b""]
        self.ending: list[tuple[tuple[int, int, dict[int, bool]], ...]] = [()]  # by place, (length, token, its verdicts) of the tokens it ends in, longest first
        self.moves: list[dict[int, int]] = [{}]
        self.kept_moves = 0

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k not in ("verdicts", "kept_verdicts", "heads", "places", "names", "ending", "moves", "kept_moves")}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self._restart()

    def _move(self, place: int, byte: int) -> int:
        """The place after one more byte."""
        if not self.heads:
            self.heads = {t[:k] for t in self.reachable for k in range(len(t) + 1)}
        name = self.names[place] + bytes((byte,))
        while name not in self.heads:
            name = name[1:]
        to = self.places.get(name)
        if to is None:
            to = self.places[name] = len(self.names)
            self.names.append(name)
            self.moves.append({})
            tokens = [(len(name) - k, self.reachable[name[k:]]) for k in range(len(name)) if name[k:] in self.reachable]
            self.ending.append(tuple((size, token, self.verdicts.setdefault(token, {})) for size, token in tokens))
        if self.kept_moves >= KEPT_PAIRS:
            self.moves, self.kept_moves = [{} for _ in self.moves], 0
        self.moves[place][byte] = to
        self.kept_moves += 1
        return to

    def _place(self, data: bytes) -> int:
        """Of a text's end, which no more bytes decide than the longest token has."""
        place = 0
        for byte in data[-self.most :]:
            to = self.moves[place].get(byte)
            place = self._move(place, byte) if to is None else to
        return place

    def _follows(self, a: int, b: int) -> bool:
        """Whether a then b stays as it is: no merge across their border, at any time before both were made, would have come first."""
        bound = 1 << 62
        joined, halves = self.joined, self.halves
        while True:
            across = joined.get((a, b))
            if across is not None and across < bound:
                return False
            if a > b:  # a was made later: before that its right half stood at the border
                bound = a
                if a not in halves:
                    return True
                a = halves[a][1]
            else:
                bound = b + 1  # at equal rank the left one is made first
                if b not in halves:
                    if a not in halves:
                        return True
                    bound = a
                    a = halves[a][1]
                else:
                    b = halves[b][0]

    def follows(self, a: int, b: int) -> bool:
        before = self.verdicts.setdefault(b, {})
        got = before.get(a)
        if got is None:
            if self.kept_verdicts >= KEPT_PAIRS:
                for kept in self.verdicts.values():  # in place: ``ending`` holds them
                    kept.clear()
                self.kept_verdicts = 0
            got = before[a] = self._follows(a, b)
            self.kept_verdicts += 1
        return got

    def extend(self, data: bytes, last: list[int], places: list[int] | None = None) -> list[int]:
        """Continues the table ``last`` (last[i]: the last token of the first i bytes; last[0] unused) over the rest of ``data``, and the automaton's ``places``, of which the table's last is needed. Returns them."""
        ending, moves = self.ending, self.moves
        done = len(last) - 1
        places = places or [self._place(data[:done])]
        place = places[-1]
        for end in range(done + 1, len(data) + 1):
            byte = data[end - 1]
            to = moves[place].get(byte)
            if to is None:
                to = self._move(place, byte)
                moves = self.moves
            place = to
            for size, token, verdicts in ending[place]:
                if size == end or size == 1:  # one of the candidates follows, and no other is left
                    last.append(token)
                    break
                ok = verdicts.get(last[end - size])
                if ok is None:
                    ok = self.follows(last[end - size], token)
                if ok:
                    last.append(token)
                    break
            else:
                raise ValueError("the vocabulary lacks single bytes")
            places.append(place)
        return places

    def table(self, data: bytes) -> list[int]:
        last = [-1]
        self.extend(data, last)
        return last

    def append(self, data: bytes, last: list[int], more: bytes) -> tuple[bytes, list[int]]:
        data += more
        self.extend(data, last)
        return data, last

    def replace(self, data: bytes, last: list[int], start: int, end: int, new: bytes) -> tuple[bytes, list[int], int]:
        """Replaces data[start:end]; returns the new bytes, their table, and how many entries were computed. Entries far right of the edit are
        those of the old table once as many in a row as the longest token has bytes are equal: each depends on no more than those."""
        out, table = data[:start] + new + data[end:], last[: start + 1]
        shift, most, same = len(out) - len(data), self.most, 0
        places = None
        while len(table) <= len(out):
            at = len(table)
            places = self.extend(out[: at], table, places)
            same = same + 1 if at > start + len(new) and table[at] == last[at - shift] else 0
            if same >= most:
                table.extend(last[at - shift + 1 :])
                return out, table, at - start
        return out, table, len(out) - start

    def ids(self, data: bytes, last: list[int] | None = None) -> list[int]:
        """The ids of one piece."""
        whole = self.ranks.get(data)
        if whole is not None:
            return [whole]
        last = last or self.table(data)
        out, at = [], len(data)
        while at:
            out.append(last[at])
            at -= len(self.bytes_of[last[at]])
        return out[::-1]

    def decode(self, ids) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


class TextEncoder:
    """Cuts whole texts into pieces by a pattern and packs the ids as little-endian unsigned 32-bit integers."""

    def __init__(self, bpe: PrefixBPE, pattern: str):
        import regex

        self.bpe, self.pattern, self.kept = bpe, regex.compile(pattern), {}

    def __call__(self, text: str) -> bytes:
        if len(text) <= LONG_TEXT:
            return self.many([text])[0]
        return b"".join(map(self._packed, (m.group() for m in self.pattern.finditer(text))))

    def many(self, texts: list[str]) -> list[bytes]:
        """The packed ids of each text; LONG_TEXT characters are in work at a time."""
        out: list[bytes] = []
        while len(out) < len(texts):
            size, some = 0, []
            for text in texts[len(out) :]:
                size += len(text)
                if size > LONG_TEXT:
                    break
                some.append(self.pattern.findall(text))
            if not some:
                out.append(self(texts[len(out)]))
                continue
            self._learn(some)
            for pieces in some:
                try:
                    out.append(b"".join(map(self.kept.__getitem__, pieces)))
                except KeyError:
                    out.append(b"".join(map(self._packed, pieces)))
        return out

    def _learn(self, texts: list[list[str]]) -> None:
        """Keeps the ids of pieces not met before: in order, so that a piece continues the table of the one before it where they begin alike."""
        met = set().union(*texts)
        new = met.difference(self.kept)
        if len(self.kept) + len(new) > KEPT_PIECES:
            self.kept.clear()
            new = met
        bpe, data, last, places = self.bpe, b"", [-1], [0]
        for piece in sorted(p for p in new if len(p) <= 64):
            raw = piece.encode()
            if raw not in bpe.ranks:
                alike = 0
                for x, y in zip(data, raw, strict=False):
                    if x != y:
                        break
                    alike += 1
                del last[alike + 1 :], places[alike + 1 :]
                bpe.extend(raw, last, places)
                data = raw
            self.kept[piece] = array("I", bpe.ids(raw, last)).tobytes()

    def _packed(self, piece: str) -> bytes:
        got = self.kept.get(piece)
        if got is None:
            got = array("I", self.bpe.ids(piece.encode())).tobytes()
            if len(piece) <= 64:
                if len(self.kept) >= KEPT_PIECES:
                    self.kept.clear()
                self.kept[piece] = got
        return got


_ENCODERS: dict = {}


def encoder(bpe: PrefixBPE, vocabulary: str, pattern: str) -> TextEncoder:
    """One for a vocabulary and pattern in a process: later tasks of a worker find its pieces warm."""
    if (vocabulary, pattern) not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[vocabulary, pattern] = TextEncoder(bpe, pattern)
    return _ENCODERS[vocabulary, pattern]


def with_ids(df: DataFrame, vocabulary: str, pattern: str, text_col: str = "text") -> DataFrame:
    """The input's columns, then n_tokens long and ids binary (little-endian unsigned 32-bit integers), which replace columns of those names."""
    bpe = df.sparkSession.sparkContext.broadcast(PrefixBPE(read_ranks(vocabulary)))
    df = df.select(*[F.col(quoted(c)) for c in df.columns if c not in ("n_tokens", "ids")])
    out = StructType([*df.schema.fields, StructField("n_tokens", LongType()), StructField("ids", BinaryType())])
    at = df.columns.index(text_col)

    def run(batches):
        encode = encoder(bpe.value, vocabulary, pattern)
        for b in batches:
            for k in range(0, b.num_rows, 256):
                part = b.slice(k, 256)
                ids = encode.many([t or "" for t in part.column(at).to_pylist()])
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())], names=out.names)

    return df.toDF(*[f"c{k}" for k in range(len(df.columns))]).mapInArrow(run, out)  # by place: names of the input may be any


def digest_documents(df: DataFrame, vocabulary: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256): each text encoded and its ids decoded again."""

    bpe = df.sparkSession.sparkContext.broadcast(PrefixBPE(read_ranks(vocabulary)))
    source = df.select(F.col(id_col), F.col(text_col).cast("string").alias("_text"))
    kind = source.schema[0].dataType.simpleString()

    def run(batches):
        encode = encoder(bpe.value, vocabulary, pattern)
        own = encode.bpe
        for b in batches:
            for k in range(0, b.num_rows, 256):
                part = b.slice(k, 256)
                n, ids, decoded = [], [], []
                for packed in encode.many([t or "" for t in part.column(1).to_pylist()]):
                    n.append(len(packed) // 4)
                    ids.append(hashlib.sha256(packed).hexdigest())
                    decoded.append(hashlib.sha256(own.decode(memoryview(packed).cast("I"))).hexdigest())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.array(ids), pa.array(decoded)], names=[id_col, "n_tokens", "ids_sha256", "decoded_sha256"])

    return source.mapInArrow(run, f"`{id_col}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
