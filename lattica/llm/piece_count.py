"""Word-piece lengths by a linear longest-match automaton.

The vocabulary is a trie. Where a word leaves it at node v, greedy longest match would have cut off some pieces of v's string; their number is
stored with v, along with the node of what is left (the failure link). So a word is read once, byte by byte, and pieces are counted without
being built. Vocabularies may mark pieces that continue a word (``##ing``): these form a trie of their own, where reading goes on after the first cut.

Defined results: null and empty texts have no words; a word that no sequence of pieces covers counts as one unknown piece; texts are counted
whole; repeated rows stay; columns of the input other than the two named, whatever their names, are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.llm.bpe import LONG_TEXT, read_ranks

KEPT_WORDS = 400_000


class PieceAutomaton:
    """Nodes are integers, 0 the root of pieces that begin a word, ``rest`` that of pieces that continue it: 0 as well without a mark.
    step: (node << 8 | byte) to node; link and popped by node, link -1 where nothing can be cut off."""

    def __init__(self, pieces, mark: bytes = b""):
        self.step: dict[int, int] = {}
        self.rest = 1 if mark else 0
        depth_first: list[tuple[int, int]] = [(-1, 0)] * (1 + self.rest)  # (parent, byte) by node
        is_piece = [False] * (1 + self.rest)
        for piece in sorted(p for p in pieces if p and p != mark):
            at = 0
            if mark and piece.startswith(mark):
                at, piece = self.rest, piece[len(mark) :]
            for c in piece:
                to = self.step.get(at << 8 | c)
                if to is None:
                    to = self.step[at << 8 | c] = len(depth_first)
                    depth_first.append((at, c))
                    is_piece.append(False)
                at = to
            is_piece[at] = True
        n = len(depth_first)
        depth = [0] * n
        first = 1 + self.rest
        for v in range(first, n):  # a parent is made before its children
            depth[v] = depth[depth_first[v][0]] + 1
        self.link, self.popped = [-1] * n, [0] * n
        for v in sorted(range(first, n), key=depth.__getitem__):
            u, c = depth_first[v]
            if is_piece[v]:
                self.link[v], self.popped[v] = self.rest, 1
                continue
            z, count = self.link[u], self.popped[u]
            while z >= 0 and (z << 8 | c) not in self.step:
                count += self.popped[z]
                z = self.link[z]
            if z >= 0:
                self.link[v], self.popped[v] = self.step[z << 8 | c], count

    def count(self, word: bytes) -> int:
        """Pieces of the word, or -1 if pieces can't cover it."""
        step, link, popped = self.step, self.link, self.popped
        at = n = 0
        for c in word:
            to = step.get(at << 8 | c)
            while to is None:
                n += popped[at]
                at = link[at]
                if at < 0:
                    return -1
                to = step.get(at << 8 | c)
            at = to
        last = self.rest  # a root: nothing is left to cut off
        while at > last:
            n += popped[at]
            at = link[at]
        return n if at >= 0 else -1


_AUTOMATA: dict = {}


def count_pieces(df: DataFrame, vocabulary: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", pieces=None, mark: bytes = b"") -> DataFrame:
    """(id, n_words, n_pieces, n_unknown). vocabulary: a rank file, of which the pieces are used, or a name for ``pieces``; pattern: cuts texts into words; mark: begins pieces that continue a word."""
    automaton = df.sparkSession.sparkContext.broadcast(PieceAutomaton(read_ranks(vocabulary) if pieces is None else pieces, mark))
    source = df.select(F.col(id_col), F.col(text_col).cast("string").alias("_text"))
    schema = f"`{id_col}` {source.schema[0].dataType.simpleString()}, n_words long, n_pieces long, n_unknown long"

    def run(batches):
        import regex

        if (vocabulary, pattern, mark) not in _AUTOMATA:  # one in a process: later tasks of a worker find its words warm
            _AUTOMATA.clear()
            _AUTOMATA[vocabulary, pattern, mark] = automaton.value, regex.compile(pattern), {}
        own, words, kept = _AUTOMATA[vocabulary, pattern, mark]

        def length(word: str) -> int:
            got = kept.get(word)
            if got is None:
                got = own.count(word.encode())
                if len(word) <= 64:
                    if len(kept) >= KEPT_WORDS:
                        kept.clear()
                    kept[word] = got
            return got

        def counted(text: str) -> tuple[int, int, int]:
            found = words.findall(text) if len(text) <= LONG_TEXT else (m.group() for m in words.finditer(text))
            n = total = unknown = 0
            if len(text) <= LONG_TEXT:
                each = list(map(length, found))
                n, unknown = len(each), each.count(-1)
                return n, sum(each) + 2 * unknown, unknown
            for x in map(length, found):
                n, total, unknown = n + 1, total + abs(x), unknown + (x < 0)
            return n, total, unknown

        for b in batches:
            rows = [counted(t.as_py() or "") for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array([r[k] for r in rows], pa.int64()) for k in range(3))], names=[id_col, "n_words", "n_pieces", "n_unknown"])

    return source.mapInArrow(run, schema)
