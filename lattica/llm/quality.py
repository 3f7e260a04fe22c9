"""Text quality by a generalised additive model with pairwise interactions.

Features are counts over the whole text, taken from its bytes at once for a chunk of texts. Each feature is cut into bins at quantiles.
Boosting goes round the features in turn: each step fits a shallow tree to the current residuals over one feature's bins and adds it to
that feature's lookup table; then pairs of features, chosen by what a quartering of their plane gains on the residuals, are boosted alike over two-way tables.
A score is the sum of the table entries at the text's bins: additions of vectors.

The model is fitted on the driver from at most ``SAMPLE_ROWS`` labelled rows, those with the smallest hash of their id: a documented
bound. Scoring covers every row.

Defined results: null texts count as empty, and empty texts are scored like any other; labels other than 0 and 1 and null ids teach nothing; without
labelled rows every score is 0.5; repeated rows get equal scores, and of several texts of a labelled id the least one teaches; texts may be of any length; columns of the input
other than id and text are not read, whatever their names, and stay as they are in ``accepted``; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from lattica.llm.util import Rolling, chunks, flat, whole_row

#: At most so many labelled rows are gathered to fit a model (about 3 MB of features).
SAMPLE_ROWS = 20_000

FEATURES = (
    "log_bytes", "upper_per_letter", "digits", "sentence_marks", "exclamations", "symbols", "pipes", "quotes_brackets", "wide_bytes", "newlines", "controls",
    "word_bytes", "short_words", "long_words", "words_per_line", "distinct_words", "top_run", "repeated_lines", "marked_words",
)

#: Byte classes, by the order in which the counts below use them.
LOWER, UPPER, DIGIT, SPACE, NEWLINE, MARK, EXCLAIM, SYMBOL, PIPE, QUOTE, WIDE, CONTROL = range(12)
_CLASS = np.full(256, CONTROL, np.int64)
for _chars, _kind in ((b"abcdefghijklmnopqrstuvwxyz", LOWER), (b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", UPPER), (b"0123456789", DIGIT), (b" \t\r\x0b\x0c", SPACE), (b"\n", NEWLINE), (b".,;:", MARK), (b"!?", EXCLAIM), (b"#$%&*@^~+=<>_\\", SYMBOL), (b"|", PIPE), (b"\"'()[]{}/-`", QUOTE)):
    _CLASS[list(_chars)] = _kind
_CLASS[128:] = WIDE


def features(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """FEATURES of texts that lie end to end in ``data``; off: n + 1 offsets."""
    n = len(off) - 1
    size = np.diff(off)
    doc = np.repeat(np.arange(n), size)
    kind = _CLASS[data]
    count = np.bincount(doc * 12 + kind, minlength=12 * n).reshape(n, 12).astype(np.float64)
    blank = (kind == SPACE) | (kind == NEWLINE)
    first = np.zeros(len(data), bool)
    first[off[:-1][size > 0]] = True
    start = np.flatnonzero(~blank & (first | np.r_[True, blank[:-1]][: len(data)]))
    last = np.r_[first[1:], True][: len(data)]
    end = np.flatnonzero(~blank & (last | np.r_[blank[1:], True][: len(data)])) + 1
    owner, width = doc[start], end - start
    words = np.bincount(owner, minlength=n).astype(np.float64)
    hashes = Rolling(data)
    held = hashes(start, end)
    order = np.lexsort((held, owner))
    new = np.r_[True, (np.diff(owner[order]) != 0) | (np.diff(held[order].view(np.int64)) != 0)][: len(order)]
    distinct = np.bincount(owner[order][new], minlength=n)
    runs = np.diff(np.r_[np.flatnonzero(new), len(order)])
    top = np.zeros(n)
    np.maximum.at(top, owner[order][new], runs)
    marked = np.bincount(owner, _CLASS[data[end - 1]] >= EXCLAIM, minlength=n) if len(end) else np.zeros(n)
    cut = np.flatnonzero((kind == NEWLINE) | last)
    line_start = np.r_[0, cut[:-1] + 1][: len(cut)]
    line_start = np.maximum(line_start, off[:-1][doc[cut]]) if len(cut) else line_start
    line_end = cut + (kind[cut] != NEWLINE)
    line_hash, line_doc = hashes(line_start, line_end), doc[cut]
    filled = line_end - line_start > 1
    line_hash, line_doc = line_hash[filled], line_doc[filled]
    lines = np.bincount(line_doc, minlength=n).astype(np.float64)
    o = np.lexsort((line_hash, line_doc))
    fresh = np.r_[True, (np.diff(line_doc[o]) != 0) | (np.diff(line_hash[o].view(np.int64)) != 0)][: len(o)]
    once = np.bincount(line_doc[o][fresh], minlength=n)
    per = lambda x, y: x / np.maximum(y, 1)
    letters = count[:, LOWER] + count[:, UPPER]
    by = np.maximum(size, 1)
    return np.column_stack([
        np.log1p(size), per(count[:, UPPER], letters), count[:, DIGIT] / by, count[:, MARK] / by, count[:, EXCLAIM] / by, count[:, SYMBOL] / by, count[:, PIPE] / by, count[:, QUOTE] / by, count[:, WIDE] / by, count[:, NEWLINE] / by, count[:, CONTROL] / by,
        per(size - count[:, SPACE] - count[:, NEWLINE], words), per(np.bincount(owner, width <= 3, minlength=n), words), per(np.bincount(owner, width >= 14, minlength=n), words), per(words, lines), per(distinct, words), per(top, words), per(lines - once, lines), per(marked, words),
    ])


@dataclass
class GamModel:
    """edges: inner bin borders by feature; tables: a value per bin; pairs: (i, j, values by bin of i and bin of j)."""

    edges: list = field(default_factory=list)
    tables: list = field(default_factory=list)
    pairs: list = field(default_factory=list)
    intercept: float = 0.0

    def bins(self, x: np.ndarray) -> list[np.ndarray]:
        return [np.searchsorted(e, x[:, j], "right") for j, e in enumerate(self.edges)]

    def score(self, x: np.ndarray) -> np.ndarray:
        b, total = self.bins(x), np.full(len(x), self.intercept)
        for at, t in zip(b, self.tables, strict=True):
            total += t[at]
        for i, j, t in self.pairs:
            total += t[b[i], b[j]]
        return 1 / (1 + np.exp(-np.clip(total, -40, 40)))


def _splits(g: np.ndarray, h: np.ndarray, leaves: int, least: float) -> np.ndarray:
    """A tree of a few leaves over ordered bins, by greedy splits: the Newton step of each bin's leaf."""
    borders = [(0, len(g))]
    cg, ch = np.r_[0, np.cumsum(g)], np.r_[0, np.cumsum(h)]
    worth = lambda a, b: (cg[b] - cg[a]) ** 2 / (ch[b] - ch[a] + 1.0)
    while len(borders) < leaves:
        best = (1e-9, 0, 0)
        for k, (a, b) in enumerate(borders):
            if b - a > 1:
                m = np.arange(a + 1, b)
                gain = worth(a, m) + worth(m, b) - worth(a, b)
                gain[(ch[m] - ch[a] < least) | (ch[b] - ch[m] < least)] = -1
                i = int(gain.argmax())
                best = max(best, (gain[i], k, int(m[i])))
        if not best[2]:
            break
        a, b = borders.pop(best[1])
        borders += [(a, best[2]), (best[2], b)]
    out = np.zeros(len(g))
    for a, b in borders:
        out[a:b] = (cg[b] - cg[a]) / (ch[b] - ch[a] + 1.0)
    return out


def _quarters(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """The best cut of a two-way table into four rectangles: its gain, and the Newton step of each cell's rectangle."""
    cg, ch = (np.pad(x.cumsum(0).cumsum(1), ((1, 0), (1, 0))) for x in (g, h))
    i, j = np.ix_(np.arange(1, g.shape[0]), np.arange(1, g.shape[1]))
    if not i.size or not j.size:
        return 0.0, np.zeros_like(g)
    parts = [(c[i, j], c[-1:, :][0, j] - c[i, j], c[i, -1] - c[i, j], c[-1, -1] - c[-1:, :][0, j] - c[i, -1] + c[i, j]) for c in (cg, ch)]
    gain = sum(a * a / (b + 1.0) for a, b in zip(*parts, strict=True))
    k = np.unravel_index(int(gain.argmax()), gain.shape)
    step = [a[k] / (b[k] + 1.0) for a, b in zip(*parts, strict=True)]
    out = np.empty_like(g)
    a, b = k[0] + 1, k[1] + 1
    out[:a, :b], out[a:, :b], out[:a, b:], out[a:, b:] = step
    return float(gain[k]), out


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 150, pair_rounds: int = 60, n_pairs: int = 8, rate: float = 0.1, most_bins: int = 48, pair_bins: int = 12) -> GamModel:
    """Cyclic boosting: single features first, then the pairs with the most left to explain."""
    model = GamModel()
    if not len(y):
        model.edges, model.tables = [np.zeros(0)] * x.shape[1], [np.zeros(1)] * x.shape[1]
        return model
    share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    model.intercept = float(np.log(share / (1 - share)))
    model.edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, most_bins + 1)[1:-1], method="lower")) for j in range(x.shape[1])]
    b = model.bins(x)
    model.tables = [np.zeros(len(e) + 1) for e in model.edges]
    total = np.full(len(y), model.intercept)

    def residuals():
        p = 1 / (1 + np.exp(-total))
        return y - p, p * (1 - p)

    least = max(1.0, 0.002 * len(y) * share * (1 - share))
    for _ in range(rounds):
        for j, at in enumerate(b):
            g, h = residuals()
            size = len(model.tables[j])
            step = rate * _splits(np.bincount(at, g, size), np.bincount(at, h, size), 3, least)
            model.tables[j] += step
            total += step[at]
    coarse = [np.linspace(0, pair_bins, len(t), endpoint=False).astype(int) for t in model.tables]
    sums = lambda i, j, v: np.bincount(coarse[i][b[i]] * pair_bins + coarse[j][b[j]], v, pair_bins * pair_bins).reshape(pair_bins, pair_bins)
    g, h = residuals()
    gains = sorted(((_quarters(sums(i, j, g), sums(i, j, h))[0], i, j) for i in range(len(b)) for j in range(i)), reverse=True)[:n_pairs]
    grids = {(i, j): np.zeros((pair_bins, pair_bins)) for _, i, j in gains}
    for _ in range(pair_rounds):
        for i, j in grids:
            g, h = residuals()
            step = rate * _quarters(sums(i, j, g), sums(i, j, h))[1]
            grids[i, j] += step
            total += step[coarse[i][b[i]], coarse[j][b[j]]]
    model.pairs = [(i, j, t[np.ix_(coarse[i], coarse[j])]) for (i, j), t in grids.items()]
    return model


def held_out(id_column):
    """Whether the checksum of the id as text leaves remainder 1 of 3: such rows teach nothing."""
    return F.coalesce(F.crc32(id_column.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def _featured(batches, text: str = "text"):
    for part in chunks(batches, text):
        yield part, features(*flat(part.column(part.schema.get_field_index(text))))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> GamModel:
    """Fits a model from the labelled rows that aren't held out, SAMPLE_ROWS at most."""
    usable = labels.filter(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull() & ~held_out(F.col(id_col)))
    sample = usable.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).orderBy(F.xxhash64("id"), "id", "y").limit(SAMPLE_ROWS)
    known = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(sample), "id")
    known = known.groupBy("id", "y").agg(F.min("text").alias("text")).select("y", "text")  # one text for a label, however often its id is repeated

    def run(batches):
        for part, x in _featured(batches):
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([v.tobytes() for v in x], pa.binary())], names=["y", "x"])

    rows = known.mapInArrow(run, "y int, x binary").toArrow()
    x = np.frombuffer(b"".join(rows["x"].to_pylist()), np.float64).reshape(-1, len(FEATURES))
    y = np.asarray(rows["y"].to_pylist(), np.float64)
    order = np.lexsort((*x.T, y))  # the model doesn't depend on the order of rows
    return fit(x[order], y[order])


def scored(docs: DataFrame, model: GamModel, text_col: str = "text") -> DataFrame:
    """(doc, score): each row of docs as a struct, and its score."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    source = docs.select(whole_row(docs).alias("doc"), F.col(text_col).cast("string").alias("text"))
    out = StructType([source.schema["doc"], StructField("score", DoubleType())])

    def run(batches):
        for part, x in _featured(batches):
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(held.value.score(x))], names=["doc", "score"])

    return source.mapInArrow(run, out)


def quality_report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every document."""
    s = scored(docs.select("doc_id", "text"), train(docs, labels))
    return s.select("doc.doc_id", held_out(F.col("doc.doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def accepted(docs: DataFrame, labels: DataFrame, at_least: float = 0.5) -> DataFrame:
    """The documents, with their columns, that score ``at_least``."""
    return scored(docs, train(docs, labels)).filter(F.col("score") >= at_least).select("doc.*")
