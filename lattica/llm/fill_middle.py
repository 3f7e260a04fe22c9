"""Fill-in-middle: a text cut at two places between units (lines by default), its middle moved to the end.

One Arrow-batched pandas UDF: ``regex``'s finditer gives the units' ends, kept as unsigned integers in one array a text; the two cuts are two lookups in it and three
slices; the draws are groups of a SHA-256 of seed and id, so they depend neither on partitions nor on the other rows.

Defined results: null counts as the empty text; an empty text, one that holds a sentinel and one that the draw leaves out stay plain; a text without a unit has n = 0; texts of any length are cut
whole; a null id is hashed as no digits; repeated rows are transformed alike; columns of the input, whatever their names, stay in ``fill_middle`` and aren't read in ``report``.
"""

from __future__ import annotations

import hashlib
from array import array
from dataclasses import dataclass

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.llm.util import quoted

#: Unit ends are counts of code points below 2**32.
ENDS = "I"
PLAIN, PSM, SPM = "plain", "psm", "spm"


@dataclass(frozen=True)
class Transform:
    """rate and spm: hundredths of the texts transformed, and of those the ones whose suffix comes first. A unit is a match of ``unit``; text between matches belongs to the unit after it.
    The sentinels' first character may be found nowhere else in them: so none can arise where a slice meets a sentinel, and ``restored`` is exact."""

    seed: int = 7
    rate: int = 100
    spm: int = 50
    unit: str = r"[^\n]*\n|[^\n]+"
    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"

    def __post_init__(self):
        marks = (self.prefix, self.suffix, self.middle)
        if not all(marks) or len(set(marks)) < 3 or any(a[0] in b[1:] for a in marks for b in marks) or any(a != b and b.startswith(a) for a in marks for b in marks):
            raise ValueError("sentinels must differ, none may begin another, and none may hold a first character of one further on")

    def draws(self, doc_id: str) -> list[int]:
        digest = hashlib.sha256(f"{self.seed}:{doc_id}".encode()).hexdigest()
        return [int(digest[k : k + 8], 16) for k in (0, 8, 16, 24)]

    def ends(self, text: str) -> array:
        return array(ENDS, (m.end() for m in regex.compile(self.unit).finditer(text)))

    def __call__(self, doc_id: str, text: str) -> tuple[int, str, int | None, int | None, str]:
        """(n units, form, code points of the prefix, of the middle, output)."""
        ends = self.ends(text)
        n = len(ends)
        a, b, chosen, order = self.draws(doc_id)
        if not text or chosen % 100 >= self.rate or any(mark in text for mark in (self.prefix, self.suffix, self.middle)):
            return n, PLAIN, None, None, text
        first, second = sorted((a % (n + 1), b % (n + 1)))
        at, to = (ends[k - 1] if k else 0 for k in (first, second))
        prefix, middle, suffix = text[:at], text[at:to], text[to:]
        if order % 100 < self.spm:
            return n, SPM, at, to - at, "".join((self.suffix, suffix, self.prefix, prefix, self.middle, middle))
        return n, PSM, at, to - at, "".join((self.prefix, prefix, self.suffix, suffix, self.middle, middle))

    def restored(self, form: str, output: str) -> str:
        """The exact text, from output and form alone."""
        if form == PLAIN:
            return output
        lead, inner = (self.suffix, self.prefix) if form == SPM else (self.prefix, self.suffix)
        turn = output.index(inner, len(lead))
        last = output.index(self.middle, turn + len(inner))
        one, two, middle = output[len(lead) : turn], output[turn + len(inner) : last], output[last + len(self.middle) :]
        return two + middle + one if form == SPM else one + middle + two


def _columns(df: DataFrame, id_col: str, text_col: str):
    """Decimal id and text as a pandas UDF takes them."""
    return F.coalesce(F.col(quoted(id_col)).cast("string"), F.lit("")), F.coalesce(F.col(quoted(text_col)).cast("string"), F.lit(""))


def fill_middle(df: DataFrame, transform: Transform = Transform(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The input's columns with the text in its new order, then form, n_units, prefix_chars and middle_chars, which replace columns of those names."""
    out = "text string, form string, n_units long, prefix_chars long, middle_chars long"

    @F.pandas_udf(out)
    def run(ids: pd.Series, texts: pd.Series) -> pd.DataFrame:
        rows = [transform(i, t) for i, t in zip(ids, texts)]
        whole = lambda k: pd.array([r[k] for r in rows], "Int64")
        return pd.DataFrame({"text": [r[4] for r in rows], "form": [r[1] for r in rows], "n_units": whole(0), "prefix_chars": whole(2), "middle_chars": whole(3)})

    made = ("form", "n_units", "prefix_chars", "middle_chars")
    row = F.struct(*[F.col(quoted(c)).alias(f"c{k}") for k, c in enumerate(df.columns)])
    held = df.select(row.alias("row"), run(*_columns(df, id_col, text_col)).alias("fim"))
    kept = [F.when(F.col(f"row.c{k}").isNotNull(), F.col("fim.text")).alias(c) if c == text_col else F.col(f"row.c{k}").alias(c) for k, c in enumerate(df.columns) if c not in made]
    return held.select(*kept, *[F.col(f"fim.{c}").alias(c) for c in made])


def report(df: DataFrame, transform: Transform = Transform(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256): the texts are transformed, and rebuilt from output and form, a text at a time; only digests leave."""
    out = "n long, form string, prefix_chars long, middle_chars long, output_sha256 string, restored_sha256 string"

    @F.pandas_udf(out)
    def run(ids: pd.Series, texts: pd.Series) -> pd.DataFrame:
        held = []
        for i, t in zip(ids, texts):
            n, form, prefix, middle, output = transform(i, t)
            digests = [hashlib.sha256(x.encode()).hexdigest() for x in (output, transform.restored(form, output))]
            held.append((n, form, prefix, middle, *digests))
        frame = pd.DataFrame(held, columns=["n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"])
        return frame.astype({"n": "Int64", "prefix_chars": "Int64", "middle_chars": "Int64"})

    held = df.select(F.col(quoted(id_col)).alias("id"), run(*_columns(df, id_col, text_col)).alias("fim"))
    return held.select(F.col("id").alias(id_col), *[F.col(f"fim.{c}").alias(c) for c in ("n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256")])
