"""Exact fingerprints of canonical texts, in DataFrame expressions only.

Canonical: Unicode composition (NFC; NFKC on request), full case folding, composition again, each run of white space one space, none at the ends. Fingerprint:
two chained 64-bit xxhash values, 32 hex digits. Texts whose wide hashes are equal are compared as bytes: grouping those few by
(hash, canonical text) compares whole values, equal copies collapse before the shuffle, and a hash with two canonical texts gets
the text's SHA-256 appended. So equal fingerprints of documents mean equal canonical texts. An edited text is compared as bytes with its own document, where their hashes are equal.

Defined results: null counts as the empty text, which has a fingerprint like any other; repeated rows get equal fingerprints; texts may be of any length;
columns of the input other than the two named, whatever their names, are not read; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lattica.llm.util import Tables

#: Neighbours are searched in ranges of ids of about so many rows: quantiles cut all ids into MOST_CELLS cells at most, each cell is cut at its own quantiles into as many ranges as it needs.
ROWS_PER_RANGE, MOST_CELLS = 20_000, 4096
#: Ranges whose first ids are broadcast at most; more are joined.
BROADCAST_RANGES = 100_000


def canonical(text, compatible: bool = False):
    """The canonical form of a text column. Plain ASCII needs no composition and no table of folds and skips the calls."""
    text = F.coalesce(text, F.lit(""))
    composed = lambda x: F.call_function("reflect", F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), x, F.lit(compatible))
    folded = lambda x: F.call_function("reflect", F.lit("com.ibm.icu.lang.UCharacter"), F.lit("foldCase"), x, F.lit(True))
    plain = F.octet_length(text) == F.char_length(text)
    return F.trim(F.regexp_replace(F.when(plain, F.lower(text)).otherwise(composed(folded(composed(text)))), r"[\s\u0085   -     　]+", " "))


def wide_hash(canon):
    """128 bits as 32 lowercase hex digits: the second half hashes the first along with the text."""
    first = F.xxhash64(canon)
    second = F.xxhash64(F.lit("wide"), first, canon, F.octet_length(canon))
    return F.lower(F.concat(F.lpad(F.hex(first), 16, "0"), F.lpad(F.hex(second), 16, "0")))


def collisions(hashed: DataFrame) -> DataFrame:
    """The hashes that stand for more than one canonical text. hashed: (hash, canon) of texts whose hash isn't theirs alone."""
    return hashed.groupBy("hash", "canon").agg(F.count("*").alias("n")).groupBy("hash").agg(F.count("*").alias("n")).filter("n > 1").select("hash")


def settled(df: DataFrame, collided: DataFrame, **texts: Column) -> DataFrame:
    """Appends the SHA-256 of the canonical text to hashes that collide. texts: by column of hashes, the column of their SHA-256."""
    for column, sha in texts.items():
        found = collided.select(F.col("hash").alias("two"))
        df = df.join(found, F.col(column) == F.col("two"), "left").withColumn(column, F.when(F.col("two").isNotNull(), F.concat_ws(":", column, sha)).otherwise(F.col(column))).drop("two")
    return df


def _collided(texts: DataFrame, hashes: DataFrame) -> DataFrame:
    """Of texts (id, t), whose hashes are (id, hash): the hashes that collide. Only texts in buckets of two or more are read again and compared."""
    shared = hashes.groupBy("hash").agg(F.count("*").alias("n")).filter("n > 1").select("hash")
    ids = hashes.join(shared, "hash", "left_semi").select(F.col("id").alias("of")).distinct()
    canon = texts.join(ids, F.col("id").eqNullSafe(F.col("of")), "left_semi").select(canonical(F.col("t")).alias("canon"))
    return collisions(canon.select(wide_hash(F.col("canon")).alias("hash"), "canon"))


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fingerprint), and exact: each text's bucket has been compared byte by byte."""
    tables = Tables(df.sparkSession)
    texts = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("t"))
    out = tables.stored(texts.select("id", canonical(F.col("t")).alias("c")).select("id", wide_hash(F.col("c")).alias("hash"), F.sha2("c", 256).alias("sha")), "hashes")
    collided = tables.stored(_collided(texts, out.select("id", "hash")), "collided")
    if not collided.isEmpty():
        out = settled(out, collided, hash=F.col("sha"))
    return out.select(F.col("id").alias(id_col), F.col("hash").alias("fingerprint"))


def _quantiles(n: int) -> list[float]:
    return [i / n for i in range(1, n)]


def _placed(x: Column, bounds: Column, n: int) -> Column:
    """How many of at most n sorted bounds are no greater than x: two short searches of about the root of that number."""
    step = max(1, int(n**0.5))
    upto = lambda held: F.array_size(F.filter(held, lambda b: b <= x))
    coarse = upto(F.filter(bounds, lambda b, k: (k + 1) % step == 0)) if n > 1 else F.lit(0)
    return coarse * step + upto(F.slice(bounds, coarse * step + 1, F.lit(step)))


def ranged(df: DataFrame, id_col: str, tables: Tables) -> tuple[DataFrame, int]:
    """The rows with the range of their id, r, in order of ids, and the number of ranges in a cell. As many ranges as rows need; null ids are in the first.

    Quantiles of all ids bound the cells; at most MOST_CELLS numbers go to the driver. Where rows need more ranges than that, each cell is cut at quantiles of its own ids, so gaps in the
    ids make no range longer; the cells' bounds are a table, joined by cell."""
    n = df.count()
    k = int(min(MOST_CELLS, max(1, n // ROWS_PER_RANGE, min(48, n // 64))))
    bounds = sorted(set(df.agg(F.percentile_approx(id_col, _quantiles(k), 10_000)).first()[0] or [])) if k > 1 else []
    x = F.col(id_col)
    cell = F.coalesce(_placed(x, F.array(*[F.lit(b) for b in bounds]), len(bounds)), F.lit(0)).cast("long") if bounds else F.lit(0).cast("long")
    cuts = max(1, -(-n // (k * ROWS_PER_RANGE)))
    if cuts == 1:
        return df.withColumn("r", cell), 1
    inner = df.select(cell.alias("of"), id_col).groupBy("of").agg(F.array_sort(F.array_distinct(F.percentile_approx(id_col, _quantiles(cuts), 10 * cuts))).alias("cut_at"))
    inner = tables.stored(inner, "cuts")
    few = inner.count() * cuts <= BROADCAST_RANGES
    rows = df.withColumn("cell", cell).join(F.broadcast(inner) if few else inner, F.col("cell") == F.col("of"))
    within = F.coalesce(_placed(x, F.col("cut_at"), cuts), F.lit(0)).cast("long")
    return rows.withColumn("r", F.col("cell") * cuts + within).drop("cell", "of", "cut_at"), cuts


def _edited(texts: DataFrame, tables: Tables, wide: bool) -> DataFrame:
    """(id, t, h, edited, ce, he, next) for texts (id, t): own hash, the edited text, its canonical form and hash, and the next document's (t, h). With ``wide`` also the SHA-256 s and se of the canonical forms, and next's."""
    rows, cuts = ranged(texts, "id", tables)

    def of(df: DataFrame) -> DataFrame:
        """The canonical form is a column before it is hashed: a hash names its argument several times, and Spark doesn't share calls that it holds to be nondeterministic."""
        return df.withColumn("c", canonical(F.col("t"))).withColumn("h", wide_hash(F.col("c"))).withColumn("s", F.sha2("c", 256) if wide else F.lit("")).drop("c")

    least = F.min(F.struct(F.col("id").isNotNull().alias("k"), F.col("id").alias("i")))
    first = tables.stored(rows.groupBy("r").agg(least.alias("h")).select(F.col("r").alias("of"), F.col("h.i").alias("i")), "ranges")
    few = first.count() <= BROADCAST_RANGES
    heads = rows.join(F.broadcast(first) if few else first, (F.col("r") == F.col("of")) & F.col("id").eqNullSafe(F.col("i"))).groupBy("r").agg(F.min("t").alias("t"))
    heads = tables.stored(of(heads).withColumn("cell", F.floor(F.col("r") / cuts)), "heads")
    head = F.struct("t", "h", "s")
    of_cells = heads.groupBy("cell").agg(F.min_by(head, "r").alias("x"))  # MOST_CELLS rows at most
    of_cells = of_cells.select(F.col("cell").alias("c"), F.coalesce(F.lead("x").over(W.orderBy("cell")), F.first("x").over(W.orderBy("cell"))).alias("beyond"))
    heads = heads.withColumn("x", F.lead(head).over(W.partitionBy("cell").orderBy("r"))).join(of_cells, F.col("cell") == F.col("c")).select(F.col("r").alias("of"), F.coalesce("x", "beyond").alias("after"))
    within = W.partitionBy("r").orderBy(F.col("id").asc_nulls_first(), F.col("t"))
    rows = of(rows).withColumn("x", F.lead(head).over(within)).join(heads, F.col("r") == F.col("of")).withColumn("next", F.coalesce("x", "after"))
    k = F.floor(F.char_length("t") / 4).cast("int")
    edited = F.concat(F.col("t").substr(F.lit(1), F.char_length("t") - k), F.col("next.t").substr(F.lit(1), k))
    rows = rows.select("id", "t", "h", "s", "next", edited.alias("edited")).withColumn("ce", canonical(F.col("edited")))
    return rows.withColumn("he", wide_hash(F.col("ce"))).withColumn("se", F.sha2("ce", 256) if wide else F.lit(""))


def edit_report(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For each document: code points, the edited text's SHA-256 (the last quarter replaced by the start of the next document), both
    fingerprints, and whether they equal each other's and the next document's, as 1.0 or 0.0.

    The next document is found inside ranges of ids, each a window of bounded size; the last document of a range continues with the first of
    the next range that has rows, found within a cell of ranges and then among cells. Ties: documents of one id follow each other by the text's bytes."""
    tables = Tables(df.sparkSession)
    texts = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("t"))

    def told(rows: DataFrame, *more: str) -> DataFrame:
        alike = F.when((F.col("h") == F.col("he")) & (F.col("s") == F.col("se")), canonical(F.col("t")) == F.col("ce")).otherwise(F.lit(False))  # as bytes, where hashes are equal
        next_alike = (F.col("h") == F.col("next.h")) & (F.col("s") == F.col("next.s"))
        return rows.select("id", F.char_length("t").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), "h", "he", alike.alias("alike"), next_alike.alias("next_alike"), *more)

    out = tables.stored(told(_edited(texts, tables, wide=False)), "edits")
    collided = tables.stored(_collided(texts, out.select("id", F.col("h").alias("hash"))), "collided")
    if not collided.isEmpty():  # two unlike texts of one hash: expected never. All is made anew, with the SHA-256 of canonical texts
        out = settled(told(_edited(texts, tables, wide=True), "s", "se"), collided, h=F.col("s"), he=F.col("se"))
    return out.select(
        F.col("id").alias(id_col), "n_chars", "edited_sha256", F.col("h").alias("fingerprint"), F.col("he").alias("edited_fingerprint"),
        F.col("alike").cast("double").alias("near_edited"), F.col("next_alike").cast("double").alias("near_next"),
    )
