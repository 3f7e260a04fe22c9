"""A training corpus from ``documents``: quality, near duplicates, repeated passages, mix, token ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and reread as the next stage's docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.llm import bpe, jaccard_join, mixing, quality, suffix_dedup
from lattica.llm.queries import MIX_WEIGHTS, mix_levels, table, vocabulary
from lattica.llm.util import stored


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the additive model rejects (score below 0.5) go. The model is fitted on the labelled rows among ``docs`` that aren't held out.

    Null and empty texts are scored like any other; very long texts are read whole; repeated rows get equal scores and stay or go together; without labelled rows every score is
    0.5 and all stay; an empty table stays empty; columns keep names and values, whatever the names."""
    return quality.accepted(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near copies (sets of five words, similarity 0.8 or more) the smallest id stays.

    Null, empty and blank texts have no words and all stay; a text with fewer than five words is one gram; very long texts are compared whole; repeated rows (equal id and text) stay
    or go together; of rows with one id and different texts in a component the one of the smallest MD5 stays; null ids come last; an empty table stays empty; columns keep names
    and values, whatever the names."""
    return jaccard_join.first_of_groups(docs, words=5, percent=80)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Strings of 100 bytes that start earlier in the corpus (by id) are cut out; n_chars, where the table has it, follows the text.

    No document goes, though its text may end empty; null texts stay null; texts of under 100 bytes stay; a character of which a byte is cut goes whole; very long texts are read
    whole; repeated rows are one document and end alike; rows of one id are ordered by a hash of their texts; null ids are ordered by a hash of the text; an empty table stays empty; columns keep
    names and other values, whatever the names."""
    out = suffix_dedup.without_repeats(docs, min_len=100)
    return out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Nine tenths of the tokens (four bytes each), dealt to domains, languages and sources by weight, no document twice.

    Null and empty texts have no tokens and go with whichever bucket they are in; a very long text counts whole, and is left out where it doesn't fit; repeated rows are taken together; null
    languages and sources are values of their own; an empty table stays empty; columns keep names and values, whatever the names."""
    return mixing.taken_once(docs, *mix_levels(), MIX_WEIGHTS, fraction=(9, 10), epochs=1)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Adds n_tokens and ids (little-endian unsigned 32-bit integers) to the columns of documents; columns of those two names are replaced.

    Null and empty texts have no ids; very long texts are encoded whole; repeated rows stay; an empty table stays empty; other columns keep names and values."""
    return bpe.with_ids(docs, *vocabulary())


STAGES = [
    ("quality_classifier", quality_classifier),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("source_mix", source_mix),
    ("token_ids", token_ids),
]

#: SQL can't express the fitted classifier, nor the stages on its result; tests/llm/test_pipeline.py holds every stage's rows against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
