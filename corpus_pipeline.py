"""Documents to training tokens in five stages; each reads what the one before it wrote."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docguard.llm import jaccard_join, language, pieces, substring_dedup
from docguard.llm.common import Handoff, table
from docguard.llm.mixing import mixed_texts
from docguard.llm.queries import MIX


#: Near copies: shingles of five words, at least 80 percent of both texts' in common.
NEAR = jaccard_join.Settings(words=5, percent=80)


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language of the corpus; those that the fused evidence does not place in one go."""
    return language.in_accepted_language(docs)


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents linked by five-word shingles (Jaccard of 0.8 or more) the one with the smallest id."""
    return jaccard_join.one_of_each(docs, NEAR)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the strings of 50 bytes that an earlier document holds; n_chars follows."""
    return substring_dedup.without_repeats(docs).withColumn("n_chars", F.length("text").cast("long"))


def to_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the budgets of the source tree take them; a document of a second epoch is a second row."""
    return mixed_texts(docs, MIX)


def to_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each whole text, what they decode to and whether that is the text again, with id, language and source."""
    return pieces.encode_texts(docs, ["doc_id", "lang", "source"], same=True)


STAGES = [
    ("language_id", known_language),
    ("jaccard_join", one_of_near_copies),
    ("substring_dedup", without_repeats),
    ("mixing", to_weights),
    ("pieces", to_tokens),
]

#: Fitted language models and the hashed order of epochs have no SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder, each result written and read again; the tokens are returned, their decoded texts stay written."""
    hand = Handoff(spark, "pipeline")
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        docs = hand.write(stage(spark, docs, sf_dir), name)
        substring_dedup.drop_tables(spark)
        if before:
            hand.drop(before)
        before = name
    return docs.drop("decoded", "same_text")
