"""A training corpus from ``documents``: five stages, each over all that the one before it kept.

1. language: texts that are null or hold no letter, in which no language can be told, go; an
   absent ``lang`` becomes the predicted one;
2. exact copies: of equal texts the one with the smallest doc_id stays;
3. near copies: of each component of similar texts the smallest doc_id stays;
4. repeated passages: words that lie in a passage of 50 words which also starts elsewhere go,
   every occurrence; a document stays, with what is left of its text, even if that is nothing;
5. packing: token sequences, a row per piece.

All stages but the last return the columns of their input, in order, and decide row by row: rows
that share a doc_id are told apart by their text, a row without one is kept or dropped like any
other, and of rows that share both doc_id and text one stays (stages 2 and 3). Null text leaves in
stage 1 and counts as empty in the others. Other columns may have any name and hold nulls. An
empty table gives an empty result, as does a table without labels its texts with a letter.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from talentmesh.llm import exact, jaccard, langid, packing, suffixdedup
from talentmesh.llm.common import stable, table

VOCABULARY = "byte_bpe_50k.json"


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language; without labels, all with a letter."""
    return langid.with_language(docs)


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of texts that are equal up to white space."""
    return exact.without_copies(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of texts that share three quarters of their shingles."""
    return jaccard.one_of_each(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of 50 words that stand elsewhere too."""
    return suffixdedup.without_passages(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 1,024 tokens with their sequence and place."""
    return packing.pack(docs, public_tokenizers.path(VOCABULARY))


STAGES = [
    ("language", language),
    ("exact copies", exact_copies),
    ("near copies", near_copies),
    ("repeated passages", repeated_passages),
    ("packing", packed),
]

#: The stages fit models and sort suffixes, which SQL does not express; tests/llm checks them by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stable(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
    return docs
