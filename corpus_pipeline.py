"""From raw documents to token ids: five stages, each over all that the one before kept.

An empty table passes through all stages as an empty table with the columns
that each stage returns. Null and empty texts have no letters, so they go in
the first stage; a text that a later stage empties is encoded as no tokens.
Rows that share an id are one document to the stages that compare documents,
and stay rows of their own in the others; rows without an id are compared with
none and stay, unless their text is rejected. Other columns come through
unharmed up to the last stage, which returns ids, tokens and hashes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from vitalcurve.llm import bpe, decontaminate, language, simhash, substrings
from vitalcurve.llm.common import written
from vitalcurve.llm.queries import BYTE_RANKS, PATTERN, table


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without letters, or without a language that 40 % of their words are likely in, go."""
    return language.keep_identified(docs, language.train(docs.where(~language.held_out())))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents whose fingerprints of three-word shingles are linked by 2 differing bits or fewer, that with the smallest id stays."""
    return simhash.simhash_dedup(docs, words=3, radius=2)


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sentences in spans that an earlier document has are cut out; every document stays."""
    return substrings.drop_repeats(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold benchmark passages go."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids, and hashes of them and of the text that they decode to."""
    return bpe.round_trip(docs, BYTE_RANKS, PATTERN)


STAGES = [
    ("language", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("repeated_passages", drop_repeated_passages),
    ("contamination", drop_contaminated),
    ("byte_bpe", encode),
]

#: Fingerprints, conditional random fields and byte-pair merges are beyond SQL; tests hold run() against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each one's result written and read again for the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
