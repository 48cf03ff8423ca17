"""The corpus pipeline: documents in, packed training sequences out.

Every stage takes (spark, docs, folder of the tables) and returns a DataFrame; all but the last return the columns of
documents.  Stages keep what they don't reject as it is."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from loomcast.llm import toxicity
from loomcast.llm.common import settle, table
from loomcast.llm.exact_dedup import drop_copies
from loomcast.llm.near_dedup import keep_one_each
from loomcast.llm.packing import pack
from loomcast.llm.queries import held_out


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.7 or more go; the model learns from the labelled documents that aren't held out."""
    return toxicity.accepted(docs, toxicity.fit(docs, table(spark, sf_dir, "labels"), ~held_out("_lid")))


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest id stays."""
    return drop_copies(docs, keep="largest")


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group that links of five-word shingles (similarity 0.75 or more) join, the smallest id stays."""
    return keep_one_each(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the remaining documents in sequences of at most 2048 tokens."""
    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("toxicity", without_toxic), ("exact_dedup", without_copies), ("near_dedup", without_near_copies), ("packing", packed)]

#: tokenising and compression distances can't be said in SQL; tests compare the stages with brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
