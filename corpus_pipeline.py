"""Corpus pipeline over the documents table: its stages in order, and the run of all.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet
and reread as the next stage's documents. All but the last return the documents' columns.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from shelfspark.llm import langid, mixing, neardup, packing, quality
from shelfspark.llm.common import saved, table

# A document goes if less than this part of its pooled probability is on one language.
LEAST_LANGUAGE_SCORE = 0.4
# A source may repeat at most this often in the mix; no document is left out of it.
REPETITION = 2.0


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with letters in a language the network is sure enough of.

    Rows with null or empty texts go, also without any language to learn; null ids and repeated
    rows are judged by their text like all others; no rows give no rows; other columns stay.
    """
    return langid.keep_known(docs, langid.fit(docs), LEAST_LANGUAGE_SCORE)


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression classifier predicts as good.

    Without labels of both kinds nothing goes. Null texts count as empty; null ids and repeated
    rows are judged by their text like all others; no rows give no rows; other columns stay.
    """
    return quality.keep_good(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five words, similarity of 0.8 or more.

    The smallest doc_id stays, of several rows of one id the smallest text. Documents without words
    are copies of nothing and stay, as rows without an id do; no rows give no rows; other columns stay.
    """
    return neardup.keep_first(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The tempered mix in the order of its blocks; a document appears once per epoch of its source.

    A null source is a source of its own; null and empty texts have one token; repeated rows
    count each; no rows give no rows; other columns stay.
    """
    mixed = mixing.mix(docs, mixing.Target(repetition=REPETITION), whole=True)
    # A block lies whole in one partition, its documents in the order of their positions.
    return mixed.sortWithinPartitions("block", "position").select("row.*")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix as token sequences of at most 2048 ids, one row per piece.

    Null texts count as empty and give their end alone; repeated rows are packed each; no rows
    give no rows; other columns are not looked at.
    """
    return packing.pack(
        docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"))


STAGES = [
    ("language", language),
    ("quality", good_quality),
    ("near_dedup", near_dedup),
    ("mixing", mix_sources),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages applied to the documents table."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)


# Trained models and a tokenizer take part: tested against brute force instead.
ORACLE_SQL = None
