"""The corpus pipeline: documents to token ids, in five stages, each of which is one operator's work.

A stage takes (spark, docs, sf_dir), is written as Parquet and reread as the next one's ``docs``; all but the last
return the columns of documents. Rows are told apart by all their columns, so a doc_id may be null or shared. What a
stage drops is its decision: texts whose language is rejected, near-duplicates but the one with the smallest doc_id of
each group, and documents that the mix does not take. The mix repeats rows of sources that are to weigh more, and of the
one copy of each source in which its share of the words ends only the first words are kept.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronotopia.llm import bpe, langid, mixing, pii, simhash
from chronotopia.llm.common import remove_path, shared_folder, table


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language of the labels; those that the calibrated models reject go."""
    return langid.accepted(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of SimHash near-duplicates."""
    return simhash.near_dedup(docs)


def pseudonyms(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced."""
    return pii.pseudonymize(docs, pii.key_of(spark))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixing.mix(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens and token_ids of each row."""
    return bpe.encode(docs, bpe.default_path(), ("doc_id", "lang", "source"))


STAGES = [("language_id", language_id), ("near_dedup", near_dedup), ("pii", pseudonyms), ("mixing", mix), ("bpe", tokens)]
#: SQL cannot express these stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what lies between them is written to the shared folder.

    A stage's table goes when the next one is written; the last, which the rows returned are made from, stays.
    """
    docs, folder, before = table(spark, sf_dir, "documents"), f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}", None
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs.write.parquet(path := f"{folder}/{k}-{name}")
            docs = spark.read.parquet(path)
            if before is not None:
                remove_path(spark, before)
            before = path
    return docs
