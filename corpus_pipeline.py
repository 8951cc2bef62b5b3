"""A corpus pipeline of five operators, each on all that the one before it kept.

Quality rules drop the documents they reject; the n-gram Jaccard join leaves one document of each group of near
duplicates; substring dedup cuts passages that an earlier document has; mixing draws the sources to their target
weights, repeating or cutting documents; byte-level BPE encodes what the mix holds.

Each stage takes the columns of documents as they are (others may stand beside them, and stay until the last stage). A
null text is empty: rules reject it, as they do texts of fewer than 50 words. A null id or source is a value like any
other; where a group's rows are told apart, null ids come last. Rows that repeat an id and a text are near duplicates of
each other, and one is left. Ties go to the least id, then the least hash of the text. Texts are processed whole, whatever
their length. Without labels only the base rule rejects; an empty table gives an empty result.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from granary.llm import bpe, mixing, near, passages, quality
from granary.llm.lineage import stored, stored_alone


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that neither the base rule nor the decision list, learned from the labels table, rejects."""
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by a Jaccard similarity of 0.8 or more."""
    return near.without_near_duplicates(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The texts without passages of 50 words or more that another document keeps."""
    return passages.without_repeats(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: a row for each whole text, or part of one, that it takes."""
    return mixing.mixed_texts(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source and the token ids of each row, with digests of the ids and of what they decode to."""
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return bpe.encode_texts(docs, path, public_tokenizers.PATTERN, keep=("doc_id", "source"))


STAGES = [
    ("quality rules", keep_good),
    ("n-gram Jaccard join", drop_near_duplicates),
    ("substring dedup", cut_repeats),
    ("mixing sources to target weights", mix_sources),
    ("byte-level BPE encoding and decoding", encode),
]

#: Learned rules, sketches and seeded selection have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table; between stages the rows are written to the shared folder and read again.

    What a stage stores on its way is deleted once its rows are written.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = stored_alone(spark, lambda: stage(spark, docs, sf_dir))  # noqa: B023
    return STAGES[-1][1](spark, docs, sf_dir)
