"""Corpus pipeline: from raw documents to token ids.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept,
and, but for the last, returns the columns of ``documents``. ``run`` writes each
stage's result to shared storage and reads it back, so a lost executor costs at
most a part of one stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from citeloom.llm import bpe, exact_dedup, mixing, near_dedup, quality
from citeloom.llm.common import save, table

#: Relative weights of the sources, in order of name, repeating.
WEIGHTS = (5, 2, 1)
TOKENIZER = "byte_bpe_50k.json"


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression classifier rejects go. It learns from ``labels`` and the texts of these documents."""
    return quality.quality_filter(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the smallest id stays."""
    return exact_dedup.exact_dedup(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: shingles of five words, similarity 0.8 or more."""
    return near_dedup.near_dedup(docs, words=5, percent=80)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it: left out, or up to three times."""
    return mixing.mixed_rows(docs, WEIGHTS)


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every copy: doc_id, ids, n_tokens, round_trip (the ids decode to the text)."""
    return bpe.bpe_encode(docs, public_tokenizers.path(TOKENIZER))


STAGES = [("quality", quality_stage), ("exact_dedup", exact_stage), ("near_dedup", near_stage), ("mixing", mixing_stage), ("bpe", bpe_stage)]

#: SQL can express neither compression nor MinHash, so tests compare run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = save(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
