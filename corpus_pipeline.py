"""The corpus pipeline: from raw documents to packed sequences, in stages that each read what their predecessor wrote."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from graphloom.llm.common import table
from graphloom.llm.decontaminate import drop_contaminated
from graphloom.llm.exact_dedup import drop_exact_copies
from graphloom.llm.packing import pack
from graphloom.llm.quality import drop_low_quality
from graphloom.llm.queries import tokenizer_path
from graphloom.llm.simhash import drop_near_duplicates
from graphloom.sources.work import remove, scratch, work_dir, written


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts; it learns from those of ``docs`` that are labelled and not held out."""
    return drop_low_quality(docs, table(spark, sf_dir, "labels"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, of the smallest id, of each group of equal texts."""
    return drop_exact_copies(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, of the smallest id, of each component of near duplicates."""
    return drop_near_duplicates(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't contaminated by the benchmark."""
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the remaining documents in training sequences; workers remember few words, as the stages before have filled the executors' heaps."""
    return pack(docs, tokenizer_path("word_bpe_49k.json"), remember=300_000)


STAGES = [("quality classifier", quality), ("exact dedup", exact_dedup), ("SimHash near-dedup", near_dedup), ("benchmark decontamination", decontamination), ("packing", packing)]

#: Fingerprints, learning and packing are beyond SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of all stages. A stage's intermediates go once its documents are written, and these once the next stage's are; those of the last but one stay for the result to read."""
    docs, before = table(spark, sf_dir, "documents"), None
    for _, stage in STAGES[:-1]:
        place = f"{work_dir(spark)}/stage-{uuid.uuid4().hex}"
        with scratch(spark):
            docs = written(stage(spark, docs, sf_dir), "stage", place)
        if before:
            remove(spark, before)
        before = place
    return STAGES[-1][1](spark, docs, sf_dir)
