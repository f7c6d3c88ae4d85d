"""A corpus pipeline of five stages. Each takes the documents that the stage before kept, reread from Parquet."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from mixolve.llm import decontamination, packing, quality, secrets, simhash
from mixolve.llm.common import drop_scratch, owning, release, scratch, signed, table
from mixolve.llm.queries import tokenizer_file


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier scores 0.3 or more."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the least ID, of each group of near copies: 5-word shingles of Jaccard similarity 0.8 or more, or 3-word SimHashes at most 3 of 64 bits apart."""
    return simhash.one_of_each(docs)


def clean_of_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of ten words of a benchmark item."""
    return decontamination.drop_hit(docs, table(spark, sf_dir, "benchmark"))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets and linked credentials masked, n_chars counted anew."""
    return secrets.mask_secrets(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of the documents in sequences of 4096."""
    return packing.pack_documents(spark, docs, tokenizer_file("word_bpe_49k.json"), fill=True)


def staged(stage: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """A stage that notes in its result what scratch tables this reads, and deletes those noted in its documents: their written copy is here."""

    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        release(docs)
        with owning() as mine:
            out = stage(spark, docs, sf_dir)
        return signed(out, mine)

    return run_stage


STAGES = [("quality", staged(good)), ("near_duplicates", staged(distinct)), ("decontamination", staged(clean_of_benchmarks)), ("secrets", staged(without_secrets)), ("packing", staged(packed))]

#: No stage but the third can be said in SQL; tests hold the whole against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn; a stage's documents are deleted when those of the next are written."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES[:-1]):
        docs, before = scratch(stage(spark, docs, sf_dir), f"stage-{name}"), docs
        if k:
            drop_scratch(before)
    return STAGES[-1][1](spark, docs, sf_dir)
