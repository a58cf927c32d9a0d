"""From raw documents to packed training sequences, in five stages.

Each stage takes all that the one before kept and is written as Parquet in the
folder that the cluster shares; all but the last return the columns of
``documents``.  No SQL can express the stages as a whole (near-duplicate
components, suffix sorting, byte-level BPE), so ``ORACLE_SQL`` is None and
``tests/llm/test_pipeline.py`` holds every stage against brute force.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from roadweave.llm._store import discard, discard_unread, made, made_since, materialize
from roadweave.llm.minhash import keep_one_of_each
from roadweave.llm.mixing import mixed
from roadweave.llm.packing import pack_documents
from roadweave.llm.quality import keep_by_quality
from roadweave.llm.queries import tokenizer_path
from roadweave.llm.suffix import without_repeats


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
_SCRATCH: list[str] = []


def tidy(stage: Stage) -> Stage:
    """The tables that a stage leaves for its lazy result go when the next one starts, as its input has then been written; if that still reads them, they stay."""

    @functools.wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        discard_unread(spark, _SCRATCH, docs)
        mark = made()
        out = stage(spark, docs, sf_dir)
        _SCRATCH[:] = made_since(mark)
        return out

    return run_stage


@tidy
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Base rules and host verdicts; rejected documents go."""
    return keep_by_quality(docs)


@tidy
def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays."""
    return keep_one_of_each(docs)


@tidy
def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of more than 50 words that occur elsewhere are cut."""
    return without_repeats(docs)


@tidy
def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their sources' target weights ask for."""
    return mixed(docs)


@tidy
def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 2048 tokens, one row per piece with its ids."""
    return pack_documents(docs, tokenizer_path(), with_ids=True)


STAGES = [
    ("quality", quality),
    ("near_dedup", near_dedup),
    ("suffix_dedup", suffix_dedup),
    ("mixing", mixing),
    ("packing", packing),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs, before = materialize(stage(spark, docs, sf_dir), name), docs
        discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)
