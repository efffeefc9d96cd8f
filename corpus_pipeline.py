"""The corpus pipeline: five operators in a row, each over all rows that its predecessor kept."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from hyperloom.llm._scratch import Scope, scope, scratch_path
from hyperloom.llm.jaccard_join import one_per_component
from hyperloom.llm.mixing import mixed_documents
from hyperloom.llm.packing import pack_documents
from hyperloom.llm.quality import kept_documents
from hyperloom.llm.substring import deduplicated

TOKENIZER = "byte_bpe_50k.json"
_before: list[Scope] = []


def _stage(f: Callable[[DataFrame], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """A stage whose intermediate tables go when the next stage begins; by then its result has been written."""

    @wraps(f)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        while _before:
            _before.pop().remove()
        with scope() as tables:
            out = f(docs)
        _before.append(tables)
        return out

    return run_stage


@_stage
def quality(docs: DataFrame) -> DataFrame:
    """Documents that the base rule or a threshold rejects go."""
    return kept_documents(docs)


@_stage
def near_duplicates(docs: DataFrame) -> DataFrame:
    """Of each group of linked documents the one with the smallest doc_id stays; documents without a doc_id or without words stay."""
    return one_per_component(docs)


@_stage
def repeated_passages(docs: DataFrame) -> DataFrame:
    """Passages of 13 words or more that an earlier document holds are cut out; every document stays, with what is left."""
    return deduplicated(docs)


@_stage
def mixture(docs: DataFrame) -> DataFrame:
    """Sources meet their targets: a row for each cycle in which the mix takes a document, with the words that it takes."""
    return mixed_documents(docs)


@_stage
def packing(docs: DataFrame) -> DataFrame:
    """Every row with its number of tokens, length bucket, batch and place in the batch."""
    return pack_documents(docs, public_tokenizers.path(TOKENIZER))


STAGES = [
    ("quality rules", quality),
    ("n-gram Jaccard join", near_duplicates),
    ("substring dedup", repeated_passages),
    ("mixing", mixture),
    ("packing", packing),
]
#: Connected components over similar sets, and a dynamic program, are beyond SQL; tests/llm compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table documents, each written and read back before the next; a stage's result goes when its successor's is there.

    Null and empty texts fail the quality rules.  Rows without a doc_id are never taken for copies, and neither lose passages nor make others lose
    them; rows with one doc_id are one node of the near-duplicate graph, and all of them stay or go.  Rows without a source are a source of their own.
    Columns other than those of documents pass through all stages, but for those named like a column that packing adds, which are replaced.  An
    empty table gives an empty result.
    """
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        with scope() as written:
            path = scratch_path(spark, f"pipeline-{name.replace(' ', '-')}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if last:
            last.remove()
        last = written
    while _before:
        _before.pop().remove()
    return docs
