"""From documents to packed training sequences in five stages.

Each stage takes all rows that its predecessor kept: quality rules drop what
they reject, the n-gram Jaccard join leaves one document of each group of near
duplicates, the suffix stage cuts passages that repeat across documents, mixing
takes documents as often as the target weights ask, and packing places every
token in a sequence.

Each stage takes (spark, docs, sf_dir) and needs doc_id, text and (mixture)
source; all but the last return the columns of docs, extra ones included. A null
text is an empty one, a null source is a source of its own. An empty table stays
empty through all stages.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from colocus.llm import jaccard_join, mixing, packing, quality_rules, suffix_dedup
from colocus.llm.common import drop, saved, shared_folder
from colocus.llm.token_files import default_tokenizer

#: Bytes of a repeated passage: some forty words, so that passages of over fifty words are caught.
PASSAGE_BYTES = 200


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows whose text passes all rules; null and short texts go, equal rows stay or go together."""
    return quality_rules.kept_rows(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the row with the smallest doc_id, once where rows repeat. Texts without words link with nothing and stay; a row without doc_id goes if it is linked to one that has it."""
    return jaccard_join.one_of_each(docs, shared_folder(spark, "near"), width=5, percent=80)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row, without the bytes of strings of PASSAGE_BYTES that also start anywhere else, in every one of the places. A row whose text becomes blank by that goes; one that is null or blank before stays."""
    return suffix_dedup.cut_rows(docs, shared_folder(spark, "passages"), PASSAGE_BYTES)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as the mix takes it, from not at all to twice; ties go by a hash of the row, so reruns agree. Rows without words bring no words."""
    return mixing.mixed_rows(docs, shared_folder(spark, "mixture"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of every document in sequences of up to 2048 ids; an empty text is its end id alone, equal rows are packed apart."""
    return packing.pack(docs, shared_folder(spark, "packed"), default_tokenizer(), keep_cache=False)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("mixture", mixture),
    ("packing", packed),
]

#: The join, the suffix sort, the random mix and the packing are beyond SQL; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces of the table ``documents``; each stage's rows are written to the shared folder, read by the next and deleted."""
    folder = shared_folder(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = saved(stage(spark, docs, sf_dir), f"{folder}/{i}-{name}")
        if i:
            drop(spark, f"{folder}/{i - 1}-{STAGES[i - 1][0]}")
    return docs
