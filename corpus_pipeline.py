"""From raw documents to packed training sequences, in five stages.

Each stage takes ``(spark, docs, sf_dir)`` and works on all that the stage before it kept, written as Parquet and read
again. All but the last return the columns of ``documents``, whatever further ones the table has and however they are called.

Defined cases, in every stage: an empty table (of documents, labels or test items) gives no rows or changes nothing; texts are
read whole. What a null or empty text, a null ``doc_id``, and repeated rows come to is said at each stage.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from markerloom.llm import decontamination, minhash, packing, rule_ensemble, suffix_dedup
from markerloom.llm.bpe import vocabulary_path
from markerloom.llm.shared import read_table, written


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rule ensemble, learned from ``labels``, doesn't reject. Null and empty texts are judged by the
    statistics of an empty text; rows with a null ``doc_id`` are judged and never learned from; repeated rows are judged
    each. Without labels, or with one class only, all score the share of label 1 (0.5 without any), and nothing below 0.3."""
    return rule_ensemble.keep(docs, rule_ensemble.fit(docs, read_table(spark, sf_dir, "labels")))


def minhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that five-word shingles link at 0.8 or more: that with the smallest ``doc_id``. Null and
    empty texts, and rows with a null ``doc_id``, are linked with nothing and stay; of equal rows (by id and text) one stays;
    rows of one ``doc_id`` with different texts are documents of their own."""
    return minhash.deduplicate(docs)


def suffix_array_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of 50 words or more that another one keeps (that with the smallest ``doc_id``; within a
    document the first place). Null and empty texts, and rows with a null ``doc_id``, stay as they are; a document of which
    nothing is left goes."""
    return suffix_dedup.remove_repeats(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of ``benchmark``. Null and empty texts, and null or wordless items, match nothing; rows
    with a null ``doc_id`` and repeated rows are judged each."""
    return decontamination.decontaminate(docs, read_table(spark, sf_dir, "benchmark"))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces and their places in sequences of 1024. A null text is an empty one, whose piece is the end token; a null
    ``doc_id`` is kept; repeated rows are packed each."""
    return packing.pack(docs, vocabulary_path())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_classifier", quality_classifier),
    ("minhash_near_dedup", minhash_near_dedup),
    ("suffix_array_dedup", suffix_array_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("best_fit_packing", best_fit_packing),
]

#: SQL can't express the classifier's training, nor hashing and packing.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, over ``documents``."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
