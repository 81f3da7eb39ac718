"""Corpus cleaning pipeline over ``documents``: each stage calls one training-data operator and works on all that the last kept.

``run`` writes every stage's result as Parquet to the shared folder and reads it again for the next. No stage can be
said in SQL as a whole (rules and scores are learned, packing is a heuristic), so ``ORACLE_SQL`` is None; the tests
compare the documents that each stage keeps with those planted for it; the operators have tests of their own (brute force, SQL, held-out rates).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from kontolith.llm import line_spread, packing, partenum, quality_rules, toxicity
from kontolith.llm.common import cut, read_table
from kontolith.llm.queries import tokenizer_path


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the learned rules reject go."""
    return quality_rules.keep_good(docs, read_table(spark, sf_dir, "labels"))


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents predicted toxic go; the model learns from the unfiltered documents, of which the labels speak."""
    return toxicity.keep_clean(docs, read_table(spark, sf_dir, "labels"), fit_on=read_table(spark, sf_dir, "documents"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of any length found on many sites stay in one document only; documents of which nothing is left go."""
    return line_spread.dedup_lines(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: that with the smallest id. Five-word shingles, similarity 0.8."""
    return partenum.keep_one_each(docs, width=5, percent=80)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of what is left and their places in sequences of 4096."""
    return packing.pack_documents(docs, tokenizer_path("word_bpe_49k.json"), end_id=1, size=4096)


STAGES = [("quality rules", quality), ("toxicity", toxic), ("line dedup", lines), ("n-gram Jaccard join", near_copies), ("best-fit packing", packed)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over ``documents``; the last stage's rows."""
    docs = read_table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir), "stage")
    return docs
