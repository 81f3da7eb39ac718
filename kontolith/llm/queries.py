"""The registered queries of the training-data operators: ``QUERIES`` by name, ``ORACLES`` with DuckDB SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kontolith.llm import embedding_forest, line_spread, packing, page_diff, partenum, pseudo_likelihood, quality_rules, sentencepiece_lattice, toxicity, warc
from kontolith.llm.common import read_table
from kontolith.llm.oracles import EMBEDDING_SQL, JACCARD_SQL, WARC_SQL


def tokenizer_path(name: str) -> str:
    """Place of a public tokenizer file on this installation."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_lattice.encode_documents(read_table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"), with_ids=False)


def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudo_likelihood.pseudo_likelihood(read_table(spark, sf_dir, "documents"))


def op3_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_round_trip(read_table(spark, sf_dir, "pages"), least_bytes=1000)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity_scores(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"), threshold=0.7)


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(read_table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"), end_id=1, size=4096)


def op6_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_forest.embedding_classes(read_table(spark, sf_dir, "embeddings"), threshold=0.9)


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_verdicts(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op8_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return partenum.jaccard_classes(read_table(spark, sf_dir, "documents"), width=4, percent=85)


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_spread.remove_spread_lines(read_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_removed", F.length("text").cast("long").alias("n_kept_chars"), F.md5("text").alias("text_md5"))


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_diff.extract_text(read_table(spark, sf_dir, "pages"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_sentencepiece,
        op2_lm_scoring,
        op3_warc_round_trip,
        op4_toxicity,
        op5_best_fit_packing,
        op6_embedding_near_dedup,
        op7_quality_rules,
        op8_ngram_jaccard_join,
        op9_line_dedup,
        op10_html_extraction,
    )
}

ORACLES: dict[str, str] = {"op3_warc_round_trip": WARC_SQL, "op6_embedding_near_dedup": EMBEDDING_SQL, "op8_ngram_jaccard_join": JACCARD_SQL, "op9_line_dedup": line_spread.spread_oracle()}
