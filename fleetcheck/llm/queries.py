"""One query for each operator, over its whole table with production parameters, and the SQL where it can express one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, codes, decontaminate, html_text, lm, packing, quality, ranking, resample, simhash, simple8b, suffix, token_counts
from .common import documents, scratch_path
from .tokens import tokenizer_path

MARKS = "</s>[INST] ok [/INST]"


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as windows of 512 tokens, written, read back and digested; conversation -7 says marks of chat templates."""
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    kinds = dict(turns.dtypes)
    extra = spark.range(2).select(F.lit(-7).cast(kinds["conv_id"]).alias("conv_id"), F.col("id").cast(kinds["turn"]).alias("turn"),
                                  F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(MARKS).alias("text"))
    return chat.digests(chat.formatted_files(turns.unionByName(extra), budget=512, history=128))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.apply_rules(documents(spark, sf_dir), with_text=False)
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op3_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, item_id, first_word, similarity) of all documents against all benchmark items."""
    return decontaminate.contaminated(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simple8b.token_files(documents(spark, sf_dir), tokenizer_path("word_bpe_49k.json"))


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix.without_repeats(documents(spark, sf_dir).select("doc_id", "text"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op7_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_components(documents(spark, sf_dir))


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed_documents(documents(spark, sf_dir), tokenizer_path("word_bpe_49k.json"))


def op9_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.scores(documents(spark, sf_dir), tokenizer_path("word_bpe_49k.json"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts with a cache that begins empty, so that every distinct content is encoded once in this run."""
    return token_counts.token_counts(documents(spark, sf_dir), tokenizer_path("piece_bpe_32k.model"), scratch_path(spark, "token_cache"))


def op11_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of every document by the labels' quality; three quarters of the ids are for training."""
    return ranking.quality_scores(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op12_importance_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's weight and score towards the benchmark's texts; the quarter that is drawn has ranks."""
    return resample.resample(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codes.codes(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


QUERIES = {f.__name__: f for f in (
    op1_chat_format, op2_quality_rules, op3_html_extract, op4_decontaminate, op5_token_files, op6_suffix_dedup, op7_simhash_dedup,
    op8_best_fit_packing, op9_lm_score, op10_token_counts, op11_quality_classifier, op12_importance_resample, op13_vector_codes)}


SQL = {"op2_quality_rules": quality.SQL, "op12_importance_resample": resample.SQL, "op13_vector_codes": codes.SQL}
