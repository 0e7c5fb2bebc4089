"""The corpus pipeline: quality rules, SimHash near-duplicates, repeated passages, benchmark leaks, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the
next one's docs. All but the last return the columns of documents; a text that loses passages gets its new n_chars.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetcheck.llm import decontaminate, packing, quality, simhash, suffix
from fleetcheck.llm.common import documents, stored
from fleetcheck.llm.tokens import tokenizer_path

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules keep."""
    return quality.apply_rules(docs.select(COLUMNS)).where("kept").select(COLUMNS)


def simhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: 3-word shingles, 3 bits."""
    return simhash.keep_first(docs.select(COLUMNS))


def suffix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages of 200 bytes that repeat; what is left of a character cut in two goes as well.

    Documents of which nothing is left stay, with an empty text.
    """
    out = suffix.without_repeats(docs.select(COLUMNS), as_text=True).withColumn("text", F.col("kept"))
    return out.withColumn("n_chars", F.length("text").cast("long")).select(COLUMNS)


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.clean(docs.select(COLUMNS), spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select(COLUMNS)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of 4096 tokens."""
    return packing.packed_documents(docs, tokenizer_path("word_bpe_49k.json"))


STAGES = [
    ("quality_rules", quality_stage),
    ("simhash_dedup", simhash_stage),
    ("suffix_dedup", suffix_stage),
    ("decontamination", decontaminate_stage),
    ("best_fit_packing", packing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs


#: Tokenizers, packing and byte suffixes are beyond SQL; tests/llm holds run() against a brute-force version.
ORACLE_SQL = None
