"""Token counts with a digest cache.

The cache is a Parquet table (tokenizer digest, content digest, n_tokens) in a shared folder. Contents are reduced
to their SHA-256 digests (null counts as empty), joined to the stored counts of the same tokenizer version, and only
the distinct contents without a count are encoded; their counts are appended to the cache. Copies are one content,
however many rows hold it.

Defined results: null and empty texts have no tokens; a null id stays null; repeated rows are counted each; an empty
table gives an empty one and appends nothing; columns other than the id and the text are not read.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored, workers_ready
from .tokens import piece_counts, word_ids

HOT = 1000  # contents with over one row in so many are joined by broadcast
CACHE_SCHEMA = "tokenizer string, digest binary, n_tokens long"


def tokenizer_digest(path: str) -> str:
    with open(path, "rb") as fh:
        return hashlib.sha256(fh.read()).hexdigest()


def read_cache(spark: SparkSession, cache: str) -> DataFrame:
    """The stored counts; an empty table if nothing has been written yet."""
    path = spark._jvm.org.apache.hadoop.fs.Path(cache)
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], CACHE_SCHEMA)
    # Two runs may have appended the same content; a count depends on the key alone.
    return spark.read.schema(CACHE_SCHEMA).parquet(cache).dropDuplicates(["tokenizer", "digest"])


def _counted(rows: DataFrame, path: str) -> DataFrame:
    """(digest, copies, n_tokens) of rows (digest, copies, text)."""
    import pyarrow as pa

    def run(batches):
        count = piece_counts(path).count if path.endswith(".model") else (lambda t, ids=word_ids(path): len(ids.encode(t)))
        for b in batches:
            n = pa.array([count(t) for t in b.column(2).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), n], ["digest", "copies", "n_tokens"])

    return rows.mapInArrow(run, "digest binary, copies long, n_tokens long")


def token_counts(docs: DataFrame, path: str, cache: str, limit: int = 4096, id_col: str = "doc_id",
                 text: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of whole texts; path is the tokenizer's file.

    Copies are reduced to their content in each task before contents meet. Counts go back to the rows by a join:
    contents with more than one row in HOT (fewer than HOT contents) by broadcast, the others by shuffle.
    """
    spark = docs.sparkSession
    workers_ready(spark)
    version = tokenizer_digest(path)
    d = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    d = d.withColumn("digest", F.unhex(F.sha2(F.col("text"), 256)))
    known = read_cache(spark, cache).where(F.col("tokenizer") == version).select("digest", "n_tokens")
    contents = d.groupBy("digest").agg(F.count("*").alias("copies"), F.first("text").alias("text"))
    fresh = stored(_counted(contents.join(known, "digest", "left_anti").select("digest", "copies", "text"), path), "fresh_counts")
    held = d.groupBy("digest").agg(F.count("*").alias("copies")).join(known, "digest")
    counts = stored(held.unionByName(fresh), "counts")  # before the append, which the next read of the cache would see
    fresh.select(F.lit(version).alias("tokenizer"), "digest", "n_tokens").write.mode("append").parquet(cache)
    n = counts.agg(F.sum("copies")).first()[0] or 0
    hot = F.broadcast(counts.where(F.col("copies") * HOT > n).select("digest", "n_tokens"))
    rows = d.select("doc_id", "digest", F.octet_length("text").cast("long").alias("n_bytes"))
    rest = rows.join(hot, "digest", "left_anti").join(counts.select("digest", "n_tokens"), "digest")
    out = rows.join(hot, "digest").unionByName(rest)
    return out.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
