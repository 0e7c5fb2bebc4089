"""Importance resampling towards a target distribution, over hashed word n-grams.

A 256-byte table lower-cases A-Z and blanks separators in the UTF-8 bytes of a text, so that ``bytes.split`` yields
its words; the checksum of a word seeds that of the word pair it begins, and so on for longer runs. Checksums modulo
``buckets`` are the features. Tasks reduce them with Counters, Spark adds the tasks' counts, and a bucket's gain is
the log ratio of its smoothed shares in the target and in the raw texts. A document's weight is the mean gain of its
features; Gumbel noise from a digest of its id is added, and the highest scores are drawn without replacement.

The gains are one number a bucket (``buckets`` of them, a parameter) and are sent to all tasks; nothing else is.
Ranks come from ranges of scores: rows are dealt by (score, id, number of the row), counted by range, and numbered
within it, so that equal scores and ids of any number of rows spread over tasks.

Defined results: a null or empty text has no features and weight 0; a null id is hashed as "" and comes after other
ids where scores tie; repeated rows count, score and rank each, in any order among themselves; without target or
without raw texts the gains are those of zero counts; an empty table gives an empty one; texts of any length are read
whole; other columns are not read.
"""

from __future__ import annotations

import hashlib
import math
from collections import Counter
from zlib import crc32

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import partitions, stored, workers_ready

#: A-Z to a-z; ASCII bytes that are neither letters nor digits to a blank; bytes of longer characters as they are
TABLE = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
FOLD = 200_000  # distinct checksums that a task's Counter holds before they are reduced to buckets
_SCORED = "doc_id long, n_words long, n_features long, weight long, score long"


def words_of(text: bytes | None) -> list[bytes]:
    return text.translate(TABLE).split() if text else []


def features(words: list[bytes], n: int) -> list[int]:
    """Checksums of all runs of 1 to n words joined by a blank; each order continues the checksums of the one before."""
    if not words:
        return []
    runs = list(map(crc32, words))
    out, spaced = list(runs), [b" " + w for w in words]
    for k in range(1, n):
        runs = list(map(crc32, spaced[k:], runs))
        out += runs
    return out


def bucket_counts(texts: DataFrame, column: str, n: int, buckets: int) -> DataFrame:
    """(bucket, n) of all features of a text column."""
    import pyarrow as pa

    workers_ready(texts.sparkSession)

    def run(batches):
        seen, total = Counter(), Counter()

        def fold():
            for crc, c in seen.items():
                total[crc % buckets] += c
            seen.clear()

        for b in batches:
            for t in b.column(0).to_pylist():
                seen.update(features(words_of(t), n))
                if len(seen) > FOLD:
                    fold()
        fold()
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array(list(total.values()), pa.int64())], ["bucket", "n"])

    counts = texts.select(F.col(column).cast("binary")).mapInArrow(run, "bucket long, n long")
    return counts.groupBy("bucket").agg(F.sum("n").alias("n"))


def _table(counts: DataFrame, buckets: int) -> list[int]:
    """The counts as a list by bucket: at most one row a bucket comes to the driver."""
    out = [0] * buckets
    for r in counts.collect():
        out[r["bucket"]] = r["n"]
    return out


def gains(raw: list[int], target: list[int]) -> list[int]:
    """floor(1000 ln) of each bucket's smoothed share in the target over that in the raw counts."""
    k, s_all, t_all = len(raw), float(sum(raw)), float(sum(target))
    return [math.floor(1000 * math.log((t + 1.0) * (s_all + k) / ((s + 1.0) * (t_all + k)))) for s, t in zip(raw, target)]


def noise(doc_id: int | None, seed: int) -> int:
    """Gumbel noise in thousandths from a digest of the id."""
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def scored(docs: DataFrame, gain: list[int], n: int, seed: int, id_col: str, text: str) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score) of all documents."""
    import pyarrow as pa

    table = np.array(gain, dtype=np.int64)

    def run(batches):
        for b in batches:
            ids, out = b.column(0).to_pylist(), []
            for i, t in zip(ids, b.column(1).to_pylist()):
                words = words_of(t)
                f = features(words, n)
                weight = int(table[np.array(f, dtype=np.int64) % len(table)].sum()) // len(f) if f else 0
                out.append((len(words), len(f), weight, weight + noise(i, seed)))
            columns = list(zip(*out)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (ids, *columns)], [c.split()[0] for c in _SCORED.split(", ")])

    return docs.select(F.col(id_col).cast("long"), F.col(text).cast("binary")).mapInArrow(run, _SCORED)


def ranked(rows: DataFrame) -> DataFrame:
    """rows with their place (1, 2, 3...) by falling score, then rising doc_id; rows come from a stored table."""
    import pyarrow as pa

    spark = rows.sparkSession

    def numbered(batches):
        from pyspark import TaskContext

        part, at = TaskContext.get().partitionId(), 0
        for b in batches:
            k = b.num_rows
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.full(k, part)), pa.array(np.arange(at + 1, at + k + 1))],
                                             [*b.schema.names, "part", "place"])
            at += k

    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("row")]
    dealt = rows.withColumn("row", F.monotonically_increasing_id())
    dealt = dealt.repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order).drop("row")
    kinds = ", ".join(f"{c} {t}" for c, t in dealt.dtypes)
    dealt = stored(dealt.mapInArrow(numbered, f"{kinds}, part long, place long"), "ranges")
    # One row for each range: no more than the partitions that the rows were dealt to.
    sizes = dealt.groupBy("part").agg(F.count("*").alias("size"))
    before = sizes.select("part", (F.sum("size").over(Window.orderBy("part")) - F.col("size")).alias("before"))
    return dealt.join(F.broadcast(before), "part").withColumn("rank", F.col("before") + F.col("place")).drop("part", "place", "before")


def resample(docs: DataFrame, target: DataFrame, percent: int = 25, min_words: int = 20, n: int = 2, buckets: int = 10_000,
             seed: int = 7, id_col: str = "doc_id", text: str = "text", target_text: str = "text") -> DataFrame:
    """(doc_id, n_features, weight, score, rank) of every document; rank is null where it isn't drawn.

    Drawn are the floor(percent * N / 100) highest scores of the N documents with at least min_words words.
    """
    gain = gains(_table(bucket_counts(docs, text, n, buckets), buckets), _table(bucket_counts(target, target_text, n, buckets), buckets))
    rows = stored(scored(docs, gain, n, seed, id_col, text), "scored")
    drawn = percent * rows.where(F.col("n_words") >= min_words).count() // 100
    placed = ranked(rows.where(F.col("n_words") >= min_words).drop("n_words"))
    placed = placed.withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    short = rows.where(F.col("n_words") < min_words).drop("n_words").withColumn("rank", F.lit(None).cast("long"))
    return placed.unionByName(short).select("doc_id", "n_features", "weight", "score", "rank")


#: The query of resample() with its defaults; the first rows build the checksum's table by its rule. A column of whole
#: numbers that may be null is a DOUBLE here, as a data frame of such a column is in either engine.
SQL = r"""WITH crc AS (
  SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)),
    lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
texts AS (SELECT row_number() OVER () AS row, doc_id, false AS aim, text FROM documents
  UNION ALL SELECT -row_number() OVER (), NULL, true, text FROM benchmark),
worded AS (SELECT row, doc_id, aim, CASE WHEN text IS NULL THEN [] ELSE regexp_extract_all(
  translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') END AS w FROM texts),
runs AS (
  SELECT row, aim, unnest(w) AS f FROM worded
  UNION ALL SELECT row, aim, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM worded),
counted AS (SELECT row, aim, f, count(*) AS n FROM runs GROUP BY ALL),
hashed AS (
  SELECT f, xor(list_reduce(list_prepend(4294967295, list_transform(range(strlen(f)), lambda i: ('0x' || substr(hex(encode(f)), 2 * i + 1, 2))::BIGINT)),
    lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 10000 AS bucket
  FROM (SELECT DISTINCT f FROM counted), crc),
bucketed AS (SELECT row, aim, bucket, sum(n) AS n FROM counted JOIN hashed USING (f) GROUP BY ALL),
totals AS (SELECT bucket, coalesce(sum(n) FILTER (NOT aim), 0)::DOUBLE AS s, coalesce(sum(n) FILTER (aim), 0)::DOUBLE AS t FROM bucketed GROUP BY ALL),
sums AS (SELECT coalesce(sum(s), 0) AS s_all, coalesce(sum(t), 0) AS t_all FROM totals),
gains AS (SELECT bucket, floor(1000 * ln((t + 1) * (s_all + 10000) / ((s + 1) * (t_all + 10000))))::BIGINT AS gain FROM totals, sums),
weights AS (SELECT row, sum(n)::BIGINT AS n_features, floor(sum(n * gain)::DOUBLE / sum(n)::DOUBLE)::BIGINT AS weight
  FROM bucketed JOIN gains USING (bucket) WHERE NOT aim GROUP BY row),
scored AS (SELECT doc_id, row, len(w) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
  coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('7:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score
  FROM worded LEFT JOIN weights USING (row) WHERE NOT aim),
ranked AS (SELECT *, CASE WHEN n_words >= 20 THEN row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id NULLS LAST, row) END AS place FROM scored)
SELECT doc_id, n_features, weight, score,
  CASE WHEN place <= (SELECT 25 * count(*) // 100 FROM scored WHERE n_words >= 20) THEN place END::DOUBLE AS rank FROM ranked
"""
