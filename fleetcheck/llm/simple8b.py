"""Simple-8b coding of token ids, and the file format built on it.

A 64-bit word has a selector in its upper 4 bits and, below, a fixed count of ids of equal width. Selector 15 is an
escape: the next word holds one id as it is. A block is a run of whole documents; blocks are rows of a Parquet
dataset: (shard, block, shard_start, n_docs, n_tokens, doc_ids, counts, offsets, words). shard_start counts the ids of
the shard's blocks before; offsets gives, for each document, the first id's place in its block, so a reader decodes
a block as a whole with numpy and slices it.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import partitions, scratch_path, workers_ready
from .tokens import word_ids

#: Fixed by the coding: ids in a word and bits of each, by selector
COUNTS = np.array([60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1])
WIDTHS = 60 // COUNTS
ESCAPE = 15
_WIDTH_16 = np.frexp(np.arange(1 << 16, dtype=np.float64))[1].astype(np.uint8)  # bits of each number
BLOCK_IDS = 1 << 16  # a block is closed at the first document end beyond so many ids


def encode(ids: np.ndarray) -> np.ndarray:
    """ids (unsigned) -> uint64 words. Each word takes as many of the next ids as fit; the last may be padded."""
    v = ids.astype(np.uint64)
    n = len(v)
    if not n:
        return np.zeros(0, dtype=np.uint64)
    if int(v.max()) < 1 << 16:
        width = _WIDTH_16[v]
    else:  # the place of the highest bit, counted from one; halves keep the conversion to float exact
        high = np.frexp((v >> np.uint64(32)).astype(np.float64))[1]
        width = np.where(high > 0, high + 32, np.frexp((v & np.uint64(0xFFFFFFFF)).astype(np.float64))[1]).astype(np.uint8)
    widest = int(width.max())
    chosen = np.full(n, ESCAPE, dtype=np.int8)
    for s in range(len(COUNTS) - 1, -1, -1):  # later ones hold more ids
        if s and WIDTHS[s - 1] >= widest:
            continue  # the one before holds more and fits everything as well
        # Whether this many ids from here on are narrow enough; behind the end everything is.
        ok = np.concatenate([width <= WIDTHS[s], np.ones(COUNTS[s] - 1, dtype=bool)])
        have = 1
        while have * 2 <= COUNTS[s]:
            ok = ok[:-have] & ok[have:]
            have *= 2
        if have < COUNTS[s]:
            ok = ok[:n] & ok[COUNTS[s] - have:]
        chosen[ok] = s
    left = np.arange(n, 0, -1)
    step = np.minimum(np.r_[COUNTS, 0, 1][chosen], left)
    jump = (np.arange(n) + step).tolist()
    starts, i = [], 0
    while i < n:
        starts.append(i)
        i = jump[i]
    starts = np.array(starts)
    sel = chosen[starts]
    place = np.arange(len(starts)) + np.r_[0, np.cumsum(sel == ESCAPE)[:-1]]  # an escape takes a second word
    words = np.zeros(len(starts) + int((sel == ESCAPE).sum()), dtype=np.uint64)
    padded = np.r_[v, np.zeros(60, dtype=np.uint64)]
    for s in np.unique(sel):
        of = sel == s
        if s == ESCAPE:
            words[place[of]] = np.uint64(ESCAPE) << np.uint64(60)
            words[place[of] + 1] = v[starts[of]]
            continue
        lanes = padded[starts[of][:, None] + np.arange(COUNTS[s])]
        if (starts[of] + COUNTS[s] > n).any():
            lanes[starts[of][:, None] + np.arange(COUNTS[s]) >= n] = 0
        packed = np.bitwise_or.reduce(lanes << (np.arange(COUNTS[s]) * WIDTHS[s]).astype(np.uint64), axis=1)
        words[place[of]] = packed | (np.uint64(s) << np.uint64(60))
    return words


def decode(words: np.ndarray, n: int) -> np.ndarray:
    """The n ids of encode's words as uint64."""
    if not n:
        return np.zeros(0, dtype=np.uint64)
    sel = (words >> np.uint64(60)).astype(np.int64)
    # A word after an escape is raw, whatever its upper bits say; escapes are rare and read in order.
    raw = np.zeros(len(words), dtype=bool)
    for i in np.flatnonzero(sel == ESCAPE).tolist():
        if not raw[i]:
            raw[i + 1] = True
    head = ~raw
    escape = head & (sel == ESCAPE)
    count = np.zeros(len(words), dtype=np.int64)
    plain = head & ~escape
    count[plain] = COUNTS[sel[plain]]
    count[escape] = 1
    start = np.r_[0, np.cumsum(count)[:-1]]
    out = np.zeros(int(count.sum()), dtype=np.uint64)
    for s in np.unique(sel[plain]):
        of = np.flatnonzero(plain & (sel == s))
        k, bits = int(COUNTS[s]), int(WIDTHS[s])
        lanes = (words[of][:, None] >> (np.arange(k) * bits).astype(np.uint64)) & np.uint64((1 << bits) - 1)
        out[(start[of][:, None] + np.arange(k)).ravel()] = lanes.ravel()
    e = np.flatnonzero(escape)
    out[start[e]] = words[e + 1]
    return out[:n]


_BLOCK = "shard long, block long, shard_start long, n_docs long, n_tokens long, doc_ids binary, counts binary, offsets binary, words binary"


def write_blocks(docs: DataFrame, path: str, tokenizer: str, end_id: int = 1, id_col: str = "doc_id",
                 text: str = "text", block_ids: int = BLOCK_IDS) -> None:
    """Encode whole texts (null: empty), each followed by end_id, and write blocks in ascending order of id.

    The texts are dealt by ranges of ids, then encoded and cut into blocks. Ranges are found from the rows as they
    are, so nothing is encoded for that. Rows with equal ids lie in order of their texts; null ids come first and
    are written as -2**63.
    """
    spark = docs.sparkSession
    workers_ready(spark)

    def blocks(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        coder = word_ids(tokenizer)
        shard, block, done = TaskContext.get().partitionId(), 0, 0
        doc_ids, counts, parts, total = [], [], [], 0
        end = np.array([end_id], dtype="<u4")
        names = [c.split()[0] for c in _BLOCK.split(", ")]

        def close():
            words = encode(np.concatenate(parts))
            first = np.r_[0, np.cumsum(counts)[:-1]].astype("<i8")
            row = (shard, block, done, len(counts), total, np.array(doc_ids, "<i8").tobytes(), np.array(counts, "<i8").tobytes(),
                   first.tobytes(), words.astype("<u8").tobytes())
            return pa.RecordBatch.from_arrays([pa.array([x], pa.int64() if isinstance(x, int) else pa.binary()) for x in row], names)

        for b in batches:
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                v = coder.encode(t)
                doc_ids.append(i)
                counts.append(len(v) + 1)
                parts += [v, end]
                total += len(v) + 1
                if total >= block_ids:
                    yield close()
                    block, done = block + 1, done + total
                    doc_ids, counts, parts, total = [], [], [], 0
        if counts:
            yield close()

    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63)).cast("long")).alias("doc_id"),
                       F.col(text).cast("string").alias("text"))
    ordered = rows.repartitionByRange(partitions(spark), "doc_id").sortWithinPartitions("doc_id", "text")
    ordered.mapInArrow(blocks, _BLOCK).write.parquet(path)


def read_blocks(spark, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document in a dataset of blocks, decoded from its files.

    start counts the ids of all shards before, of the blocks before in its shard, and of the documents before in its
    block. The running count goes over one row for each shard.
    """
    workers_ready(spark)
    from pyspark.sql import Window

    files = spark.read.schema(_BLOCK).parquet(path)
    shards = files.groupBy("shard").agg(F.sum("n_tokens").alias("_sum"))
    before = shards.select(F.col("shard").alias("_shard"), (F.sum("_sum").over(Window.orderBy("shard")) - F.col("_sum")).alias("_before"))
    # One row for each shard: no more than the partitions that wrote them.
    placed = files.join(F.broadcast(before), F.col("shard") == F.col("_shard"))

    def run(frames):
        for f in frames:
            for r in f.itertuples(index=False):
                ids = decode(np.frombuffer(r.words, "<u8"), r.n_tokens).astype("<u4")
                n, off = np.frombuffer(r.counts, "<i8"), np.frombuffer(r.offsets, "<i8")
                crc = [zlib.crc32(ids[a:a + k].data) for a, k in zip(off.tolist(), n.tolist())]
                doc_id = np.frombuffer(r.doc_ids, "<i8")
                yield pd.DataFrame({"doc_id": doc_id, "start": r.base + off, "n_tokens": n, "ids_crc32": crc})

    out = placed.select("n_tokens", "doc_ids", "counts", "offsets", "words", (F.col("_before") + F.col("shard_start")).alias("base"))
    out = out.mapInPandas(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
    return out.withColumn("doc_id", F.when(F.col("doc_id") != F.lit(-(1 << 63)).cast("long"), F.col("doc_id")))


def token_files(docs: DataFrame, tokenizer: str, end_id: int = 1) -> DataFrame:
    """Write docs as blocks to a new path in the shared folder and read them back."""
    path = scratch_path(docs.sparkSession, "tokens")
    write_blocks(docs, path, tokenizer, end_id)
    return read_blocks(docs.sparkSession, path)
