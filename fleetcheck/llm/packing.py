"""Packing of documents into sequences of a fixed number of tokens: best fit, then swap-based local search.

Only documents longer than a sequence are cut. Pieces (id, piece, start, length, checksum; no tokens) are dealt by a
hash into groups of about ``GROUP`` pieces. In a group, best fit in falling order of length packs the pieces; then
the emptiest sequence is a donor, and fuller ones that are not full take from it: one piece (move), one for one, or
two for one. Each exchange raises the sum of squared fills, so the search ends; a donor that is empty goes.
Sequences that are still not nearly full are unpacked and packed again over ever fewer, merged groups.

Defined results: null and empty texts are one end id; ties go by id and piece; repeated rows are packed each; null
ids are kept; an empty table gives an empty one; columns other than the id and the text are not read.
"""

from __future__ import annotations

import bisect
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored, workers_ready
from .tokens import word_ids

SIZE = 4096
GROUP = 20_000
CACHE_WORDS, CACHE_UNITS = 100_000, 200_000  # fewer than elsewhere: in the pipeline workers stay beside the stages that follow
FULL = 0.995  # a sequence filled so far is not unpacked again
NO_ID = -(1 << 63)
MERGE = 16  # groups merged into one for the next round
_PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"
_PACKED = _PIECE + ", sequence_id long, offset long"


def pieces(docs: DataFrame, tokenizer: str, size: int = SIZE, end_id: int = 1) -> DataFrame:
    """The pieces of every whole text with end_id after it."""
    workers_ready(docs.sparkSession)

    def run(batches):
        import pyarrow as pa

        ids = word_ids(tokenizer, CACHE_WORDS, CACHE_UNITS)
        end = np.array([end_id], dtype="<u4")
        for b in batches:
            rows = []
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                v = np.concatenate([ids.encode(t), end])
                for k, a in enumerate(range(0, len(v), size)):
                    part = v[a:a + size]
                    rows.append((i, k, a, len(part), zlib.crc32(part.data)))
            cols = list(zip(*rows)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32() if k == 1 else pa.int64()) for k, c in enumerate(cols)],
                                             ["doc_id", "piece", "start", "length", "ids_crc32"])

    # pandas has no null in a column of whole numbers, so rows without an id carry NO_ID until the end.
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID).cast("long")).alias("doc_id"),
                       F.col("text").cast("string")).mapInArrow(run, _PIECE)


def best_fit(lengths: np.ndarray, size: int) -> list[list[int]]:
    """Rows of lengths by sequence: each, in falling order, goes where it leaves the least room."""
    room: list[tuple[int, int]] = []  # (room, sequence), rising
    out: list[list[int]] = []
    for i in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[i])
        at = bisect.bisect_left(room, (n, -1))
        if at == len(room):
            out.append([i])
            left, k = size - n, len(out) - 1
        else:
            left, k = room.pop(at)
            out[k].append(i)
            left -= n
        if left:
            bisect.insort(room, (left, k))
    return out


def _exchange(take: list[int], give: list[int], lengths, gap: int, least: int):
    """The best exchange: (rows to take from the donor, row to give back or None), gaining at most gap, at least least."""
    best, found = least - 1, None
    d = np.array([lengths[i] for i in take])
    g = np.array([0] + [lengths[i] for i in give])  # give nothing, or one row
    one = d[:, None] - g[None, :]
    ok = np.where(one <= gap, one, -1)
    at = int(ok.argmax())
    if ok.flat[at] > best:
        best = int(ok.flat[at])
        i, j = divmod(at, len(g))
        found = ([take[i]], give[j - 1] if j else None)
    if best < gap and len(take) > 1 and len(give):
        a, b = np.triu_indices(len(take), 1)
        two = (d[a] + d[b])[:, None] - g[None, 1:]
        ok = np.where(two <= gap, two, -1)
        at = int(ok.argmax())
        if ok.flat[at] > best:
            i, j = divmod(at, len(g) - 1)
            found = ([take[a[i]], take[b[i]]], give[j])
    return found


def local_search(bins: list[list[int]], lengths: np.ndarray, size: int) -> list[list[int]]:
    """Empty sequences by exchanges that raise the sum of squared fills; the number of sequences never rises."""
    lengths = lengths.tolist()
    need = -(-sum(lengths) // size)
    fill = [sum(lengths[i] for i in b) for b in bins]
    n_bins = len(bins)
    # The emptiest first as donors; a donor that can't be emptied is passed over, but can still take.
    stuck: set[int] = set()
    while n_bins > need:
        open_ = sorted((k for k in range(len(bins)) if bins[k] and fill[k] < size), key=lambda k: (fill[k], k))
        donors = [k for k in open_ if k not in stuck]
        if len(open_) < 2 or not donors:
            break
        donor = donors[0]
        changed = False
        for k in reversed(open_):
            # Only sequences fuller than the donor take from it, so each gain raises the sum of squares.
            while k != donor and bins[donor] and fill[k] >= fill[donor] and fill[k] < size:
                found = _exchange(bins[donor], bins[k], lengths, size - fill[k], 1)
                if not found:
                    break
                take, back = found
                gain = sum(lengths[i] for i in take) - (lengths[back] if back is not None else 0)
                bins[donor] = [i for i in bins[donor] if i not in take] + ([back] if back is not None else [])
                bins[k] = [i for i in bins[k] if i != back] + take
                fill[k] += gain
                fill[donor] -= gain
                changed = True
            if not bins[donor]:
                break
        if not bins[donor]:
            n_bins -= 1
        elif not changed:
            stuck.add(donor)
    return [b for b in bins if b]


def _pack(pdf: pd.DataFrame, size: int, group: int, level: int) -> pd.DataFrame:
    pdf = pdf.sort_values(["length", "doc_id", "piece", "start", "ids_crc32"], kind="stable", ignore_index=True)
    lengths = pdf["length"].to_numpy()
    bins = local_search(best_fit(lengths, size), lengths, size)
    seq, off = np.zeros(len(pdf), dtype=np.int64), np.zeros(len(pdf), dtype=np.int64)
    for k, rows in enumerate(bins):
        seq[rows] = k
        off[rows] = np.r_[0, np.cumsum(lengths[rows])[:-1]]
    return pdf.assign(sequence_id=(level << 56) + (group << 28) + seq, offset=off)


def _packer(size: int, level: int):
    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        g = int(key[0])
        return _pack(pdf.drop(columns=["g", "was"], errors="ignore"), size, g, level).assign(was=g)

    return run


def pack(parts: DataFrame, size: int = SIZE, group: int = GROUP) -> DataFrame:
    """parts (the columns of pieces) with sequence_id and offset. sequence_id holds the round, group and sequence."""
    parts = stored(parts, "pieces")
    count = parts.count()
    groups = max(-(-count // group), 1)
    done, level = None, 0
    rest = parts
    salt = F.xxhash64("doc_id", "piece", "start", "length", "ids_crc32")
    while True:
        # Equal rows have an equal hash; the running number deals those out as well.
        dealt = rest.withColumn("g", F.pmod(F.xxhash64(salt, F.monotonically_increasing_id() % 1024), F.lit(groups))) if level == 0 \
            else rest.withColumn("g", F.pmod(F.col("was"), F.lit(groups)))
        packed = stored(dealt.groupBy("g").applyInPandas(_packer(size, level), _PACKED + ", was long"), f"packed{level}")
        if groups == 1:
            last = packed.drop("was")
            return last if done is None else done.unionByName(last)
        fill = packed.groupBy("sequence_id").agg(F.sum("length").alias("fill")).where(F.col("fill") < FULL * size).select("sequence_id")
        ready = packed.join(fill, "sequence_id", "left_anti").drop("was").select(*[c.split()[0] for c in _PACKED.split(", ")])
        rest = stored(packed.join(fill, "sequence_id", "left_semi"), f"rest{level}")
        level, before = level + 1, groups
        groups = max(-(-groups // MERGE), -(-rest.count() // group), 1)
        if groups > before // 2:  # what is left doesn't shrink any more: these sequences stay as they are
            ready, rest = packed.drop("was"), None
        done = ready if done is None else done.unionByName(ready)
        if rest is None:
            return done
        rest = rest.drop("sequence_id", "offset")


def packed_documents(docs: DataFrame, tokenizer: str, size: int = SIZE, end_id: int = 1) -> DataFrame:
    """One row for each piece of docs, with its sequence and its place there."""
    out = pack(pieces(docs, tokenizer, size, end_id), size)
    return out.withColumn("doc_id", F.when(F.col("doc_id") != F.lit(NO_ID).cast("long"), F.col("doc_id")))
