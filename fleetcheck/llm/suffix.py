"""Removal of repeated passages: every byte in a string of ``min_len`` bytes that starts anywhere else as well.

1. Anchors. The rolling hashes of a window's K-byte strings have a least value, the window's anchor; equal windows
   have equal anchors at equal places (the last one, if it occurs twice). A run is a stretch of windows of one text
   with the anchor at one place, so no two of its windows are equal; it is kept as hash, digest and place.
2. Runs whose anchor occurs once hold no repeated window. Runs with equal anchor and digest are equal strings, so
   all their windows repeat. What is left are different strings under one anchor, most of them where a repeated
   passage begins or ends.
3. One string of each kind goes, with its bytes, to a task by anchor. There the strings form one text; from its
   Burrows-Wheeler transform, intervals are extended backwards breadth first, which yields common-prefix lengths by
   increasing value, and the extension stops at min_len. Suffixes between which no shorter length was found repeat.
   Anchors with very many different strings go window by window instead, counted by 128-bit digests: such an anchor
   need not fit one task, and no count is capped.

Defined results: null and empty texts have no bytes and keep none; texts under min_len lose nothing; repeated rows
are copies of each other; ids may be null or repeated, as rows are numbered; an empty table gives an empty one;
other columns are kept, and the result's columns replace columns of the same name.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import apart, partitions, stored, together, workers_ready

MIN_LEN = 200
K = 64  # bytes of an anchor string
HOT = 2_000  # different strings of one anchor beyond which its windows are counted by digest
TASK_BYTES = 1 << 20  # bytes of strings for one task, about
_BASE = np.uint64(0x9E3779B97F4A7C15)
_SPAN = "rid long, start long, n long"


def _powers(n: int, cache: dict = {}) -> tuple[np.ndarray, np.ndarray]:  # noqa: B006
    """Powers of the base and of its inverse, modulo 2**64."""
    if len(cache.get("up", ())) < n:
        inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
        size = 1 << (n - 1).bit_length()
        one = np.ones(1, dtype=np.uint64)
        cache["up"] = np.r_[one, np.cumprod(np.full(size - 1, _BASE))]
        cache["down"] = np.r_[one, np.cumprod(np.full(size - 1, inverse))]
    return cache["up"][:n], cache["down"][:n]


def anchors(data: np.ndarray, min_len: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The anchor of each window of min_len bytes of data, as hashes, and whether it is the window's last string."""
    n = len(data)
    up, down = _powers(n)
    total = np.r_[np.zeros(1, dtype=np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up)]
    h = (total[k:] - total[:-k]) * down[:n - k + 1]
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    width, have, least = min_len - k + 1, 1, h
    while have * 2 <= width:
        least = np.minimum(least[:-have], least[have:])
        have *= 2
    if have < width:
        least = np.minimum(least[:len(least) - (width - have)], least[width - have:])
    return least, h[width - 1:] == least


def runs_of(texts: list[bytes], min_len: int = MIN_LEN, k: int = K):
    """(text, start, windows, anchor, digest) arrays of the runs of texts."""
    import xxhash

    whole = b"".join(texts)
    size = np.array([len(t) for t in texts], dtype=np.int64)
    if size.max(initial=0) < min_len:
        none = np.zeros(0, dtype=np.int64)
        return none, none, none, none, none
    k = min(k, min_len)
    h, entered = anchors(np.frombuffer(whole, dtype=np.uint8), min_len, k)
    begin = np.r_[0, np.cumsum(size)[:-1]]
    windows = np.maximum(size - min_len + 1, 0)
    # A run begins where the least value changes, or where an equal one comes in behind.
    fresh = entered | np.r_[True, h[1:] != h[:-1]]
    some = windows > 0
    step = np.zeros(len(whole) + 1, dtype=np.int8)
    step[begin[some]] = 1
    step[begin[some] + windows[some]] -= 1
    inside = np.cumsum(step[:len(h)], dtype=np.int8).astype(bool)
    fresh[begin[some]] = True
    start = np.flatnonzero(fresh & inside)
    owner = np.searchsorted(begin, start, side="right") - 1  # an empty text begins where the next does
    n = np.minimum(np.r_[start[1:], len(h)], begin[owner] + windows[owner]) - start
    digest = xxhash.xxh3_64_intdigest
    d = np.array([digest(whole[a:b]) for a, b in zip(start.tolist(), (start + n + min_len - 1).tolist())], dtype=np.uint64)
    return owner, start - begin[owner], n, h[start].view(np.int64), d.view(np.int64)


def suffix_order(t: np.ndarray, length: int) -> np.ndarray:
    """Rotations of t (symbols under 512) in order of their first length symbols or more, by prefix doubling."""
    n = len(t)
    ring = np.concatenate([t, np.resize(t, 7)]).astype(np.int64)
    key = np.zeros(n, dtype=np.int64)
    for j in range(7):  # seven symbols of nine bits
        key <<= 9
        key |= ring[j:j + n]
    have = 7
    while True:
        order = np.argsort(key)
        s = key[order]
        dense = np.cumsum(np.r_[0, s[1:] != s[:-1]])
        if have >= length or dense[-1] == n - 1:
            return order
        rank = np.empty(n, dtype=np.int64)
        rank[order] = dense
        key = rank * n + np.roll(rank, -have)
        have *= 2


def repeated(strings: list[bytes], min_len: int = MIN_LEN) -> list[np.ndarray]:
    """For each string, whether the min_len bytes from each of its windows' starts occur elsewhere in strings."""
    size = np.array([len(s) for s in strings], dtype=np.int64)
    t = np.frombuffer(b"\0".join(strings) + b"\0", dtype=np.uint8).astype(np.int16) + np.int16(1)
    ends = np.cumsum(size + 1) - 1
    t[ends] = 0  # parts the strings; no other symbol is zero
    n = len(t)
    order = suffix_order(t, min_len)
    bwt = t[order - 1]
    place = np.argsort(bwt, kind="stable")
    first = bwt[place]  # the symbols that the sorted suffixes begin with
    back = np.empty(n, dtype=np.int64)
    back[place] = np.arange(n)  # from a suffix to the one that begins a symbol earlier
    turn = np.r_[True, first[1:] != first[:-1]]

    known = np.zeros(n + 1, dtype=bool)  # whether the common prefix with the suffix before is known, so short
    known[[0, n]] = True
    owner_at = np.empty(n, dtype=np.int64)
    lo, hi = np.array([0]), np.array([n])
    for _ in range(min_len):
        if not len(lo):
            break
        one = hi - lo == 1
        alone = back[lo[one]]
        lo, hi = lo[~one], hi[~one]
        new_lo, new_hi = [alone], [alone + 1]
        if len(lo):
            # An interval's suffixes, a symbol earlier, lie in one interval for each symbol.
            width = hi - lo
            owner = np.repeat(np.arange(len(lo)), width)
            to = back[np.arange(len(owner)) - np.repeat(np.cumsum(width) - width - lo, width)]
            owner_at[to] = owner
            to.sort()
            owner = owner_at[to]
            cut = np.flatnonzero(np.r_[True, (owner[1:] != owner[:-1]) | turn[to[1:]] | (to[1:] - to[:-1] > 1)])
            new_lo.append(to[cut])
            new_hi.append(to[np.r_[cut[1:], len(to)] - 1] + 1)
        lo, hi = np.concatenate(new_lo), np.concatenate(new_hi)
        fresh = ~known[hi]
        lo, hi = lo[fresh], hi[fresh]
        known[hi] = True
    twice = np.zeros(n, dtype=bool)
    twice[order] = ~known[:-1] | ~known[1:]
    begin = ends - size
    return [twice[b:b + max(s - min_len + 1, 0)] for b, s in zip(begin.tolist(), size.tolist())]


def _chunks(texts: list[bytes], size: int = 1 << 20):
    """Consecutive texts of about size bytes together, whole, with the number of texts before."""
    at = total = 0
    for i, t in enumerate(texts):
        total += len(t)
        if total >= size:
            yield at, texts[at:i + 1]
            at, total = i + 1, 0
    if at < len(texts):
        yield at, texts[at:]


def _numbered(docs: DataFrame) -> DataFrame:
    """docs with a row number and the text as compressed bytes, written to the shared folder."""
    import pyarrow as pa

    others = [c for c in docs.columns if c not in ("text", "_rid", "_z", "_of", "_spans")]
    rows = docs.select(*[F.col(f"`{c}`") for c in others], F.monotonically_increasing_id().alias("_rid"),
                       F.col("text").cast("string").alias("_z"))
    schema = T.StructType([*rows.schema.fields[:-1], T.StructField("_z", T.BinaryType())])

    def run(batches):
        import zstandard

        press = zstandard.ZstdCompressor(level=1)
        for b in batches:
            z = pa.array([press.compress((t or "").encode()) for t in b.column(b.num_columns - 1).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], z], b.schema.names)

    return stored(rows.mapInArrow(run, schema), "numbered")


def _spans_of_runs(runs: DataFrame, table: DataFrame, min_len: int) -> list[DataFrame]:
    """Spans (rid, start, n windows) of repeated windows, as tables."""
    spark = runs.sparkSession
    # An anchor's runs need no more than counts and extremes, summed before they are dealt.
    several = runs.groupBy("anchor").agg(F.count("*").alias("c"), F.min("digest").alias("d0"), F.max("digest").alias("d1")).where(
        "c > 1").select("anchor", (F.col("d0") != F.col("d1")).alias("mixed"))
    # Sums are written before they are joined, so that Spark can split an anchor that very many runs have.
    hits = stored(runs.join(stored(several, "several"), "anchor"), "hits")
    spans = [hits.where("not mixed").select("rid", "start", "n")]
    mixed = hits.where("mixed").drop("mixed")
    kinds = stored(mixed.groupBy("anchor", "digest").agg(F.count("*").alias("c"), F.min("rid").alias("first")), "kinds")
    hot = stored(kinds.groupBy("anchor").agg(F.count("*").alias("n_kinds")).where(F.col("n_kinds") > HOT).select("anchor"), "hot")
    kinds = kinds.join(hot.withColumn("hot", F.lit(True)), "anchor", "left").withColumn("hot", F.coalesce("hot", F.lit(False)))
    known = stored(mixed.join(kinds, ["anchor", "digest"]).withColumn("single", F.col("c") == 1), "known")
    spans.append(known.where("not single").select("rid", "start", "n"))
    # Bytes of one run of each kind: the first one of its first text.
    shared = known.where("not single and rid = first").groupBy("anchor", "digest", "rid", "n", "hot", "single").agg(
        F.min("start").alias("start"))
    one = shared.unionByName(known.where("single").select(*shared.columns))
    wanted = one.groupBy("rid").agg(F.collect_list(F.struct(
        "start", "n", "anchor", "single", "hot")).alias("runs"))
    total = one.agg(F.sum(F.col("n") + min_len)).first()[0] or 0
    if not total:
        return spans
    tasks = max(int(total) // TASK_BYTES, partitions(spark))

    def cut(frames):
        import zstandard

        expand = zstandard.ZstdDecompressor()
        for f in frames:
            rows = []
            for rid, z, runs_ in zip(f["_rid"], f["_z"], f["runs"]):
                data = expand.decompress(z)
                for r in runs_:
                    a, n = r["start"], r["n"]
                    if not r["hot"]:
                        rows.append((rid, a, r["single"], data[a:a + n + min_len - 1], r["anchor"] % tasks, None, None))
                        continue
                    for i in range(a, a + n):
                        d = hashlib.blake2b(data[i:i + min_len], digest_size=16).digest()
                        rows.append((rid, i, r["single"], None, None, int.from_bytes(d[:8], "little", signed=True),
                                     int.from_bytes(d[8:], "little", signed=True)))
            out = pd.DataFrame(rows, columns=["rid", "start", "single", "data", "task", "w0", "w1"])
            for c in ("task", "w0", "w1"):
                out[c] = out[c].astype("Int64")
            yield out

    cuts = table.select("_rid", "_z").join(wanted, F.col("_rid") == F.col("rid")).select("_rid", "_z", "runs").mapInPandas(
        cut, "rid long, start long, single boolean, data binary, task long, w0 long, w1 long")
    cuts = stored(cuts, "cuts")

    def search(pdf: pd.DataFrame) -> pd.DataFrame:
        found = []
        for rid, start, single, twice in zip(pdf["rid"], pdf["start"], pdf["single"], repeated(list(pdf["data"]), min_len)):
            if single and twice.any():  # of the others all windows are known to repeat
                edge = np.flatnonzero(np.diff(np.r_[0, twice.astype(np.int8), 0]))
                found += [(rid, start + a, b - a) for a, b in zip(edge[::2].tolist(), edge[1::2].tolist())]
        return pd.DataFrame(found, columns=["rid", "start", "n"])

    spans.append(cuts.where("task is not null").groupBy("task").applyInPandas(search, _SPAN))
    hot = cuts.where("w0 is not null")
    twice = hot.groupBy("w0", "w1").agg(F.count("*").alias("c")).where("c > 1").select("w0", "w1")
    spans.append(hot.where("single").join(twice, ["w0", "w1"]).select("rid", "start", F.lit(1).cast("long").alias("n")))
    return spans


def without_repeats(docs: DataFrame, min_len: int = MIN_LEN, as_text: bool = False) -> DataFrame:
    """docs without their text, with n_bytes, n_removed, n_spans (long) and kept (binary, the bytes that are left).

    as_text: kept is a string; where a passage begins or ends inside a character, the rest of that character goes.
    """
    workers_ready(docs.sparkSession)
    names = [c for c in docs.columns if c not in ("text", "n_bytes", "n_removed", "n_spans", "kept")]
    held = apart(docs, [*names, "text"]).withColumnRenamed(f"c{len(names)}", "text")
    table = _numbered(held)

    def find(batches):
        import pyarrow as pa
        import zstandard

        expand = zstandard.ZstdDecompressor()
        for b in batches:
            rids = b.column(0).to_numpy()
            for at, texts in _chunks([expand.decompress(z) for z in b.column(1).to_pylist()]):
                owner, *rest = runs_of(texts, min_len)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (rids[at + owner], *rest)],
                                                 ["rid", "start", "n", "anchor", "digest"])

    runs = table.select("_rid", "_z").mapInArrow(find, "rid long, start long, n long, anchor long, digest long")
    spans = _spans_of_runs(stored(runs, "runs"), table, min_len)
    every = spans[0]
    for s in spans[1:]:
        every = every.unionByName(s)
    by_row = every.groupBy(F.col("rid").alias("_of")).agg(F.collect_list(F.struct("start", "n")).alias("_spans"))
    joined = table.join(by_row, F.col("_rid") == F.col("_of"), "left").drop("_of", "_rid")
    others = [c for c in joined.columns if c not in ("_z", "_spans")]
    shape = joined.select(*[F.col(f"`{c}`") for c in others], F.lit(0).cast("long").alias("n_bytes"), F.lit(0).cast("long").alias("n_removed"),
                          F.lit(0).cast("long").alias("n_spans"), F.lit("" if as_text else b"").alias("kept")).schema

    def remove(batches):
        import pyarrow as pa
        import zstandard

        expand = zstandard.ZstdDecompressor()
        for b in batches:
            sizes, gone, n_spans, kept = [], [], [], []
            for z, spans_ in zip(b.column("_z").to_pylist(), b.column("_spans").to_pylist()):
                data = expand.decompress(z)
                out, at, lost, count, last = [], 0, 0, 0, -1
                for a, e in sorted((s["start"], s["start"] + s["n"] + min_len - 1) for s in spans_ or ()):
                    if e <= at:
                        continue
                    if a > at:
                        out.append(data[at:a])
                        at = a
                    if a > last:  # a run that touches the one before goes on with it
                        count += 1
                    lost += e - at
                    at = last = e
                out.append(data[at:])
                sizes.append(len(data))
                gone.append(lost)
                n_spans.append(count)
                kept.append("".join(x.decode(errors="ignore") for x in out) if as_text else b"".join(out))
            cols = [b.column(c) for c in others] + [pa.array(x, pa.int64()) for x in (sizes, gone, n_spans)]
            cols.append(pa.array(kept, pa.string() if as_text else pa.binary()))
            yield pa.RecordBatch.from_arrays(cols, [*others, "n_bytes", "n_removed", "n_spans", "kept"])

    return joined.mapInArrow(remove, shape).select(*together(names), "n_bytes", "n_removed", "n_spans", "kept")
