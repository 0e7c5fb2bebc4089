"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming search, weighted-shingle check.

Words are lower-cased and lose ASCII punctuation. A window has as many words as an item and is compared by its
five-word shingles with their counts (an item of fewer words is one shingle). A window that shares no shingle with
an item has similarity zero, so windows are taken around shared shingles only. Their 64-bit SimHash goes through a
multi-index of the items' fingerprints: fingerprints within ``radius`` bits differ in at most radius // 8 bits in
one of the eight bytes, so each byte looks up the items near it there and no item within the radius is missed. What
is found is checked by the weighted Jaccard similarity of the shingles, which must reach ``similarity``.

The items are read by every task in groups of at most ``ITEMS`` (rows of a bounded text each); more items mean more
passes over the documents, never fewer comparisons.

Defined results: null texts and items have no words and match nothing; repeated items match each; repeated
documents are judged each; ids may be null; ties for the best window go to the first; empty tables give empty ones.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import apart, stored, together, workers_ready

SHINGLE = 5
SIMILARITY = 0.8
RADIUS = 23  # at similarity 0.8 fingerprints differ in about 10 bits, with a deviation of about 3
ITEMS = 4096
MAX_ITEM_BYTES = 64 << 20  # of all items in a group
_PUNCTUATION = bytes(c for c in range(33, 127) if not chr(c).isalnum())
_MIX = np.uint64(0x9E3779B97F4A7C15)


class _Words(dict):
    """A word -> its 64-bit hash."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        h = xxhash.xxh3_64_intdigest(word)
        if len(self) >= 500_000:
            self.clear()
        if len(word) <= 64:
            self[word] = h
        return h


_WORDS = _Words()


def word_hashes(text: str | None) -> np.ndarray:
    words = (text or "").lower().encode().translate(None, _PUNCTUATION).split()
    return np.fromiter(map(_WORDS.__getitem__, words), dtype=np.uint64, count=len(words))


def shingles(words: np.ndarray, size: int) -> np.ndarray:
    """Hashes of the runs of size words."""
    n = len(words) - size + 1
    if n < 1:
        return np.zeros(0, dtype=np.uint64)
    h = words[:n].copy()
    for j in range(1, size):
        h *= _MIX
        h ^= h >> np.uint64(31)
        h += words[j:j + n]
    h *= _MIX
    return h ^ (h >> np.uint64(29))


def _bits(h: np.ndarray) -> np.ndarray:
    return np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def simhashes(h: np.ndarray, size: int) -> np.ndarray:
    """SimHash of each window of size shingles."""
    total = np.r_[np.zeros((1, 64), dtype=np.int32), np.cumsum(_bits(h), axis=0, dtype=np.int32)]
    ones = total[size:] - total[:-size]
    return np.packbits(ones * 2 > size, axis=1, bitorder="little").view("<u8").ravel()


def weighted_jaccard(a: np.ndarray, b: np.ndarray) -> float:
    ka, ca = np.unique(a, return_counts=True)
    kb, cb = np.unique(b, return_counts=True)
    _, ia, ib = np.intersect1d(ka, kb, assume_unique=True, return_indices=True)
    both = int(np.minimum(ca[ia], cb[ib]).sum())
    return both / (len(a) + len(b) - both)


class Items:
    """The items of one group: shingles, fingerprints and the multi-index."""

    def __init__(self, texts: list[str | None], radius: int = RADIUS):
        self.radius = radius
        self.words, self.shingles, size_of = [], [], []
        for t in texts:
            w = word_hashes(t)
            size = min(SHINGLE, len(w))
            self.words.append(len(w))
            self.shingles.append(shingles(w, size) if size else np.zeros(0, dtype=np.uint64))
            size_of.append(size)
        self.sizes = np.array(size_of, dtype=np.int64)
        self.prints = np.array([simhashes(s, len(s))[0] if len(s) else 0 for s in self.shingles], dtype=np.uint64)
        # For each shingle length, the items' shingles in order, with the items that hold them.
        self.by_size = {}
        for size in sorted(set(size_of) - {0}):
            pairs = [(s, i) for i, x in enumerate(self.shingles) if size_of[i] == size for s in set(x.tolist())]
            pairs.sort()
            key = np.array([p[0] for p in pairs], dtype=np.uint64)
            self.by_size[size] = (key, np.array([p[1] for p in pairs]), self._sieve(key))
        near = np.bitwise_count(np.arange(256)[:, None] ^ np.arange(256)[None, :]) <= radius // 8
        bytes_ = self.prints.view(np.uint8).reshape(-1, 8)
        self.index = [near[:, bytes_[:, k]] for k in range(8)]  # byte value -> items near it there

    @staticmethod
    def _sieve(key: np.ndarray) -> np.ndarray:
        sieve = np.zeros(1 << 20, dtype=bool)
        sieve[(key >> np.uint64(44)).astype(np.int64)] = True
        return sieve

    def candidates(self, prints: np.ndarray, item: int) -> np.ndarray:
        """Windows whose fingerprints the index finds near an item, within the radius."""
        found = np.zeros(len(prints), dtype=bool)
        by_byte = prints.view(np.uint8).reshape(-1, 8)
        for k in range(8):
            found |= self.index[k][by_byte[:, k], item]
        return np.flatnonzero(found & (np.bitwise_count(prints ^ self.prints[item]) <= self.radius))

    def matches(self, text: str | None, similarity: float = SIMILARITY) -> list[tuple[int, int, float]]:
        """(item, first word, similarity) of the best window of each item that reaches similarity."""
        words = word_hashes(text)
        out = []
        for size, (key, item_of, sieve) in self.by_size.items():
            if len(words) < size:
                continue
            h = shingles(words, size)
            at = np.flatnonzero(sieve[(h >> np.uint64(44)).astype(np.int64)])
            lo = np.searchsorted(key, h[at], side="left")
            n = np.searchsorted(key, h[at], side="right") - lo
            if not n.any():
                continue
            place = np.repeat(at, n)
            item = item_of[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)]
            for i in np.unique(item).tolist():
                best = self._best(h, place[item == i], i)
                if best and best[1] >= similarity:
                    out.append((i, *best))
        return sorted(out)

    def _best(self, h: np.ndarray, shared: np.ndarray, item: int):
        """(first word, similarity) of the item's best window that holds one of the shared shingles."""
        own = self.shingles[item]
        n = min(len(own), len(h))  # a text of fewer words than the item is one window
        last = len(h) - n
        lo, hi = np.maximum(shared - n + 1, 0), np.minimum(shared, last)
        best = None
        # Stretches of windows that overlap are taken together.
        cut = np.flatnonzero(np.r_[True, lo[1:] > np.maximum.accumulate(hi)[:-1] + 1])
        for a, b in zip(lo[cut].tolist(), np.maximum.reduceat(hi, cut).tolist()):
            prints = simhashes(h[a:b + n], n)
            for w in self.candidates(prints, item).tolist():
                s = weighted_jaccard(h[a + w:a + w + n], own)
                if best is None or s > best[1]:
                    best = (a + w, s)
        return best


def _groups(items: DataFrame, item_id: str, text: str):
    """The items in groups that a task can hold, read in order without bringing all to the driver at once."""
    rows, size = [], 0
    for r in items.select(item_id, text).toLocalIterator():
        n = len((r[1] or "").encode())
        if rows and (len(rows) >= ITEMS or size + n > MAX_ITEM_BYTES):
            yield rows
            rows, size = [], 0
        rows.append((r[0], r[1]))
        size += n
    if rows:
        yield rows


def contaminated(docs: DataFrame, items: DataFrame, similarity: float = SIMILARITY, id_col: str = "doc_id",
                 item_id: str = "item_id", text: str = "text") -> DataFrame:
    """(doc_id, item_id, first_word, similarity): the best window of each document and item that are alike."""
    spark = docs.sparkSession
    workers_ready(spark)
    schema = f"doc_id {docs.schema[id_col].dataType.simpleString()}, item_id {items.schema[item_id].dataType.simpleString()}, first_word long, similarity double"
    out = spark.createDataFrame([], schema)
    for group in _groups(items, item_id, text):
        shipped = spark.sparkContext.broadcast(group)

        def run(batches, shipped=shipped):
            import pyarrow as pa

            rows = shipped.value
            own = Items([t for _, t in rows])
            types = None
            for b in batches:
                found = [(d, rows[i][0], w, s) for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist())
                         for i, w, s in own.matches(t, similarity)]
                if found:
                    types = types or pa.array([r[0] for r in rows])
                    cols = list(zip(*found))
                    yield pa.RecordBatch.from_arrays([pa.array(cols[0], b.column(0).type), pa.array(cols[1], types.type),
                                                      pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.float64())],
                                                     ["doc_id", "item_id", "first_word", "similarity"])

        out = out.unionByName(docs.select(F.col(id_col).alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, schema))
    return out


def clean(docs: DataFrame, items: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """docs without those that match an item. Documents are told by a running row number, so ids may be null or repeat."""
    names = docs.columns
    rows = stored(apart(docs, names).withColumn("rid", F.monotonically_increasing_id()), "rows")
    texts = rows.select("rid", F.col(f"c{names.index('text')}").alias("text"))
    bad = contaminated(texts, items, similarity, id_col="rid").select(F.col("doc_id").alias("rid")).distinct()
    return rows.join(bad, "rid", "left_anti").select(*together(names))
