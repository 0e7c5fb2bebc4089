"""SimHash near-duplicates: fingerprints, then a binary-trie self-join under a Hamming error budget.

Pairs within the budget differ in at most ``distance`` bits, so of ``distance + 1`` blocks of the fingerprint at
least one is equal, and of as many parts of the other bits again one. (block, value, part, value) is the routing
key; the distinct fingerprints of a key form one binary trie, joined with itself: node pairs go down together, add
up differing bits and are pruned beyond the budget. A node pair whose leaves are all in one component already is
pruned as well, so a dense group yields a spanning forest of its links and not all its pairs. Equal texts have one
fingerprint and enter the join once, however many copies there are.

Defined results: null and empty texts have fingerprint zero and link like any other; texts shorter than a shingle
give one shingle of all their words; repeated rows share a component, as do all rows of one id; rows without an id
take the component of their fingerprint, null if no row with it has an id (keep_first keeps such rows); an empty
table gives an empty one; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free_name, partitions, stored, workers_ready
from .components import components

BITS = 64


def fingerprint(text: str | None, words: int = 3) -> int:
    import xxhash

    w = (text or "").encode().lower().split()
    if not w:
        return 0
    joined = b" ".join(w)
    n = max(len(w) - words + 1, 1)
    if n == 1:
        return xxhash.xxh64_intdigest(joined, 42)
    lengths = np.fromiter(map(len, w), dtype=np.int64, count=len(w))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[:n].tolist()
    ends = ends[words - 1:].tolist()
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(joined[a:b], 42) for a, b in zip(starts, ends)], dtype="<u8")
    ones = np.zeros(BITS, dtype=np.int64)
    for i in range(0, n, 1 << 16):
        ones += np.unpackbits(h[i:i + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, words: int = 3, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fp): fp is the fingerprint as a signed 64-bit number."""
    import pyarrow as pa

    workers_ready(docs.sparkSession)

    def run(batches):
        for b in batches:
            fp = np.array([fingerprint(t, words) for t in b.column(1).to_pylist()], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp)], ["doc_id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).cast("string").alias("_t")).mapInArrow(
        run, "doc_id long, fp long")


def _keys(distance: int):
    """Columns of routing keys: a block of the bits, its value, a part of the others, its value, hashed together."""
    m = distance + 1
    cuts = [BITS * i // m for i in range(m + 1)]
    out = []
    for i in range(m):
        block = list(range(cuts[i], cuts[i + 1]))
        rest = [x for x in range(BITS) if x not in block]
        parts = [len(rest) * j // m for j in range(m + 1)]
        for j in range(m):
            mask = sum(1 << x for x in block + rest[parts[j]:parts[j + 1]])
            mask = mask - (1 << 64) if mask >= 1 << 63 else mask
            out.append(F.xxhash64(F.lit(i * m + j), F.col("fp").bitwiseAND(F.lit(mask))))
    return out


def _roots(label: np.ndarray, x: np.ndarray) -> np.ndarray:
    r = label[x]
    while True:
        up = label[r]
        if np.array_equal(up, r):
            return r
        r = up


def _unite(label: np.ndarray, a: np.ndarray, b: np.ndarray):
    """Hook the roots of links (a, b) together; gives the links that joined two trees."""
    kept_a, kept_b = [], []
    while len(a):
        ra, rb = _roots(label, a), _roots(label, b)
        go = ra != rb
        a, b, ra, rb = a[go], b[go], ra[go], rb[go]
        if not len(a):
            break
        high, low = np.maximum(ra, rb), np.minimum(ra, rb)
        # one link for each higher root, so that no link closes a ring
        _, first = np.unique(high, return_index=True)
        label[high[first]] = low[first]
        kept_a.append(a[first])
        kept_b.append(b[first])
    return kept_a, kept_b


def trie_links(group: np.ndarray, fps: np.ndarray, distance: int, frontier: int = 1 << 20):
    """Spanning links (i, j) of rows with an equal group and fingerprints within distance.

    The rows must be sorted by (group, fp) and distinct. A trie node is a range of rows that agree on a group and
    the leading bits; frontier bounds the node pairs held at once.
    """
    n = len(fps)
    label = np.arange(n)
    out_a, out_b = [], []
    edge = np.flatnonzero(np.r_[True, group[1:] != group[:-1], True])
    lo, hi = edge[:-1], edge[1:]
    big = hi - lo > 1
    zero = np.zeros(int(big.sum()), dtype=np.int64)
    todo = [(0, lo[big], hi[big], lo[big], hi[big], zero)]
    while todo:
        bit, a0, a1, b0, b1, used = todo.pop()
        if len(a0) > frontier:
            cut = len(a0) // 2
            todo.append((bit, a0[cut:], a1[cut:], b0[cut:], b1[cut:], used[cut:]))
            todo.append((bit, a0[:cut], a1[:cut], b0[:cut], b1[:cut], used[:cut]))
            continue
        single = (a1 - a0 == 1) & (b1 - b0 == 1)
        if single.any():
            i, j = a0[single], b0[single]
            near = np.bitwise_count(fps[i] ^ fps[j]) <= distance
            ka, kb = _unite(label, i[near & (i != j)], j[near & (i != j)])
            out_a += ka
            out_b += kb
            a0, a1, b0, b1, used = (x[~single] for x in (a0, a1, b0, b1, used))
        if bit == BITS or not len(a0):
            continue
        # Prune pairs whose rows are all in one component.
        flat = _roots(label, np.arange(n))
        steps = np.flatnonzero(np.r_[True, flat[1:] != flat[:-1]])  # starts of runs of one component
        run = np.searchsorted(steps, np.arange(n), side="right")
        one = (run[a0] == run[a1 - 1]) & (run[b0] == run[b1 - 1]) & (flat[a0] == flat[b0])
        a0, a1, b0, b1, used = (x[~one] for x in (a0, a1, b0, b1, used))
        if not len(a0):
            continue
        # Split each node at this bit: rows from the first with the bit set.
        ones = np.r_[0, np.cumsum((fps >> np.uint64(BITS - 1 - bit)) & np.uint64(1)).astype(np.int64)]
        am, bm = a1 - (ones[a1] - ones[a0]), b1 - (ones[b1] - ones[b0])
        own = (a0 == b0) & (a1 == b1)
        ways = [(a0, am, b0, bm, used, None), (am, a1, bm, b1, used, None), (a0, am, bm, b1, used + 1, None),
                (am, a1, b0, bm, used + 1, own)]  # the mirror of a node with itself is left out
        nxt = []
        for x0, x1, y0, y1, u, skip in ways:
            ok = (x1 > x0) & (y1 > y0) & (u <= distance)
            if skip is not None:
                ok &= ~skip
            ok &= ~((x1 - x0 == 1) & (x0 == y0) & (x1 == y1))
            nxt.append([x[ok] for x in (x0, x1, y0, y1, u)])
        todo.append((bit + 1, *(np.concatenate(c) for c in zip(*nxt))))
    cat = lambda x: np.concatenate(x) if x else np.zeros(0, dtype=np.int64)
    return cat(out_a), cat(out_b)


def near_links(fps: DataFrame, distance: int = 3, id_col: str = "node") -> DataFrame:
    """(a, b): links that span, within each routing key, the rows of distinct (node, fp) within distance bits."""
    spark = fps.sparkSession
    n = max(partitions(spark), 1)
    routed = fps.select(F.col(id_col).alias("node"), "fp", F.explode(F.array(*_keys(distance))).alias("key"))
    # Keys with one fingerprint have no pair; they go before the rows are gathered.
    shared = routed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    routed = routed.join(shared, "key", "left_semi").withColumn("task", F.pmod("key", F.lit(n * 4)))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        f = pdf["fp"].to_numpy().view(np.uint64)
        key = pdf["key"].to_numpy()
        order = np.lexsort((f, key))
        node = pdf["node"].to_numpy()[order]
        a, b = trie_links(key[order], f[order], distance)
        return pd.DataFrame({"a": node[a], "b": node[b]}).drop_duplicates()

    return routed.groupBy("task").applyInPandas(run, "a long, b long")


def simhash_components(docs: DataFrame, words: int = 3, distance: int = 3) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of docs."""
    workers_ready(docs.sparkSession)
    prints = stored(fingerprints(docs, words), "fingerprints")
    # One node for each distinct fingerprint, named by its least doc_id.
    nodes = prints.groupBy("fp").agg(F.min("doc_id").alias("first"))
    nodes = stored(nodes, "nodes")
    named = nodes.where("first is not null").withColumnRenamed("first", "node")
    nameless = nodes.where("first is null").select("fp")  # only rows without an id
    links = near_links(named, distance)
    comps = stored(components(links), "components").withColumnsRenamed({"node": "first", "component": "root"})
    of_fp = named.withColumnRenamed("node", "first").join(comps, "first", "left").select(
        F.col("fp").alias("_fp"), F.coalesce("root", "first").alias("component_id"))
    of_fp = of_fp.unionByName(nameless.select(F.col("fp").alias("_fp"), F.lit(None).cast("long").alias("component_id")))
    return prints.join(of_fp, F.col("fp") == F.col("_fp")).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_first(docs: DataFrame, words: int = 3, distance: int = 3) -> DataFrame:
    """docs with one document of each component: the one with the least id, and one row of it."""
    comp = simhash_components(docs, words, distance)
    name = free_name(docs.columns, "keep")
    kept = comp.where("doc_id = component_id").select(F.col("doc_id").alias(name)).distinct()
    out = docs.join(kept, docs["doc_id"] == kept[name], "left_semi").dropDuplicates(["doc_id"])
    return out.unionByName(docs.where("doc_id is null"))
