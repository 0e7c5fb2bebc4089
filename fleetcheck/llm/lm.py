"""Language-model scores: a causal self-attention model, trained in numpy on subword ids, beside a word unigram base.

Ids fall into classes, coarse ones for what is predicted and fine ones for what is read: the most frequent ids each
have their own, the others share classes of about equal weight. The model gives the next coarse class from a window
of fine-class embeddings with positions by one masked attention layer, whose output is added to the log frequencies
of the class after the last fine class; an id has its share of its class after that fine class. These frequencies
come from every training text. The attention's weights are fitted in rounds: each task starts from the same weights,
takes steps on the round's windows of its training texts, and Spark averages the weights. A hash of the text's id and
the window's number says the round of a window, so that each window of each training text takes part in one round.

The model's distribution is the one that counts of contexts back off to. A context is the two ids before, as far as
they belong to one unit (a word or a mark; the vocabulary tells its last id), or the last id of the unit before. Its
counts come from every training text and all of them count: the model sent to tasks holds the ``ENTRIES`` most frequent
pairs of context and id, the others are joined to the ids that ask for them. Where a unit begins, the two are averaged.

Scoring: windows of ``WIDTH`` ids overlap by ``OVERLAP``, whose predictions count in the window before only, so each
id, and the end id, is scored once. Windows of many texts go through masked attention together.

Defined results: null and empty texts have the end token only; without training texts all counts are zero and ids
equally likely; a null id counts as "" for the split; repeated rows and ids are scored each;
very long texts are many windows; an empty table gives an empty one; other columns are not read.
"""

from __future__ import annotations

import copy
import math
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored, workers_ready
from .tokens import forget, word_ids

END_ID = 49407
IDS = 49408
SHARED = 16  # classes for ids without one of their own
CLASSES = 64  # coarse, predicted
FINE = 256  # read; one more stands for the beginning of a text
DIM = 16
WIDTH, OVERLAP = 32, 8
ROUNDS = 3
BATCH = 256  # windows at once
CHUNK_IDS = 50_000  # about so many ids are laid out in windows at once
PAIR_IDS = 500_000  # about so many ids are laid out in contexts at once
PAIR_ROWS = 1_000_000  # a task hands its counts of pairs on when there are more
RATE = 0.01
ENTRIES = 1 << 20  # pairs of context and id, at most, that are sent to all tasks; the others are joined
FREQUENT = 400_000  # words, at most, whose counts are sent to all tasks; the others are joined
END_WORD = b" "  # no word holds a blank
START, NONE = 65534, 65535  # before a text; no id in this place of a context

#: "qk" is the product of the weights of queries and keys, "vo" that of values and their output: with one head as wide as
#: the embeddings each pair of matrices only ever acts as its product, which may be any matrix of this shape.
SHAPES = {"emb": (FINE + 1, DIM), "pos": (WIDTH, DIM), "qk": (DIM, DIM), "vo": (DIM, DIM), "out": (DIM, CLASSES)}


def flat(p: dict) -> np.ndarray:
    return np.concatenate([p[k].ravel() for k in SHAPES])


def shaped(x: np.ndarray) -> dict:
    out, at = {}, 0
    for k, s in SHAPES.items():
        n = int(np.prod(s))
        out[k] = x[at:at + n].reshape(s).astype(np.float32)
        at += n
    return out


def start_weights(seed: int = 7) -> dict:
    rng = np.random.default_rng(seed)
    p = {k: (rng.standard_normal(s) * 0.3 / np.sqrt(s[0] if len(s) > 1 and k not in ("emb", "pos") else 1)).astype(np.float32)
         for k, s in SHAPES.items()}
    p["out"][:] = 0
    return p


def classes(counts: np.ndarray, n: int) -> np.ndarray:
    """The class of each id: n - SHARED of single ids, then SHARED of about equal weight."""
    order = np.argsort(-counts, kind="stable")
    out = np.zeros(IDS, dtype=np.int64)
    out[order[:n - SHARED]] = np.arange(n - SHARED)
    rest = order[n - SHARED:]
    mass = np.cumsum(counts[rest] + 1.0)
    out[rest] = n - SHARED + np.minimum((mass - 1e-9) * SHARED // mass[-1], SHARED - 1).astype(np.int64)
    return out


def unit_ends(tokenizer: str) -> np.ndarray:
    """Whether an id ends a unit, by id; what stands before a text, and the end id, do."""
    out = np.zeros(1 << 16, dtype=bool)
    for token, i in word_ids(tokenizer).tokenizer.get_vocab().items():
        out[i] = token.endswith("</w>")
    out[[END_ID, START, NONE]] = True
    return out


def contexts(ids: list[np.ndarray], ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first entry of each text, ids with ends, ids before, contexts) of texts; a context is two ids of 16 bits."""
    size = np.array([len(i) + 1 for i in ids], dtype=np.int64)
    first = np.cumsum(size) - size
    end = np.array([END_ID], dtype=np.int64)
    after = np.concatenate([x for i in ids for x in (i, end)])
    one = np.r_[START, after[:-1]]
    one[first] = START
    two = np.r_[NONE, one[:-1]]
    two[ends[one] | ends[two]] = NONE  # a text's first id has START before it, which ends a unit
    return first, after, one, two << 16 | one


class Lookup:
    """One or two values by key (not negative) in a hash table that is read with arrays of keys; other keys have the defaults.

    A place holds its key and, beside it, the values, so that one read brings all.
    """

    def __init__(self, key: np.ndarray, values: list[np.ndarray], defaults: list[float]):
        bits = max(2 * len(key), 2).bit_length()
        self.shift, self.mask, self.n = np.uint64(64 - bits), (1 << bits) - 1, len(values)
        self.rows = np.full((1 << bits, 2), -1, dtype=np.int64)
        tables = [self.rows.view(np.float32)[:, 2 + i] for i in range(self.n)]
        for table, d in zip(tables, defaults):
            table[:] = d
        rest, slot = np.arange(len(key)), self._slot(key)
        while len(rest):
            free = self.rows[slot, 0] == -1
            _, one = np.unique(slot[free], return_index=True)  # one key takes a free place
            placed = np.flatnonzero(free)[one]
            self.rows[slot[placed], 0] = key[rest[placed]]
            for table, v in zip(tables, values):
                table[slot[placed]] = v[rest[placed]]
            left = np.ones(len(rest), dtype=bool)
            left[placed] = False
            rest, slot = rest[left], (slot[left] + 1) & self.mask

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def __call__(self, key: np.ndarray) -> list[np.ndarray]:
        slot = self._slot(key)
        got = self.rows.take(slot, 0)
        other = np.flatnonzero((got[:, 0] != key) & (got[:, 0] != -1))
        while len(other):
            slot[other] = (slot[other] + 1) & self.mask
            next_ = self.rows.take(slot[other], 0)
            got[other] = next_
            other = other[(next_[:, 0] != key[other]) & (next_[:, 0] != -1)]
        return [got.view(np.float32)[:, 2 + i].copy() for i in range(self.n)]


class Contexts:
    """What contexts give to an id, and what they leave to the attention.

    key, n: pairs ``context << 16 | id`` and counts. context, total, kinds: of the contexts among them, the sum of all
    their counts and the number of their pairs, those not in key included. others: pairs not in key are looked up
    apart; else what they weigh is left to the attention.
    """

    def __init__(self, key: np.ndarray, n: np.ndarray, context: np.ndarray, total: np.ndarray, kinds: np.ndarray,
                 others: bool = False):
        order = np.argsort(context)
        context, total, kinds = context[order], total[order], kinds[order]
        at = np.searchsorted(context, key >> 16)
        held = np.bincount(at, weights=n, minlength=len(context))
        weight = total + kinds
        rest = (kinds if others else weight - held) / np.maximum(weight, 1)
        self.pair = Lookup(key, [n / weight[at], rest[at]], [0, -1])
        self.context = Lookup(context, [rest], [1])

    def mix(self, context: np.ndarray, ids: np.ndarray, begins: np.ndarray, p: np.ndarray) -> np.ndarray:
        """Probabilities of ids from those of the attention; at the beginning of a unit the mean of both."""
        return self.mix_apart(context, ids, begins, p)[0]

    def mix_apart(self, context: np.ndarray, ids: np.ndarray, begins: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(probabilities, places of the pairs that are not in key, what their contexts leave) of ids.

        A context that is held leaves less than 1, as it
        was seen; the others leave 1.
        """
        own, rest = self.pair((context << 16) | ids)
        new = np.flatnonzero(rest < 0)
        left = self.context(context[new])[0]
        rest[new] = left
        mixed = own + rest * p
        return np.where(begins, (mixed + p) / 2, mixed), new, left


class Model:
    """Classes, their frequencies, the attention's weights and the contexts.

    after: counts of (fine class, id) as a sorted array of ``fine * IDS + id`` and its values. held: Contexts, or None.
    """

    def __init__(self, counts: np.ndarray, after: tuple[np.ndarray, np.ndarray] | None = None, weights: dict | None = None,
                 held: Contexts | None = None, ends: np.ndarray | None = None):
        self.held = held
        self.ends = np.ones(1 << 16, dtype=bool) if ends is None else ends
        self.cls, self.fine = classes(counts, CLASSES), classes(counts, FINE)
        weight = counts + 1.0
        of_class = np.bincount(self.cls, weights=weight, minlength=CLASSES)
        share = weight / of_class[self.cls]
        key, n = after if after is not None else (np.zeros(0, dtype=np.int64), np.zeros(0))
        pairs = np.bincount(key // IDS * CLASSES + self.cls[key % IDS], weights=n, minlength=(FINE + 1) * CLASSES).reshape(FINE + 1, CLASSES)
        prior = (of_class / of_class.sum())[None, :]
        self.log_pair = np.log((pairs + 20 * prior) / (pairs.sum(1, keepdims=True) + 20)).astype(np.float32)
        # Shares after a fine class: of the ids that occur, and of all others together by one factor for a class.
        self.column = np.zeros(IDS, dtype=np.int64)
        used = np.flatnonzero(counts)
        self.column[used] = np.arange(1, len(used) + 1)
        self.log_rest = np.log(share)
        few = np.log(20 / (pairs + 20))  # what a class keeps for ids that did not follow, in proportion to share
        table = np.zeros((FINE + 1, len(used) + 1), dtype=np.float32)
        table[:, 1:] = self.log_rest[used] + few[:, self.cls[used]]
        f, i = key // IDS, key % IDS
        table[f, self.column[i]] = np.log((n + 20 * share[i]) / (pairs[f, self.cls[i]] + 20))
        self.table, self.few = table, few
        self.p = weights or start_weights()

    def log_share(self, fine: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Log probabilities of ids in their classes, after fine classes."""
        col = self.column[ids]
        out = self.table[fine, col].astype(np.float64)
        new = np.flatnonzero(col == 0)
        out[new] = self.log_rest[ids[new]] + self.few[fine[new], self.cls[ids[new]]]
        return out


def window_starts(n: int) -> np.ndarray:
    """First inputs of the windows over n inputs; each but the first scores from OVERLAP on."""
    return np.arange(0, max(n - OVERLAP, 1), WIDTH - OVERLAP)


def windows(m, ids: list[np.ndarray], pick=None):
    """(fine classes before, coarse classes, scored, text) of texts' windows, padded; text has one entry a window.

    pick, from a text's place and its number of windows, says which ones are taken. A text's inputs are its beginning and its ids, its targets the ids and the end.
    """
    size = np.array([len(i) for i in ids], dtype=np.int64) + 1
    starts = [window_starts(n) for n in size.tolist()]
    if pick is not None:
        starts = [s[pick(i, len(s))] for i, s in enumerate(starts)]
    text = np.repeat(np.arange(len(ids)), [len(s) for s in starts])
    base = np.cumsum(size) - size
    first = np.concatenate(starts)
    at = first[:, None] + np.arange(WIDTH)
    real = at < size[text][:, None]
    place = np.where(real, at + base[text][:, None], 0)
    whole = np.empty(int(size.sum()) + 1, dtype=np.int64)  # each text's ids with END_ID before and behind
    whole[0] = END_ID
    for b, i in zip(base.tolist(), ids):
        whole[b + 1:b + 1 + len(i)] = i
        whole[b + 1 + len(i)] = END_ID
    x = m.fine[whole[place]]
    x[first == 0, 0] = FINE
    scored = real & ((np.arange(WIDTH) >= OVERLAP) | (first == 0)[:, None])
    return x, m.cls[whole[place + 1]], scored, text


CLIP = np.float32(30)  # exponents are clipped here, which stands in for subtracting a maximum
_BOUND = np.where(np.tri(WIDTH, dtype=bool), CLIP, np.float32(-np.inf))  # of exponents by place: none for what is later
_ONES = np.ones(max(WIDTH, CLASSES), dtype=np.float32)  # a product with ones sums faster than sum() over short rows
PART = 32  # windows at once whose arrays stay in a core's cache
_ROWS = np.arange(0, PART * WIDTH * CLASSES, CLASSES)  # where the exponents of a place begin


def _parts(scored: np.ndarray):
    """(rows, first place that is asked for) of some windows: those that begin a text are asked from the beginning, the others from OVERLAP on."""
    late = ~scored[:, 0]
    for rows, lo in ((np.flatnonzero(late), OVERLAP), (np.flatnonzero(~late), 0)):
        for a in range(0, len(rows), PART):
            yield rows[a:a + PART], lo


def _attend(p: dict, xs: np.ndarray, lo: int):
    """(embeddings, what asks, its products with "qk", embeddings by place, weights of the attention, their sums, mixed embeddings) of windows' inputs.

    Neither the weights nor the mixed embeddings are divided by the sums.
    """
    e = p["emb"].take(xs, 0)
    e += p["pos"]
    asking = np.ascontiguousarray(e[:, lo:])
    f = (asking.reshape(-1, DIM) @ p["qk"]).reshape(asking.shape)
    across = np.ascontiguousarray(e.transpose(0, 2, 1))
    s = f @ across
    np.minimum(s, _BOUND[lo:], out=s)
    np.exp(s, out=s)
    total = s @ _ONES[:WIDTH]
    total += np.float32(1e-30)
    return e, asking, f, across, s, total, s @ e


def _exp_clipped(z: np.ndarray):
    """z becomes its exponential; the pass that clips is for arrays that need it."""
    if not z.max() <= CLIP:
        np.minimum(z, CLIP, out=z)
    np.exp(z, out=z)


def _logits(p: dict, log_pair: np.ndarray, ms: np.ndarray, asking: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(output of the layer, exponents of the classes) of places with their mixed embeddings."""
    hs = ms @ p["vo"]
    hs += asking
    z = hs @ p["out"]
    z += log_pair.take(x, 0)
    return hs, z


def log_probs(m: Model, x: np.ndarray, y: np.ndarray, scored: np.ndarray) -> np.ndarray:
    """Natural-log probabilities of the scored targets' classes, in order."""
    own, total = (np.ones((len(x), WIDTH), dtype=np.float32) for _ in range(2))
    for rows, lo in _parts(scored):
        xs = x[rows]
        _, asking, *_, sums, mixed = _attend(m.p, xs, lo)
        mixed /= sums[..., None]
        _, z = _logits(m.p, m.log_pair, mixed.reshape(-1, DIM), asking.reshape(-1, DIM), xs[:, lo:].ravel())
        own[rows, lo:] = z.ravel().take(_ROWS[:len(z)] + y[rows, lo:].ravel()).reshape(len(rows), -1)
        _exp_clipped(z)
        total[rows, lo:] = (z @ _ONES[:CLASSES]).reshape(len(rows), -1)
    return np.minimum(own[scored], CLIP).astype(np.float64) - np.log(total[scored].astype(np.float64))


def gradient(m: Model, x: np.ndarray, y: np.ndarray, scored: np.ndarray) -> tuple[dict, float]:
    """Gradient of the mean loss over the scored targets, and that loss."""
    p, n, loss = m.p, int(scored.sum()), 0.0
    g = {k: np.zeros_like(v) for k, v in p.items()}
    two = lambda a: a.reshape(-1, a.shape[-1])
    qk, vo, out = (np.ascontiguousarray(p[k].T) for k in ("qk", "vo", "out"))
    by_input, inputs, done = np.empty((len(x), WIDTH, DIM), dtype=np.float32), np.empty((len(x), WIDTH), dtype=np.int16), 0
    for rows, lo in _parts(scored):
        xs, asked = x[rows], scored[rows, lo:].ravel()
        e, asking, f, across, s, sums, mixed = _attend(p, xs, lo)
        wide_of = lambda v: np.repeat(v, DIM).reshape(-1, DIM)  # noqa: E731, a product of equal shapes is faster than one of columns
        ms, share = two(mixed), wide_of(1 / sums)
        ms *= share
        hs, z = _logits(p, m.log_pair, ms, two(asking), xs[:, lo:].ravel())
        own = _ROWS[:len(z)] + y[rows, lo:].ravel()
        of_own = np.minimum(z.ravel().take(own), CLIP).astype(np.float64)
        _exp_clipped(z)
        total = z @ _ONES[:CLASSES]
        loss += float(((np.log(total.astype(np.float64)) - of_own) * asked).sum())
        z.ravel()[own] -= total
        part = wide_of(asked / total)  # what is not scored has no part
        dh = z @ out
        dh *= part
        hs *= part
        g["out"] += hs.T @ z
        g["vo"] += ms.T @ dh
        dm = dh @ vo
        dm *= share
        dm = dm.reshape(mixed.shape)
        ds = dm @ across
        ds -= np.einsum("bid,bid->bi", dm, mixed)[..., None]  # the sum of ds * s over a row, where s is divided by its sum
        ds *= s
        df = two(ds @ e)
        de = by_input[done:done + len(rows)]
        np.matmul(s.transpose(0, 2, 1), dm, out=de)
        de += ds.transpose(0, 2, 1) @ f
        da = df @ qk
        da += dh
        de[:, lo:] += da.reshape(asking.shape)
        g["qk"] += two(asking).T @ df
        g["pos"] += de.sum(0)
        inputs[done:done + len(rows)] = xs
        done += len(rows)
    if done:
        order = np.argsort(inputs.ravel(), kind="stable")
        cls = inputs.ravel()[order]
        start = np.flatnonzero(np.diff(cls, prepend=-1))
        g["emb"][cls[start]] += np.add.reduceat(two(by_input)[order], start, axis=0)
    for k in g:
        g[k] /= np.float32(max(n, 1))
    return g, loss / max(n, 1)


class Adam:
    def __init__(self, p: dict):
        self.m = {k: np.zeros_like(v) for k, v in p.items()}
        self.v = {k: np.zeros_like(v) for k, v in p.items()}
        self.t = 0

    def step(self, p: dict, g: dict, rate: float):
        self.t += 1
        for k in p:
            self.m[k] += 0.1 * (g[k] - self.m[k])
            self.v[k] += 0.01 * (g[k] ** 2 - self.v[k])
            p[k] -= rate * (self.m[k] / (1 - 0.9 ** self.t)) / (np.sqrt(self.v[k] / (1 - 0.99 ** self.t)) + 1e-8)


def rounds(key: int, n: int) -> np.ndarray:
    """The training round of each of a text's n windows, by a hash of the text's key and the window's number."""
    z = np.arange(n, dtype=np.uint64) + np.uint64(key & 0xFFFFFFFFFFFFFFFF)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        z = (z ^ (z >> np.uint64(shift))) * np.uint64(factor)
    return (z ^ (z >> np.uint64(31))) % np.uint64(ROUNDS)


def train(m: Model, adam: Adam, ids: list[np.ndarray], keys: list[int], r: int) -> int:
    """Steps of the model's weights on the windows of round r; gives the number of targets."""
    seen = 0
    for lo, hi in _slices(ids):
        x, y, scored, _ = windows(m, ids[lo:hi], pick=lambda i, n: rounds(keys[lo + i], n) == r)
        for a in range(0, len(x), BATCH):
            g, _ = gradient(m, x[a:a + BATCH], y[a:a + BATCH], scored[a:a + BATCH])
            adam.step(m.p, g, RATE / (1 + r) / np.sqrt(1 + adam.t / 50))
            seen += int(scored[a:a + BATCH].sum())
    return seen


def _prepared(docs: DataFrame, tokenizer: str) -> tuple[DataFrame, DataFrame]:
    """(doc_id, h, held_out, ids) in the shared folder, ids as 16-bit numbers; and the same rows with texts.

    h is a hash of the text: rows with equal id and h have equal scores, so the two are joined on these, and no number
    of a row need stay the same when it is read again.
    """
    import pyarrow as pa

    held = F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(7)) == 2
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col("text").cast("string")).alias("h"),
                       held.alias("held_out"), F.col("text").cast("string").alias("text"))

    def run(batches):
        ids = word_ids(tokenizer)
        for b in batches:
            packed = pa.array([ids.encode(t).astype("<u2").tobytes() for t in b.column(3).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([*b.columns[:3], packed], ["doc_id", "h", "held_out", "ids"])

    return stored(rows.mapInArrow(run, "doc_id long, h long, held_out boolean, ids binary"), "ids"), rows


def _sums(ids: DataFrame, run) -> tuple[np.ndarray, np.ndarray]:
    """Sums by whole-number key of the rows (key, value) that run makes of training rows (hash of the text's id and h, ids).

    Keys are bounded in number.
    """
    rows = ids.where("not held_out").select(F.xxhash64("doc_id", "h"), "ids").mapInArrow(run, "key long, value double")
    t = rows.groupBy("key").agg(F.sum("value").alias("value")).toArrow()
    return t.column("key").to_numpy(), t.column("value").to_numpy()


def _summed(ids: DataFrame, run, n: int) -> np.ndarray:
    out = np.zeros(n)
    key, value = _sums(ids, run)
    out[key] = value
    return out


def _rows(key: np.ndarray, value: np.ndarray):
    import pyarrow as pa

    return pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(value, pa.float64())], ["key", "value"])


def _emit(x: np.ndarray):
    key = np.flatnonzero(x)
    return _rows(key, x[key])


def _ids(b):
    return [np.frombuffer(i, "<u2") for i in b.column(b.num_columns - 1).to_pylist()]


def _merged(runs: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted keys and their sums, of sorted runs of keys and counts."""
    key = np.concatenate([k for k, _ in runs])
    order = np.argsort(key, kind="stable")
    key = key[order]
    fresh = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    return key[fresh], np.add.reduceat(np.concatenate([n for _, n in runs])[order], fresh)


def pair_counts(batches, ends: np.ndarray):
    """Batches (key, n) of the pairs ``context << 16 | id`` of batches of ids.

    Ids are laid out in parts, and sums are handed on when they fill PAIR_ROWS, in small batches, so a task's memory is
    bounded by neither its rows nor the batches that come in.
    """
    import pyarrow as pa

    def rows(key, n):
        for a in range(0, len(key), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(key[a:a + (1 << 16)]), pa.array(n[a:a + (1 << 16)])], ["key", "n"])

    forget()
    runs, size = [], 0
    for b in batches:
        ids = _ids(b)
        for lo, hi in _slices(ids, PAIR_IDS):
            _, after, _, context = contexts(ids[lo:hi], ends)
            runs.append(np.unique(context << 16 | after, return_counts=True))
            size += len(runs[-1][0])
            if size > PAIR_ROWS + PAIR_IDS:
                runs = [_merged(runs)]
                size = len(runs[0][0])
                if size > PAIR_ROWS:
                    yield from rows(*runs[0])
                    runs, size = [], 0
    if runs:
        yield from rows(*_merged(runs))


def _least(sized: DataFrame) -> int:
    """The least power of two of a count among the pairs that are held: all above it fit in ENTRIES."""
    least, room = 64, ENTRIES
    for r in sized.groupBy("bits").agg(F.count("*").alias("v")).orderBy(F.desc("bits")).collect():
        if r["v"] > room:
            break
        room -= r["v"]
        least = r["bits"]
    return least


def _sized(counted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pairs (key, n) with the length of the count, and their contexts (context, total, kinds, most)."""
    sized = counted.withColumn("bits", F.length(F.bin("n"))).withColumn("context", F.shiftright("key", 16))
    return sized, sized.groupBy("context").agg(F.sum("n").alias("total"), F.count("*").alias("kinds"), F.max("bits").alias("most"))


def _held(counted: DataFrame, others: bool = False) -> Contexts:
    """The contexts of the most frequent pairs among counted (key, n), by powers of two of the count."""
    sized, of = _sized(counted)
    least = _least(sized)
    pairs = sized.where(F.col("bits") >= least).select("key", "n").toArrow()
    of = of.where(F.col("most") >= least).drop("most").toArrow()
    return Contexts(*(t.column(c).to_numpy() for t in (pairs, of) for c in t.column_names), others=others)


def _others(counted: DataFrame) -> tuple[DataFrame, DataFrame] | None:
    """What _held leaves out: pairs (key, own, rest) and contexts (context, left); None where it holds all."""
    sized, of = _sized(counted)
    least = _least(sized)
    rare = sized.where(F.col("bits") < least)
    if rare.isEmpty():
        return None
    single = lambda c: c.cast("float").cast("double")  # noqa: E731, as Lookup keeps it
    left = single(F.col("kinds") / (F.col("total") + F.col("kinds")))
    pairs = rare.join(of, "context").select("key", single(F.col("n") / (F.col("total") + F.col("kinds"))).alias("own"), left.alias("rest"))
    return stored(pairs, "rare_pairs"), stored(of.where(F.col("most") < least).select("context", left.alias("left")), "rare_contexts")


def fit(ids: DataFrame, ends: np.ndarray) -> tuple[Model, tuple[DataFrame, DataFrame] | None]:
    """The model of the training rows of ids (from _prepared), and the counts it does not hold; ends is from unit_ends."""
    sc = ids.sparkSession.sparkContext

    def count_pairs(batches):
        return pair_counts(batches, ends)

    counted = stored(ids.where("not held_out").select("ids").mapInArrow(count_pairs, "key long, n long").groupBy("key").agg(
        F.sum("n").alias("n")), "contexts")

    # An id, the end as well, is counted as often as it follows something.
    t = counted.groupBy(F.col("key").bitwiseAND(F.lit(0xFFFF)).alias("id")).agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(IDS)
    counts[t.column("id").to_numpy()] = t.column("n").to_numpy()
    shared = sc.broadcast(classes(counts, FINE))

    def by_class(batches):
        for b in batches:
            key = b.column(0).to_numpy()
            before = key >> 16 & 0xFFFF
            yield _rows((np.where(before == START, FINE, shared.value[np.minimum(before, IDS - 1)]) * IDS + (key & 0xFFFF)),
                        b.column(1).to_numpy().astype(np.float64))

    # At most (FINE + 1) * IDS keys, and far fewer that occur.
    t = counted.mapInArrow(by_class, "key long, value double").groupBy("key").agg(F.sum("value").alias("value")).toArrow()
    sums = t.column("key").to_numpy(), t.column("value").to_numpy()
    order = np.argsort(sums[0])
    after = sums[0][order], sums[1][order]
    weights = start_weights()
    for r in range(ROUNDS):
        begun = sc.broadcast(Model(counts, after, weights))

        def steps(batches, r=r, begun=begun):
            model = copy.copy(begun.value)
            model.p = {k: v.copy() for k, v in model.p.items()}  # a worker's later tasks begin from the same weights
            adam, seen = Adam(model.p), 0
            for b in batches:
                seen += train(model, adam, _ids(b), b.column(0).to_pylist(), r)
            if seen:
                yield _emit(np.r_[flat(model.p) * seen, seen])

        size = len(flat(weights))
        total = _summed(ids, steps, size + 1)
        begun.destroy()  # executors need no more than one round's model
        if total[-1]:
            weights = shaped(total[:-1] / total[-1])
    others = _others(counted)
    return Model(counts, after, weights, _held(counted, others is not None), ends), others


def _slices(ids: list[np.ndarray], most: int = CHUNK_IDS):
    """Ranges of whole texts with about so many ids."""
    a = total = 0
    for b, i in enumerate(ids, 1):
        total += len(i)
        if total > most or b == len(ids):
            yield a, b
            a, total = b, 0


def text_scores(m: Model, ids: list[np.ndarray], apart: list | None = None) -> np.ndarray:
    """log10 probability of each text: of its ids and the end. Some texts at a time, whole, to keep arrays small.

    apart takes (texts, keys, what the contexts leave, begins, probabilities of the attention) of ids whose pair is not
    held; these are left out of the sums.
    """
    out = [_scores(m, ids[a:b], apart, a) for a, b in _slices(ids)]
    return np.concatenate(out) if out else np.zeros(0)


def _scores(m: Model, ids: list[np.ndarray], apart: list | None = None, done: int = 0) -> np.ndarray:
    first, after, before, context = contexts(ids, m.ends)
    fine = m.fine[np.minimum(before, IDS - 1)]
    fine[first] = FINE
    x, y, scored, _ = windows(m, ids)
    lp = m.log_share(fine, after) + log_probs(m, x, y, scored)  # both in the order of the ids
    if m.held is not None:
        p, begins = np.exp(lp), m.ends[before]
        mixed, at, left = m.held.mix_apart(context, after, begins, p)
        lp = np.log(mixed)
        if apart is not None:
            apart.append((done + np.searchsorted(first, at, "right") - 1, context[at] << 16 | after[at], left.astype(np.float64), begins[at], p[at]))
            lp[at] = 0
    return np.add.reduceat(lp, first) / np.log(10)


def _words(text: str | None) -> list[bytes]:
    w = (text or "").encode().lower().split()
    w.append(END_WORD)
    return w


def word_counts(rows: DataFrame) -> DataFrame:
    """(word, c) over the training rows, summed in each task before they are dealt."""
    def run(batches):
        import pyarrow as pa

        def out(c):
            return pa.RecordBatch.from_arrays([pa.array(list(c), pa.binary()), pa.array(list(c.values()), pa.int64())], ["word", "c"])

        forget()
        c: Counter = Counter()
        for b in batches:
            for t in b.column(0).to_pylist():
                c.update(_words(t))
            if len(c) > 250_000:
                yield out(c)
                c = Counter()
        if c:
            yield out(c)

    return rows.where("not held_out").select("text").mapInArrow(run, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


def base_scores(rows: DataFrame) -> tuple[DataFrame, int]:
    """((doc_id, h, n_tokens, n_known, base_score), N) of rows (doc_id, h, held_out, text), one row for each id and h."""
    spark = rows.sparkSession
    counts = stored(word_counts(rows), "word_counts")
    by_size = counts.groupBy(F.length(F.bin("c")).alias("bits")).agg(F.count("*").alias("v"), F.sum("c").alias("n")).collect()
    distinct, total = sum(r["v"] for r in by_size), sum(r["n"] for r in by_size)
    # The most frequent words, by powers of two of their count, as far as FREQUENT goes.
    least, room = 64, FREQUENT
    for r in sorted(by_size, key=lambda r: -r["bits"]):
        if r["v"] > room:
            break
        room -= r["v"]
        least = r["bits"]
    common = {bytes(r[0]): math.log10(r[1] + 1) for r in counts.where(F.length(F.bin("c")) >= least).toLocalIterator()}
    shared = spark.sparkContext.broadcast(common)

    def run(batches):
        import pyarrow as pa

        forget()
        known = shared.value
        for b in batches:
            rid, word, times, value, n_tokens, ids, hashes = [], [], [], [], [], [], []
            for i, t, d, h in zip(*(c.to_pylist() for c in b.columns)):
                w = _words(t)
                logs = list(map(known.get, w))
                rare = Counter([x for x, v in zip(w, logs) if v is None] if None in logs else ())
                # The text's own row: a word that no other row has, so that it joins with nothing.
                rid.append(i)
                word.append(b"  %d" % i)
                times.append(len(w) - sum(rare.values()))
                value.append(float(sum(filter(None, logs))))
                n_tokens.append(len(w))
                ids += [d] + [None] * len(rare)
                hashes += [h] + [None] * len(rare)
                rid += [i] * len(rare)
                word += rare.keys()
                times += rare.values()
                value += [0.0] * len(rare)
                n_tokens += [0] * len(rare)
            yield pa.RecordBatch.from_arrays([pa.array(rid, pa.int64()), pa.array(word, pa.binary()), pa.array(times, pa.int64()),
                                              pa.array(value, pa.float64()), pa.array(n_tokens, pa.int64()),
                                              pa.array(ids, pa.int64()), pa.array(hashes, pa.int64())],
                                             ["rid", "word", "times", "value", "n", "doc_id", "h"])

    # Rows are told apart by a number that lasts for this one pass.
    numbered = rows.select(F.monotonically_increasing_id().alias("rid"), "text", "doc_id", "h")
    parts = numbered.mapInArrow(run, "rid long, word binary, times long, value double, n long, doc_id long, h long")
    others = counts.where(F.length(F.bin("c")) < least)
    # Distinct words deal out evenly, so a task's share of them is small enough for a hash table; nothing is sorted.
    joined = parts.join(others.hint("shuffle_hash"), "word", "left")
    own = F.col("n") > 0
    out = joined.groupBy("rid").agg(
        F.max("doc_id").alias("doc_id"), F.max("h").alias("h"),
        F.sum("n").alias("n_tokens"),
        F.sum(F.when(own | F.col("c").isNotNull(), F.col("times")).otherwise(0)).alias("n_known"),
        F.sum(F.when(own, F.col("value")).when(F.col("c").isNotNull(), F.col("times") * F.log10(F.col("c") + 1.0)).otherwise(0.0)).alias("known"))
    score = F.col("known") - F.col("n_tokens") * float(np.log10(total + distinct + 1.0))
    return out.select("doc_id", "h", "n_tokens", "n_known", score.alias("base_score")).dropDuplicates(["doc_id", "h"]), int(total)


def _joined_scores(ids: DataFrame, shared, pairs: DataFrame, left: DataFrame) -> DataFrame:
    """(doc_id, h, held_out, score) of rows of ids: the sums of what tasks know, and the ids whose counts are joined."""
    def run(batches):
        import pyarrow as pa

        for b in batches:
            if not b.num_rows:
                continue
            apart: list = []
            rid = b.column(0).to_numpy()
            sums = text_scores(shared.value, _ids(b), apart)
            text, key, rest, begins, p = (np.concatenate(x) for x in zip(*apart))
            none = pa.nulls(len(text), pa.int64())
            # The text's own row: keys that nothing else has, so that it joins with nothing.
            own = [b.column(0), pa.array(-1 - rid), pa.array(-1 - rid), pa.array(sums), pa.nulls(len(rid), pa.float64()),
                   pa.nulls(len(rid), pa.bool_()), pa.nulls(len(rid), pa.float64()), *b.columns[1:4]]
            of = [pa.array(rid[text]), pa.array(key), pa.array(key >> 16), pa.nulls(len(text), pa.float64()), pa.array(rest),
                  pa.array(begins), pa.array(p), none, none, pa.nulls(len(text), pa.bool_())]
            names = ["rid", "key", "context", "sums", "known", "begins", "p", "doc_id", "h", "held_out"]
            yield pa.RecordBatch.from_arrays(own, names)
            yield pa.RecordBatch.from_arrays(of, names)

    # Rows are told apart by a number that lasts for this one pass.
    numbered = ids.select(F.monotonically_increasing_id().alias("rid"), "doc_id", "h", "held_out", "ids")
    parts = numbered.mapInArrow(run, "rid long, key long, context long, sums double, known double, begins boolean, p double, "
                                     "doc_id long, h long, held_out boolean")
    joined = parts.join(pairs.hint("shuffle_hash"), "key", "left").join(left.hint("shuffle_hash"), "context", "left")
    p = F.col("p")
    mixed = F.coalesce(F.col("own"), F.lit(0.0)) + F.coalesce(F.col("rest"), F.col("left"), F.col("known")) * p
    each = F.coalesce(F.col("sums"), F.log10(F.when(F.col("begins"), (mixed + p) / 2).otherwise(mixed)))
    return joined.groupBy("rid").agg(*(F.max(c).alias(c) for c in ("doc_id", "h", "held_out")), F.sum(each).alias("score")).drop("rid")


def scores(docs: DataFrame, tokenizer: str) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row of docs."""
    workers_ready(docs.sparkSession)
    ids, rows = _prepared(docs, tokenizer)
    base, total = base_scores(rows)
    model, others = fit(ids, unit_ends(tokenizer))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        import pyarrow as pa

        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(text_scores(shared.value, _ids(b)), pa.float64())],
                                             ["doc_id", "h", "held_out", "score"])

    if others is None:
        scored = ids.mapInArrow(run, "doc_id long, h long, held_out boolean, score double")
    else:
        scored = _joined_scores(ids, shared, *others)
    base = base.withColumnsRenamed({"doc_id": "_id", "h": "_h"})
    return scored.join(base, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("h") == F.col("_h"))).select("doc_id", "held_out", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"),
                                           "base_score", "score")
