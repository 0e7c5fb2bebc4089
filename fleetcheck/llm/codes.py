"""Vector codes: one small codebook for each of consecutive parts of a vector, learnt and assigned with norm-of-sum bounds.

Components become integers. Each round assigns every part to its codebook's nearest entry and replaces the entries by
the floored means of their parts. The rows keep, for each part, its entry, an exact squared distance to it and one to
the nearest other entry, each with the round in which it was taken. All codebooks so far are kept, so a later round
bounds these distances by the norm of an entry's net displacement since that round (the norm of the sum of its moves,
never more than the sum of their norms): the own entry is at most its own displacement farther, any other entry at
most the largest displacement among the others nearer. Where that leaves the order open, the distance to the own
entry is taken anew, and only if that does not settle it, all entries are scanned. Bounds carry a margin for rounding
and must hold strictly, so codes, ties included, are those of scanning every entry in every round.

Spark holds the vectors with their state in the shared folder, one table a round; tasks emit the sums of their parts
by entry, and the driver sees codebooks only (entries times components, whatever the input).

Defined results: rows whose vector is null or holds a null or non-finite component go; shorter vectors are filled with
zeros up to the longest, and that to a multiple of ``parts``; the first codebook is taken from the rows in order of
id (nulls last) and vector, fewer rows than ``entries`` give as many entries; ties go to the lower index; repeated
rows count each; scaled components beyond 2**60 are held as 2**60 with their sign, and squared distances and errors
beyond the largest long as that, so that such distances tie; an empty table gives an empty one; other columns are not read.
"""

from __future__ import annotations

import hashlib
from decimal import Decimal

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored, workers_ready

LIMIT = 1 << 60
NARROW = 1 << 27  # components up to this are added and squared in 64 bits
LARGEST = (1 << 63) - 1
HOT = 1000  # labels with over one row in so many are joined by broadcast: fewer than this many labels


def scaled(flat: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) of finite doubles."""
    return np.clip(np.floor(flat * float(scale)), -float(LIMIT), float(LIMIT)).astype(np.int64)


def squares(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of each row of x to each row of c."""
    top = max(int(np.abs(x).max(initial=0)), int(np.abs(c).max(initial=0)))
    if 4 * top * top * max(x.shape[1], 1) < 1 << 53:  # every term is an integer that a double holds
        a, b = x.astype(np.float64), c.astype(np.float64)
        return ((a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)).astype(np.int64)
    kind = np.int64 if 4 * top * top * x.shape[1] < 1 << 63 else object
    d = x.astype(kind)[:, None, :] - c.astype(kind)[None, :, :]
    return _long((d * d).sum(2))


def own_squares(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows of x to the rows of c."""
    top = max(int(np.abs(x).max(initial=0)), int(np.abs(c).max(initial=0)))
    kind = np.int64 if 4 * top * top * max(x.shape[1], 1) < 1 << 63 else object
    d = x.astype(kind) - c.astype(kind)
    return _long((d * d).sum(1))


def _long(d: np.ndarray) -> np.ndarray:
    return d if d.dtype == np.int64 else np.minimum(d, LARGEST).astype(np.int64)


def scan(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(nearest entry, its squared distance, that of the nearest other entry) of each row of x."""
    d = squares(x, c)
    own, rows = d.argmin(1), np.arange(len(x))
    first = d[rows, own]
    d[rows, own] = LARGEST
    return own, first, d.min(1)


class Moves:
    """Net displacements of a part's entries from the codebook of each earlier round to the last one."""

    def __init__(self, history: list[np.ndarray]):
        now = history[-1].astype(np.float64)
        self.own = np.stack([np.sqrt(((now - c.astype(np.float64)) ** 2).sum(1)) for c in history])  # by round and entry
        k = len(now)
        order = np.argsort(self.own, axis=1)
        top = np.take_along_axis(self.own, order[:, -1:], 1)
        under = np.take_along_axis(self.own, order[:, -2:-1], 1) if k > 1 else np.zeros_like(top)
        self.others = np.where(np.arange(k)[None, :] == order[:, -1:], under, top)  # the largest among the other entries

    def settled(self, own, first, first_round, second, second_round) -> np.ndarray:
        """Whether the own entry is surely nearer than every other one."""
        near, far = np.sqrt(first.astype(np.float64)), np.sqrt(second.astype(np.float64))
        up, down = self.own[first_round, own], self.others[second_round, own]
        return near + up + 1e-9 * (near + up + far + down) < far - down


class State:
    """Arrays by row and part: entry, squared distances to it and to the nearest other one, and the rounds of the two."""

    NAMES = ("own", "first", "first_round", "second", "second_round")

    def __init__(self, n: int, parts: int):
        for name in self.NAMES:
            setattr(self, name, np.zeros((n, parts), dtype=np.int64))


def begin(x: np.ndarray, book: np.ndarray) -> State:
    """State of vectors x (rows, parts, components) by a scan of every entry of the first codebook."""
    s = State(x.shape[0], x.shape[1])
    for p in range(x.shape[1]):
        s.own[:, p], s.first[:, p], s.second[:, p] = scan(x[:, p], book[p])
    return s


def advance(x: np.ndarray, s: State, history: list[np.ndarray], exact: bool = False) -> int:
    """Bring s to the last codebook of history; exact: first is of that codebook everywhere. Returns the number of scans."""
    now, scans = len(history) - 1, 0
    for p in range(x.shape[1]):
        moves, book = Moves([h[p] for h in history]), history[-1][p]
        state = [getattr(s, name)[:, p] for name in State.NAMES]  # views
        own, first, first_round, second, second_round = state
        anew = np.flatnonzero(~moves.settled(*state) | exact)
        first[anew] = own_squares(x[anew, p], book[own[anew]])
        first_round[anew] = now
        open_ = anew[~moves.settled(*(a[anew] for a in state))]
        if len(open_):
            own[open_], first[open_], second[open_] = scan(x[open_, p], book)
            first_round[open_] = second_round[open_] = now
            scans += len(open_)
    return scans


def _lists(a: np.ndarray, kind):
    """Rows of a as an Arrow list column."""
    import pyarrow as pa

    return pa.ListArray.from_arrays(pa.array(np.arange(a.shape[0] + 1) * a.shape[1], pa.int32()), pa.array(a.ravel(), kind))


def _rows(column, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), width)


def _kinds():
    import pyarrow as pa

    return {"own": ("int", pa.int32()), "first": ("long", pa.int64()), "first_round": ("int", pa.int32()),
            "second": ("long", pa.int64()), "second_round": ("int", pa.int32())}


def _read(batch, parts: int, width: int) -> tuple[np.ndarray, State]:
    x = _rows(batch.column("x"), width).reshape(batch.num_rows, parts, width // parts)
    s = State(0, parts)
    for name in State.NAMES:
        setattr(s, name, _rows(batch.column(name), parts).astype(np.int64))
    return x, s


def _batch(vec_id, label, x: np.ndarray, s: State):
    import pyarrow as pa

    columns = [vec_id, label, _lists(x.reshape(len(x), -1), pa.int64())]
    columns += [_lists(getattr(s, name), kind) for name, (_, kind) in _kinds().items()]
    return pa.RecordBatch.from_arrays(columns, ["vec_id", "label", "x", *State.NAMES])


def first_codebook(rows: DataFrame, parts: int, entries: int, width: int, scale: int) -> np.ndarray:
    """(parts, entries, components) of the first rows in order of id; at most ``entries`` rows come to the driver."""
    least = rows.orderBy(F.col("vec_id").asc_nulls_last(), "vector").limit(entries).collect()
    x = np.zeros((len(least), width), dtype=np.int64)
    for i, r in enumerate(least):
        x[i, :len(r["vector"])] = scaled(np.array(r["vector"], dtype=np.float64), scale)
    return np.ascontiguousarray(x.reshape(len(least), parts, width // parts).transpose(1, 0, 2))


def next_codebook(state: DataFrame, book: np.ndarray) -> np.ndarray:
    """The floored means of the parts of each entry; an entry without parts stays."""
    import pyarrow as pa

    parts, entries, size = book.shape

    def sums(batches):
        n, total = np.zeros((parts, entries), dtype=np.int64), np.zeros((parts, entries, size), dtype=np.int64)
        for b in batches:
            x, s = _read(b, parts, parts * size)
            if total.dtype != object and np.abs(x).max(initial=0) > NARROW:
                total = total.astype(object)
            for p in range(parts):
                n[p] += np.bincount(s.own[:, p], minlength=entries)
                np.add.at(total[p], s.own[:, p], x[:, p].astype(total.dtype))
        p, e, i = (a.ravel() for a in np.indices(total.shape))
        used = n[p, e] > 0
        p, e, i = p[used], e[used], i[used]
        yield pa.RecordBatch.from_arrays([pa.array(p), pa.array(e), pa.array(i), pa.array(n[p, e]),
                                          pa.array([Decimal(int(v)) for v in total[p, e, i]], pa.decimal128(38, 0))],
                                         ["part", "entry", "place", "n", "total"])

    rows = state.mapInArrow(sums, "part long, entry long, place long, n long, total decimal(38,0)")
    out = book.copy()
    # entries x components rows at most
    for r in rows.groupBy("part", "entry", "place").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).collect():
        out[r["part"], r["entry"], r["place"]] = int(r["total"]) // r["n"]
    return out


def learn(vectors: DataFrame, parts: int = 16, entries: int = 64, rounds: int = 2, scale: int = 256, id_col: str = "vec_id",
          vector: str = "embedding", label: str = "label") -> tuple[DataFrame, list[np.ndarray]]:
    """(table of vectors with their state at the last codebook, codebooks of all rounds); exact distances in ``first``."""
    import pyarrow as pa

    spark = vectors.sparkSession
    workers_ready(spark)
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label).alias("label"),
                          F.col(vector).cast("array<double>").alias("vector"))
    whole = F.forall("vector", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < F.lit(float("inf"))))
    rows = rows.where(F.col("vector").isNotNull() & whole)
    longest = rows.agg(F.max(F.size("vector")).alias("n")).first()["n"] or 0
    width = -(-longest // parts) * parts
    history = [first_codebook(rows, parts, entries, width, scale)]
    kind = dict(rows.dtypes)["label"]
    schema = f"vec_id long, label {kind}, x array<long>, " + ", ".join(f"{n} array<{k}>" for n, (k, _) in _kinds().items())

    def start(batches):
        for b in batches:
            column = b.column(2)
            size = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            flat = scaled(column.flatten().to_numpy(zero_copy_only=False), scale)
            x = np.zeros((len(size), width), dtype=np.int64)
            row = np.repeat(np.arange(len(size)), size)
            x[row, np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)] = flat
            x = x.reshape(len(size), parts, width // parts)
            yield _batch(b.column(0), b.column(1), x, begin(x, history[0]))

    def step(codebooks, last):
        def run(batches):
            for b in batches:
                x, s = _read(b, parts, width)
                advance(x, s, codebooks, exact=last)
                yield _batch(b.column("vec_id"), b.column("label"), x, s)
        return run

    state = stored(rows.mapInArrow(start, schema), "codes-0") if len(history[0][0]) else spark.createDataFrame([], schema)
    for r in range(1, rounds + 1 if len(history[0][0]) else 0):
        history.append(next_codebook(state, history[-1]))
        state = state.mapInArrow(step(list(history), r == rounds), schema)
        if r < rounds:
            state = stored(state, f"codes-{r}")
    return state, history


def digest(book: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, book.ravel().tolist())).encode()).hexdigest()


def codes(vectors: DataFrame, parts: int = 16, entries: int = 64, rounds: int = 2, scale: int = 256, id_col: str = "vec_id",
          vector: str = "embedding", label: str = "label") -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256) of each kept row; entries up to 256.

    Labels' sums go to the rows by a join: labels with more than one row in HOT (fewer than HOT labels) by broadcast,
    the others by shuffle.
    """
    state, history = learn(vectors, parts, entries, rounds, scale, id_col, vector, label)
    code = F.array_join(F.transform("own", lambda e: F.lower(F.lpad(F.hex(e.cast("long")), 2, "0"))), "")
    total = F.aggregate("first", F.lit(0).cast("decimal(38,0)"), lambda a, e: (a + e.cast("decimal(20,0)")).cast("decimal(38,0)"))
    out = stored(state.select("vec_id", "label", code.alias("code"), _held(total).alias("error")), "codes")
    sums = out.groupBy("label").agg(F.count("*").alias("n"), _held(F.sum(F.col("error").cast("decimal(19,0)"))).alias("label_error"))
    n = out.count()
    sums = sums.select(F.col("label").alias("_of"), "n", "label_error")
    hot = F.broadcast(sums.where(F.col("n") * HOT > n).drop("n"))
    same = F.col("label").eqNullSafe(F.col("_of"))
    rest = out.join(hot, same, "left_anti").join(sums.drop("n"), same)
    joined = out.join(hot, same).unionByName(rest)
    return joined.select("vec_id", "code", "error", "label_error", F.lit(digest(history[-1])).alias("codebooks_sha256"))


def _held(x):
    return F.least(x.cast("decimal(38,0)"), F.lit(Decimal(LARGEST)).cast("decimal(38,0)")).cast("long")


def sql(parts: int = 16, entries: int = 64, rounds: int = 2, scale: int = 256) -> str:
    """The query of codes() with these parameters, every part against every entry in every round."""
    ctes = [f"""kept AS (
  SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS r, vec_id, label,
    list_transform(embedding, lambda e: floor({scale} * e::DOUBLE)::BIGINT) AS x
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda e: coalesce(NOT isfinite(e), true))) = 0)""",
            f"width AS (SELECT CEIL(max(len(x)) / {parts}::DOUBLE)::BIGINT AS d FROM kept)",
            f"""long AS (
  SELECT r, n // d AS p, n % d AS i, coalesce(x[n + 1], 0) AS v
  FROM (SELECT r, x, d, unnest(range({parts} * d)) AS n FROM kept, width))""",
            f"book0 AS (SELECT p, r - 1 AS j, i, v FROM long WHERE r <= {entries})"]
    for t in range(rounds + 1):
        ctes.append(f"""far{t} AS (
  SELECT r, p, j, sum((a.v - b.v) * (a.v - b.v))::BIGINT AS d2 FROM long a JOIN book{t} b USING (p, i) GROUP BY r, p, j)""")
        ctes.append(f"""near{t} AS (
  SELECT r, p, least.j AS j, least.d2 AS d2
  FROM (SELECT r, p, min({{'d2': d2, 'j': j}}) AS least FROM far{t} GROUP BY r, p))""")
        if t < rounds:
            ctes.append(f"""book{t + 1} AS (
  SELECT p, j, i, coalesce((s - ((s % n + n) % n)) // n, b.v)::BIGINT AS v
  FROM book{t} b LEFT JOIN (SELECT p, j, i, sum(v) AS s, count(*) AS n FROM long JOIN near{t} USING (r, p) GROUP BY p, j, i) USING (p, j, i))""")
    return "WITH " + ",\n".join(ctes) + f"""
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
  (SELECT sha256(string_agg(v::VARCHAR, ',' ORDER BY p, j, i)) FROM book{rounds}) AS codebooks_sha256
FROM kept JOIN (SELECT r, string_agg(format('{{:02x}}', j), '' ORDER BY p) AS code, sum(d2)::BIGINT AS error FROM near{rounds} GROUP BY r) USING (r)"""


SQL = sql()
