"""Quality ranking, importance resampling and vector codes against brute-force versions, on awkward rows and given tables."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest

from fleetcheck.llm import codes, queries, ranking, resample

SF = "/root/testdata/sf0.001"
SF_LARGER = "/root/testdata/sf0.01"
rng = random.Random(5)
CLASH = "score double, rank long, weight long, key long, label string, x string, row long, part long, n long, own int"


def rows(df):
    return [tuple(r) for r in df.collect()]


# --- 12 resampling --------------------------------------------------------------------------------------------

def resample_expected(docs, target, percent=25, min_words=20, buckets=10_000):
    def bag(text):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        return w, [zlib.crc32(f.encode()) % buckets for f in w + [a + " " + b for a, b in zip(w, w[1:])]]

    raw, aim = collections.Counter(), collections.Counter()
    for _, t in docs:
        raw.update(bag(t)[1])
    for t in target:
        aim.update(bag(t)[1])
    s_all, t_all = sum(raw.values()), sum(aim.values())

    def gain(b):
        return math.floor(1000 * math.log((aim[b] + 1.0) * (s_all + buckets) / ((raw[b] + 1.0) * (t_all + buckets))))

    out = []
    for i, t in docs:
        w, f = bag(t)
        weight = sum(map(gain, f)) // len(f) if f else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append((i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(w)))
    order = sorted((r for r in out if r[4] >= min_words), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    drawn = percent * len(order) // 100
    return [r[:4] + (k + 1 if k < drawn else None,) for k, r in enumerate(order)] + [r[:4] + (None,) for r in out if r[4] < min_words]


def _texts():
    words = "alpha Beta GAMMA delta é漢 İx ß 1 22 q".split() + ["a\x00b", "c\x7fd", "e_f", "g~h", "'s"]
    out = [(1, None), (2, ""), (3, " \t\n!"), (None, "one two three " * 9), (None, "one two three " * 9), (7, "x " * 19), (8, "x " * 20),
           (9, " ".join(rng.choice(words) for _ in range(30_000)))]
    out += [(10 + i % 50, " ".join(rng.choice(words) for _ in range(rng.randint(0, 60)))) for i in range(120)]
    return out + [(500, "same text again and again " * 8)] * 90  # nearly half of the rows are one


TEXTS = _texts()


@pytest.mark.parametrize("percent", [25, 0, 100])
def test_resample_equals_brute_force(spark, percent):
    aim = ["alpha beta gamma", None, "", "Delta é漢, delta!", "same text"]
    docs = spark.createDataFrame([(i, t, 0.5, 1, 2, 3, "l", "x", 4, 5, 6, 7) for i, t in TEXTS], "doc_id long, text string, " + CLASH).repartition(5)
    target = spark.createDataFrame([(t,) for t in aim], "text string")
    got = rows(resample.resample(docs, target, percent=percent))
    key = lambda r: tuple((x is None, x or 0) for x in r)
    assert sorted(got, key=key) == sorted(resample_expected(TEXTS, aim, percent), key=key)


def test_resample_empty_tables(spark):
    none, some = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame(TEXTS[:9], "doc_id long, text string")
    assert rows(resample.resample(none, some)) == []
    assert sorted(r[2] for r in rows(resample.resample(some, none))) == sorted(r[2] for r in resample_expected(TEXTS[:9], []))


def test_longer_runs_continue_checksums():
    w = resample.words_of("One tw3 Öß four".encode())
    assert w == ["one".encode(), b"tw3", "Öß".encode(), b"four"]
    want = [b" ".join(w[i:i + k]) for k in (1, 2, 3) for i in range(len(w) - k + 1)]
    assert resample.features(w, 3) == [zlib.crc32(f) for f in want]


def test_resample_query(spark):
    docs = [(r[0], r[1]) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    aim = [r[0] for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("text").collect()]
    key = lambda r: r[0]
    assert sorted(rows(queries.op12_importance_resample(spark, SF)), key=key) == sorted(resample_expected(docs, aim), key=key)


# --- 13 codes -------------------------------------------------------------------------------------------------

def codes_expected(vectors, parts=16, entries=64, rounds=2, scale=256):
    """(vec_id, code, error, label_error, digest), every part against every entry in whole numbers of any size."""
    kept = [r for r in vectors if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])]
    kept.sort(key=lambda r: ((r[0] is None, r[0] or 0), r[1]))
    width = -(-max((len(r[1]) for r in kept), default=0) // parts) * parts
    d = width // parts
    held = [[max(-codes.LIMIT, min(codes.LIMIT, math.floor(x * scale))) for x in r[1]] + [0] * (width - len(r[1])) for r in kept]
    cut = [[x[p * d:(p + 1) * d] for p in range(parts)] for x in held]
    book = [[c[p] for c in cut[:entries]] for p in range(parts)]

    def nearest(v, entries):
        return min((min(sum((a - b) ** 2 for a, b in zip(v, e)), codes.LARGEST), j) for j, e in enumerate(entries))

    for _ in range(rounds):
        for p in range(parts):
            own = [nearest(c[p], book[p])[1] for c in cut]
            for j in set(own):
                mine = [c[p] for c, o in zip(cut, own) if o == j]
                book[p][j] = [sum(x) // len(mine) for x in zip(*mine)]
    out, sums = [], collections.Counter()
    for (i, _, label), c in zip(kept, cut):
        found = [nearest(c[p], book[p]) for p in range(parts)]
        error = min(sum(f[0] for f in found), codes.LARGEST)
        out.append((i, "".join(f"{f[1]:02x}" for f in found), error, label))
        sums[label] += error
    digest = hashlib.sha256(",".join(str(v) for p in book for e in p for v in e).encode()).hexdigest()
    return [(i, code, e, min(sums[label], codes.LARGEST), digest) for i, code, e, label in out]


def vectors(n, size, spread=1.0):
    g = np.random.default_rng(n + size)
    middles = g.normal(0, 0.4 * spread, (7, size))
    out = [(i, (middles[i % 7] + g.normal(0, 0.1 * spread, size)).astype("f4").tolist(), [None, 1, 1, 1, 2][i % 5]) for i in range(n)]
    if size:
        out += [(1000, None, 1), (1001, [None] + [0.0] * (size - 1), 1), (1002, [math.nan] * size, 2), (1003, [math.inf] * size, 2)]
    out += [(2000 + i, out[n // 2][1], 9) for i in range(n // 2)]  # a third of the rows are one vector
    return out + [(5, out[min(5, n - 1)][1], 1), (None, out[0][1], 3)]


SCHEMA = "vec_id long, embedding array<float>, label int, "


def frame(spark, v):
    return spark.createDataFrame([(i, x, lab, 0.5, 1, 2, 3, "x", 4, 5, 6, 7) for i, x, lab in v], SCHEMA + CLASH.replace("label string, ", "")).repartition(4)


@pytest.mark.parametrize("n,size,parts,entries,rounds,spread", [
    (150, 64, 16, 64, 2, 1.0), (120, 16, 16, 8, 4, 0.02), (90, 10, 4, 16, 3, 1.0), (60, 8, 2, 5, 3, 3e6), (40, 4, 2, 3, 2, 1e14), (1, 16, 16, 64, 2, 1.0), (5, 0, 4, 8, 2, 1.0)])
def test_codes_equal_brute_force(spark, n, size, parts, entries, rounds, spread):
    v = vectors(n, size, spread) + ([(7000, [0.25], 1)] if size else [])
    expected = codes_expected([(i, x if x is None else [float(np.float32(y)) if y is not None else None for y in x], lab) for i, x, lab in v], parts, entries, rounds)
    got = rows(codes.codes(frame(spark, v), parts, entries, rounds))
    key = lambda r: ((r[0] is None, r[0] or 0), r[1], r[2], r[3])
    assert sorted(got, key=key) == sorted(expected, key=key)


def test_bounds_spare_scans_and_hold():
    g = np.random.default_rng(1)
    x = (g.normal(0, 40, (9, 4))[g.integers(0, 9, 4000)] + g.normal(0, 6, (4000, 4))).astype(np.int64)[:, None, :]
    history = [x[:24].transpose(1, 0, 2).copy()]
    s = codes.begin(x, history[0])
    scans = []
    for _ in range(5):
        book = history[-1].copy()
        for j in range(24):
            if (mine := s.own[:, 0] == j).any():
                book[0, j] = x[mine, 0].sum(0) // mine.sum()
        history.append(book)
        scans.append(codes.advance(x, s, history))
        own, first, _ = codes.scan(x[:, 0], book[0])
        assert (s.own[:, 0] == own).all()
        fresh = s.first_round[:, 0] == len(history) - 1
        assert (s.first[fresh, 0] == first[fresh]).all()
    assert scans[-1] < 3000 and (s.second_round[:, 0] < len(history) - 1).any()
    moves = codes.Moves([h[0] for h in history])
    steps = sum(np.sqrt(((b - a).astype(float) ** 2).sum(2))[0] for a, b in zip(history, history[1:]))
    assert (moves.own[0] <= steps + 1e-9).all() and (moves.own[0] < steps - 1e-3).any()  # tighter than the sum of the moves


def test_codes_empty(spark):
    assert rows(codes.codes(spark.createDataFrame([], SCHEMA[:-2]))) == []
    assert rows(codes.codes(spark.createDataFrame([(1, None, 1)], SCHEMA[:-2]))) == []


def test_codes_query(spark):
    v = [tuple(r) for r in spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    assert sorted(rows(queries.op13_vector_codes(spark, SF))) == sorted(codes_expected(v))


# --- 11 ranking -----------------------------------------------------------------------------------------------

def test_bradley_terry_finds_the_optimum():
    g = np.random.default_rng(3)
    d = g.normal(0.3, 1, (500, 4))
    w = ranking.bradley_terry(d, ridge=0.01)
    p = 1 / (1 + np.exp(d @ w))
    assert np.abs(-(d * p[:, None]).mean(0) + 0.01 * w).max() < 1e-9  # the gradient of a convex loss
    slow = np.zeros(4)
    for _ in range(4000):
        slow += 0.5 * ((d * (1 / (1 + np.exp(d @ slow)))[:, None]).mean(0) - 0.01 * slow)
    assert w == pytest.approx(slow, abs=1e-6)


def test_pairs_hold_every_row():
    good, bad = ranking.pairs(5, 300, 4)
    assert set(good) == set(range(5)) and set(bad) == set(range(300)) and len(good) == 305 * 4


def test_threshold_is_the_quantile():
    g = np.random.default_rng(4)
    good, bad = g.normal(1, 1, (400, ranking._BASE)), g.normal(-1, 1, (200, ranking._BASE))
    m = ranking.fit(good, bad, share_bad=0.25)
    s = m.scores(np.concatenate([good, bad]))
    weight = np.r_[np.full(400, 0.75 / 400), np.full(200, 0.25 / 200)]
    assert weight[s < m.cut].sum() == pytest.approx(0.25, abs=0.003)
    assert ((s >= 0) & (s <= 1)).all() and s[:400].mean() > 0.9 > 0.1 > s[400:].mean()
    order = np.argsort(m.raw(np.concatenate([good, bad])))
    assert (np.diff(s[order]) >= 0).all()


def quality_rows():
    good = ["The river runs past the old town, and the mill stands by its side. " * k for k in (1, 2, 5)]
    bad = ["A### B$$$ | c&&& | d*** | " * k for k in (1, 3, 9)]
    out = [(i, good[i % 3] + f"Case {i}.") for i in range(60)] + [(100 + i, bad[i % 3] + str(i)) for i in range(60)]
    return out + [(500, None), (501, ""), (None, good[0]), (None, None), (502, "word " * 200_000), (7, good[1])] + [(503, bad[0])] * 80


def test_quality_scores_on_awkward_rows(spark):
    data = quality_rows()
    docs = spark.createDataFrame([(i, t, 9.0, 1, 2, 3, "l", "x", 4, 5, 6, 7) for i, t in data], "doc_id long, text string, " + CLASH).repartition(3)
    marks = [(i, 1) for i in range(60)] + [(100 + i, 0) for i in range(60)] + [(5, 0), (None, 1), (900, 1), (3, None), (9, 1), (9, 1)]
    labels = spark.createDataFrame([(i, q, "x", 0) for i, q in marks], "doc_id long, quality int, text string, toxic int")
    got = rows(ranking.quality_scores(docs, labels))
    assert len(got) == len(data)
    assert {(r[0], r[1]) for r in got} == {(i, zlib.crc32(("" if i is None else str(i)).encode()) % 4 == 2) for i, _ in data}
    assert all(0 <= r[2] <= 1 and r[3] == (1 if r[2] >= 0.7 else 0) for r in got)
    assert all(r[3] == (1 if r[0] < 60 else 0) for r in got if r[0] is not None and r[0] < 200 and r[0] != 7)
    assert len({r[2] for r in got if r[0] == 503}) == 1


def test_labels_of_held_out_ids_and_other_columns_change_nothing(spark):
    data = [(i, t) for i, t in quality_rows() if i is not None]
    docs = spark.createDataFrame(data, "doc_id long, text string")
    marks = [(i, 1 if i < 60 else 0) for i, _ in data if i < 200]
    turned = [(i, 1 - q if zlib.crc32(str(i).encode()) % 4 == 2 else q) for i, q in marks]
    schema = "doc_id long, quality int"
    a = sorted(rows(ranking.quality_scores(docs, spark.createDataFrame(marks, schema))))
    b = sorted(rows(ranking.quality_scores(docs.selectExpr("*", "'zz' as lang"), spark.createDataFrame(turned[::-1], schema))))
    assert [r[:2] for r in a] == [r[:2] for r in b] and [r[2] for r in a] == pytest.approx([r[2] for r in b], abs=1e-12)


def test_quality_scores_without_labels_or_documents(spark):
    docs, schema = spark.createDataFrame(quality_rows(), "doc_id long, text string"), "doc_id long, quality int"
    assert {r[2:] for r in rows(ranking.quality_scores(docs, spark.createDataFrame([], schema)))} == {(0.5, 0)}
    assert {r[2:] for r in rows(ranking.quality_scores(docs, spark.createDataFrame([(1, 1), (3, 1), (4, 1)], schema)))} == {(1.0, 1)}
    assert rows(ranking.quality_scores(docs.limit(0), spark.createDataFrame([(1, 1), (100, 0)], schema))) == []


def test_quality_query_on_held_out_labels(spark):
    got = {r[0]: r for r in rows(queries.op11_quality_classifier(spark, SF_LARGER))}
    marks = [tuple(r) for r in spark.read.parquet(f"{SF_LARGER}/labels.parquet").select("doc_id", "quality").collect()]
    test = [(got[i], q) for i, q in marks if got[i][1]]
    good, bad = [r[2] for r, q in test if q == 1], [r[2] for r, q in test if q == 0]
    order = np.mean([(g > b) + 0.5 * (g == b) for g in good for b in bad])
    assert order > 0.98 and np.mean([r[3] == q for r, q in test]) > 0.95
