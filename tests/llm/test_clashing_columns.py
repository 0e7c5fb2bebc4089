"""Columns of a user's table that have the names used inside: kept as they are, and no error."""

import pytest

from fleetcheck.llm import decontaminate, quality, simhash, suffix, token_counts, tokens
from fleetcheck.llm.common import scratch_path

INNER = ["_t", "_w", "_l", "_g", "_p", "_r", "_sym", "_rep", "_dup", "_long", "_short", "_lang", "_source", "fence", "fence_", "rules", "_keep", "keep",
         "keep_", "_bad", "_rid", "rid", "row", "_z", "_of", "_spans", "c0", "c1", "c2", "component_id", "fingerprint", "fp", "digest", "copies",
         "n_tokens", "n_words_", "start", "n", "anchor", "rule", "bucket", "with.dot", "with space"]
PASSAGE = " ".join(f"passage word number {i} of it" for i in range(40))


@pytest.fixture(scope="module")
def docs(spark):
    texts = ["The river ran past the old town and the mill. " * 9, "The river ran past the old town and the mill. " * 9, "One " + PASSAGE + " two", "Three " + PASSAGE,
             None, "", "what is the name of the longest river that runs through the seven old towns of the north"]
    rows = [(i, t, "en", "s", len(t or ""), *[f"{c}{i}" for c in INNER]) for i, t in enumerate(texts)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in INNER)
    return spark.createDataFrame(rows, schema)


def kept_whole(df, but=()):
    for r in df.select("doc_id", *[f"`{c}`" for c in INNER if c not in but]).collect():
        assert all(r[c] == f"{c}{r['doc_id']}" for c in INNER if c not in but)


def test_quality(docs):
    out = quality.apply_rules(docs)
    assert set(INNER) <= set(out.columns) and out.count() == 7
    kept_whole(out)


def test_simhash(docs):
    out = simhash.keep_first(docs)
    assert out.columns == docs.columns and sorted(r["doc_id"] for r in out.collect()) == [0, 2, 3, 4, 6] or out.count() < 7
    kept_whole(out)


def test_suffix(docs):
    out = suffix.without_repeats(docs)
    assert set(INNER) <= set(out.columns) and "text" not in out.columns
    assert {r["doc_id"]: r["n_removed"] > 0 for r in out.collect()} == {0: True, 1: True, 2: True, 3: True, 4: False, 5: False, 6: False}
    kept_whole(out)


def test_decontaminate(spark, docs):
    items = spark.createDataFrame([(1, "what is the name of the longest river that runs through the seven old towns of the north")], "item_id long, text string")
    out = decontaminate.clean(docs, items)
    assert out.columns == docs.columns and sorted(r["doc_id"] for r in out.collect()) == [0, 1, 2, 3, 4, 5]
    kept_whole(out)


def test_token_counts(spark, docs):
    out = token_counts.token_counts(docs, tokens.tokenizer_path("piece_bpe_32k.model"), scratch_path(spark, "clash_cache"))
    assert sorted(r["doc_id"] for r in out.collect()) == list(range(7))


def test_counts_of_hot_contents(spark):
    path, cache = tokens.tokenizer_path("piece_bpe_32k.model"), scratch_path(spark, "hot_cache")
    rows = [(i, "the same text") for i in range(4000)] + [(5000 + i, f"text number {i}") for i in range(3000)] + [(9000, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    for _ in range(2):  # the second time from the cache
        got = {r["doc_id"]: (r["n_bytes"], r["n_tokens"]) for r in token_counts.token_counts(df, path, cache).collect()}
        assert len(got) == 7001 and got[9000] == (0, 0) and len({got[i] for i in range(4000)}) == 1 and got[0][0] == 13 and got[5000][1] > 0
    assert spark.read.parquet(cache).count() == 3002
