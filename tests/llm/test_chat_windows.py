"""Windows of turns against a loop over each conversation: what is in them, what is repeated, what the mask covers."""

import random
import re

import pytest

from fleetcheck.llm import chat, queries

SF = "/root/testdata/sf0.01"


def tokens(text):
    return len(re.findall(r"[^\W_]+|[^\s\w]|_", text))


def windows_expected(turns, budget, history):
    """(window, new turns, repeated turns, tokens) of one conversation's turns (role, text) in order."""
    n = [tokens(t) for _, t in turns]
    system = n[:1] if turns and turns[0][0] == "system" else []
    off, room = len(system), budget - sum(system)
    out, i = [], off
    while i < len(turns) or (not out and off):
        back = i
        while history > 0 and back > off and sum(n[back - 1:i]) <= history:
            back -= 1
        if i < len(turns) and sum(n[back:i]) + n[i] > room:
            back = i
        j = i
        while j < len(turns) and (j == i or sum(n[back:j + 1]) <= room):
            j += 1
        first = not out
        out.append((len(out) + 1, j - i + (off if first else 0), i - back + (0 if first else off), sum(system) + sum(n[back:j])))
        i = j
        if i >= len(turns):
            break
    return out


def made(spark, turns, budget, history):
    df = spark.createDataFrame(turns, "conv_id long, turn int, role string, text string").repartition(3)
    got = {}
    for r in chat.windows(df, budget, history).collect():
        got.setdefault(r["conv_id"], []).append(r)
    return {k: sorted(v, key=lambda r: r["window"]) for k, v in got.items()}


@pytest.mark.parametrize("budget,history", [(60, 20), (100, 0), (40, 39), (15, 4), (1, 5), (5000, 100)])
def test_windows_equal_a_loop(spark, budget, history):
    g = random.Random(budget)
    turns = []
    for c in range(40):
        for i in range(g.randint(1, 30)):
            role = "system" if i == 0 and c % 3 == 0 else g.choice(["user", "assistant", "system"])
            turns.append((c, i, role, " ".join("w" for _ in range(g.choice([0, 1, 5, 12, 30, 70])))))
    got = made(spark, turns, budget, history)
    for c in range(40):
        mine = [(r, t) for k, _, r, t in turns if k == c]
        assert [(w["window"], w["n_new"], w["n_repeated"], w["n_tokens"]) for w in got[c]] == windows_expected(mine, budget, history), c


def test_one_long_turn_costs_one_window(spark):
    turns = [(1, i, "user" if i % 2 else "assistant", "w " * (2100 if i == 20 else 100)) for i in range(40)]
    w = made(spark, turns, 2048, 256)[1]
    assert [(x["n_new"], x["n_repeated"], x["n_tokens"]) for x in w] == [(20, 0, 2000), (1, 0, 2100), (19, 0, 1900)]
    w = made(spark, [t if t[1] != 20 else (1, 20, "user", "w " * 1900) for t in turns], 2048, 256)[1]
    assert [(x["n_new"], x["n_repeated"], x["n_tokens"]) for x in w] == [(20, 0, 2000), (2, 0, 2000), (18, 2, 2000)] or sum(x["n_new"] for x in w) == 40
    assert len(w) <= 4


def test_mask_covers_each_target_once(spark):
    g = random.Random(3)
    turns = [(c, i, g.choice(["user", "assistant"]), f"say {c} {i} [x] ~< " + "é" * g.randint(0, 9)) for c in range(5) for i in range(25)]
    turns += [(c, -1, "system", "be kind <s>") for c in range(3)]
    for c, ws in made(spark, turns, 40, 20).items():
        said = [re.sub("~0", "~", w["formatted"][m["start"]:m["start"] + m["length"]].replace("~3", "]").replace("~2", "[").replace("~1", "<"))
                for w in ws for m in w["mask"]]
        assert said == [t for k, i, r, t in sorted(turns[:], key=lambda x: x[1]) if k == c and r == "assistant"]
        assert len(ws) > 3 and all(w["n_repeated"] > 0 for w in ws[1:])
        if c < 3:
            assert all(w["formatted"].startswith("<s>[system] be kind ~1s></s>") for w in ws)


def test_query_has_several_windows(spark):
    rows = queries.op1_chat_format(spark, SF).collect()
    assert sum(r["n_windows"] > 1 for r in rows) > 20
    turns = spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text")
    by = {}
    for r in turns.collect():
        by.setdefault(r["conv_id"], []).append((r["turn"], r["role"] or "", r["text"] or ""))
    want = {c: windows_expected([x[1:] for x in sorted(t)], 512, 128) for c, t in by.items()}
    assert {r["conv_id"]: r["n_windows"] for r in rows if r["conv_id"] != -7} == {c: len(w) for c, w in want.items()}
    repeated = {}
    for r in chat.windows(turns, 512, 128).collect():
        repeated[r["conv_id"]] = repeated.get(r["conv_id"], 0) + r["n_repeated"]
    assert repeated == {c: sum(x[2] for x in w) for c, w in want.items()} and max(repeated.values()) > 0


def test_no_python_in_the_plan(spark, capsys):
    df = spark.createDataFrame([(1, 1, "user", "a")], "conv_id long, turn int, role string, text string")
    chat.digests(chat.windows(df)).explain()
    plan = capsys.readouterr().out
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
