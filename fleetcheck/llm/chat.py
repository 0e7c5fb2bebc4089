"""Chat formatting into budgeted windows, DataFrame functions only.

A turn is written ``<s>[role] text</s>``. Inside roles and texts the characters that begin a mark are escaped:
``~`` as ``~0``, ``<`` as ``~1``, ``[`` as ``~2``, ``]`` as ``~3``; undoing them in the order 3, 2, 1, 0 gives the
text back. Windows are spans of whole turns that fill the budget: with prefix sums of the turns' tokens, a window takes
turns as long as its tokens, those of the system turn (a first turn with that role, repeated in every window) and
those of its history stay within the budget. Its history are the turns that begin at most ``history`` tokens before its
first new turn; the prefix sums give it for every turn, before any window is chosen. A turn that does not fit beside its
history is a window without one, and one that is over the budget alone is a window of its own, over the budget; the
turns after it fill their windows again. The loss mask covers the texts of new assistant turns; repeated targets are
masked out.

Tokens are words and single other characters, counted without Python; any expression of text can take their place.

Defined results: null roles and texts count as empty, null turns come first; equal turn numbers are ordered by role
and text, repeated rows are turns of their own; null conversations are one conversation; an empty table gives an
empty one; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import scratch_path

BUDGET = 2048
HISTORY = 256
_ESCAPES = [("~", "~0"), ("<", "~1"), ("[", "~2"), ("]", "~3")]


def escape(c: Column) -> Column:
    for raw, sign in _ESCAPES:
        c = F.replace(c, F.lit(raw), F.lit(sign))
    return c


def unescape(c: Column) -> Column:
    for raw, sign in reversed(_ESCAPES):
        c = F.replace(c, F.lit(sign), F.lit(raw))
    return c


def word_tokens(c: Column) -> Column:
    return F.regexp_count(c, F.lit(r"[\p{L}\p{N}]+|[^\s\p{L}\p{N}]"))


def windows(turns: DataFrame, budget: int = BUDGET, history: int = HISTORY, tokens=word_tokens) -> DataFrame:
    """(conv_id, window, n_repeated, n_new, n_tokens, formatted, mask) of turns (conv_id, turn, role, text).

    mask is an array of (start, length) in code points of formatted: the texts of new assistant turns.
    """
    every = Window.partitionBy("conv_id")
    t = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    t = t.withColumn("n", tokens(F.col("text")).cast("long"))
    t = t.withColumn("at", F.row_number().over(every.orderBy("turn", "role", "text")))
    t = t.withColumn("system", (F.col("at") == 1) & (F.col("role") == "system"))
    head, body = F.concat(F.lit("<s>["), escape(F.col("role")), F.lit("] ")), escape(F.col("text"))
    t = t.select("conv_id", "at", "role", "system", "n", F.length(head).alias("skip"), F.length(body).alias("chars"),
                 F.concat(head, body, F.lit("</s>")).alias("piece"))
    # Prefix sums of tokens and of code points over the turns that aren't the system's.
    own = lambda c: F.when(F.col("system"), 0).otherwise(F.col(c)).cast("long")
    t = t.withColumn("own", own("n")).withColumn("size", F.length("piece")).withColumn("size", own("size"))
    upto = every.orderBy("at")
    t = t.withColumn("before", F.sum("own").over(upto) - F.col("own")).withColumn("place", F.sum("size").over(upto) - F.col("size"))
    # The history that a window would have if it began at this turn: where it begins, and its tokens.
    near = every.orderBy("before").rangeBetween(-history, 0)
    t = t.withColumn("since", F.min(F.when(~F.col("system"), F.col("at"))).over(near) if history > 0 else F.col("at"))
    t = t.withColumn("held", F.col("before") - F.min(F.when(~F.col("system"), F.col("before"))).over(near) if history > 0 else F.lit(0).cast("long"))
    one = F.struct("at", "role", "n", "before", "place", "since", "held", "skip", "chars", "piece")
    c = t.groupBy("conv_id").agg(
        F.sort_array(F.collect_list(F.when(~F.col("system"), one))).alias("t"),
        F.max(F.when(F.col("system"), F.struct("piece", "n"))).alias("s"))
    c = c.select("conv_id", "t", F.coalesce("s.piece", F.lit("")).alias("first"), F.coalesce("s.n", F.lit(0)).cast("long").alias("sys_n"),
                 F.col("s").isNotNull().cast("int").alias("sys"))
    room = budget - F.col("sys_n")

    def step(acc, x):
        """One turn: it goes on with the window that begins at ``base``, or begins one itself."""
        fits = x["n"] + x["held"] <= room
        begins = (F.size(acc["starts"]) == 0) | (x["before"] + x["n"] - acc["base"] + acc["held"] > room)
        start = F.struct(x["at"].alias("at"), F.when(fits, x["since"]).otherwise(x["at"]).alias("since"))
        return F.struct(F.when(begins, F.concat(acc["starts"], F.array(start))).otherwise(acc["starts"]).alias("starts"),
                        F.when(begins, x["before"]).otherwise(acc["base"]).alias("base"),
                        F.when(begins, F.when(fits, x["held"]).otherwise(F.lit(0).cast("long"))).otherwise(acc["held"]).alias("held"))

    none = F.struct(F.array().cast("array<struct<at:int,since:int>>").alias("starts"), F.lit(0).cast("long").alias("base"), F.lit(0).cast("long").alias("held"))
    c = c.withColumn("starts", F.aggregate("t", none, step)["starts"])
    # A conversation of the system turn alone is one window as well.
    alone = F.array(F.struct((F.col("sys") + 1).alias("at"), (F.col("sys") + 1).alias("since")))
    c = c.withColumn("starts", F.when(F.size("starts") == 0, alone).otherwise(F.col("starts")))

    def window(s, k):
        end = F.coalesce(F.get("starts", k + 1)["at"], F.size("t") + F.col("sys") + 1)
        return F.struct((k + 1).alias("window"), s["at"].alias("at"), F.slice("t", s["since"] - F.col("sys"), end - s["since"]).alias("t"))

    w = c.select("conv_id", "first", "sys_n", "sys", F.inline(F.transform("starts", window)))
    begin = F.get("t", 0)
    fresh = F.size(F.filter("t", lambda x: x["at"] >= F.col("at")))
    target = F.filter("t", lambda x: (x["at"] >= F.col("at")) & (x["role"] == "assistant"))
    mask = F.transform(target, lambda x: F.struct((F.length("first") + x["place"] - begin["place"] + x["skip"]).cast("long").alias("start"),
                                                  x["chars"].cast("long").alias("length")))
    last = F.get("t", F.size("t") - 1)
    opening = F.when(F.col("window") == 1, F.col("sys")).otherwise(0)  # the system turn is new in the first window
    return w.select("conv_id", "window", (F.size("t") - fresh + F.col("sys") - opening).cast("long").alias("n_repeated"),
                    (fresh + opening).cast("long").alias("n_new"),
                    (F.col("sys_n") + F.coalesce(last["before"] + last["n"] - begin["before"], F.lit(0))).alias("n_tokens"),
                    F.concat("first", F.array_join(F.col("t")["piece"], "")).alias("formatted"), mask.alias("mask"))


def digests(formatted: DataFrame) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, n_windows) from windows' text and mask."""
    role_end = lambda x: F.position(F.lit("] "), x)  # noqa: E731  "]" is escaped in roles, so the first ends the mark
    turns = F.transform(F.filter(F.split("formatted", "</s>", -1), lambda x: x != ""), lambda x: F.concat(
        unescape(F.substr(x, F.lit(5), role_end(x) - 5)), F.lit("\n"), unescape(F.substr(x, role_end(x) + 2)), F.lit("\n")))
    one = formatted.withColumn("t", turns)
    one = one.withColumn("fresh", F.slice("t", F.col("n_repeated").cast("int") + 1, F.greatest(F.size("t"), F.lit(1))))
    one = one.withColumn("loss", F.transform("mask", lambda m: unescape(
        F.substr("formatted", (m["start"] + 1).cast("int"), m["length"].cast("int")))))
    rows = one.groupBy("conv_id").agg(
        F.sort_array(F.collect_list(F.struct("window", "fresh", "loss"))).alias("w"),
        F.sum(F.length("formatted")).cast("long").alias("formatted_chars"), F.count("*").alias("n_windows"))
    fresh, loss = F.flatten(F.col("w")["fresh"]), F.array_join(F.flatten(F.col("w")["loss"]), "")
    return rows.select("conv_id", F.size(fresh).cast("long").alias("n_turns"), F.sha2(F.array_join(fresh, ""), 256).alias("turns_sha256"),
                       F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"), "formatted_chars", "n_windows")


def formatted_files(turns: DataFrame, budget: int = BUDGET, history: int = HISTORY) -> DataFrame:
    """The windows of turns, written to the shared folder and read back."""
    spark = turns.sparkSession
    path = scratch_path(spark, "chat")
    out = windows(turns, budget, history)
    out.write.parquet(path)
    return spark.read.schema(out.schema).parquet(path)
