"""Operator 6: chat formatting in budgeted windows, in DataFrame functions only.

Prefix sums of turn tokens cut a conversation into spans of whole turns, so that a span fits into
its window beside the system turn and the last turns of the span before, which stand in front of it; the loss mask covers the
assistant texts of the span itself, never a repeated one.

A turn is written ``<|role|>``, newline, text, ``</s>``, newline. In texts and roles ``<``, ``[``
and the backslash get a backslash behind them (in roles ``|`` as well), so no control string of
this or other templates survives, and taking these backslashes away gives the text again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import running_sum, stored

OPEN, CLOSE, END = "<|", "|>\n", "</s>\n"


def escaped(text: Column, special: str = r"[<\[\\]") -> Column:
    return F.regexp_replace(text, f"({special})", r"$1\\")


def unescaped(text: Column, special: str = r"[<\[\\]") -> Column:
    return F.regexp_replace(text, rf"({special})\\", "$1")


ROLE = r"[<\[\\|]"


BLOCK = 32  # budgets that a block of turns spans


def head_of(role: Column) -> Column:
    return F.concat(F.lit(OPEN), escaped(role, ROLE), F.lit(CLOSE))


def tokens(role: Column, text: Column) -> Column:
    """Tokens that a turn is counted as: a fourth of the characters that it is written with."""
    return F.ceil((F.length(head_of(role)) + F.length(escaped(text)) + len(END)) / 4).cast("bigint")


def spans(turns: Column, room: Column) -> Column:
    """For each of the turns (upto, tokens, cost, role, text) of a block the token at which its span
    starts: a span takes turns as long as their costs fit into the room, one turn at least."""
    def step(a: Column, x: Column) -> Column:
        opens = (a["start"] < 0) | ((a["used"] > 0) & (a["used"] + x["cost"] > room))
        start = F.when(opens, x["upto"] - x["tokens"]).otherwise(a["start"])
        return F.struct(F.when(opens, x["cost"]).otherwise(a["used"] + x["cost"]).alias("used"), start.alias("start"),
                        F.array_append(a["starts"], start).alias("starts"))

    none = F.struct(F.lit(0).cast("bigint").alias("used"), F.lit(-1).cast("bigint").alias("start"),
                    F.array().cast("array<bigint>").alias("starts"))
    return F.aggregate(turns, none, step, lambda a: a["starts"])


def windows(turns: DataFrame, budget: int = 512, history: int = 128, conv: str = "conv_id", turn: str = "turn",
            role: str = "role", text: str = "text", count: str | None = None) -> DataFrame:
    """One row for each window: conv_id, window (the token at which its span starts), text, repeated
    (turns in front that other windows have as their own) and loss (start and end of each masked
    text, in code points from 0).

    A window holds at most ``budget`` tokens: the system turn, up to ``history`` tokens of the span
    before, by whole turns, and its span, which takes the turns that fit into what these leave. Only
    a turn that is longer than that by itself makes a longer window, in which it is the whole span;
    turns are not cut. Spans start anew every ``BLOCK`` budgets, so a conversation of any length is
    cut block by block. The system turn is a first turn with role ``system``. ``count`` names a column
    with the tokens of a turn (at least one, null: one); without it ``tokens`` counts them.
    Turns are ordered by turn, role, text; null texts and roles are empty; conversations with a
    null id are one. An empty assistant text has no mask. Other columns are not read."""
    t = turns.select(turns[conv].alias("conv_id"), turns[turn].alias("turn"),
                     F.coalesce(turns[role].cast("string"), F.lit("")).alias("role"),
                     F.coalesce(turns[text].cast("string"), F.lit("")).alias("text"),
                     *([F.greatest(turns[count].cast("bigint"), F.lit(1)).alias("tokens")] if count else []))
    t = t if count else t.withColumn("tokens", tokens(F.col("role"), F.col("text")))
    t = running_sum(t, ["conv_id"], ["turn", "role", "text"], "tokens", "upto")
    first = (F.col("upto") == F.col("tokens")) & (F.col("role") == "system")
    t = stored(t.withColumn("cost", F.when(first, 0).otherwise(F.col("tokens")).cast("bigint"))
               .withColumn("block", F.floor((F.col("upto") - F.col("tokens")) / (BLOCK * budget))))
    lead = t.where(first).select(F.col("conv_id").alias("c"), F.col("tokens").alias("lead"))
    # a block holds the turns that start within its tokens, of which each has one at least
    blocks = t.groupBy("conv_id", "block").agg(F.sort_array(F.collect_list(F.struct("upto", "tokens", "cost", "role", "text"))).alias("x"))
    blocks = blocks.join(lead, F.col("conv_id").eqNullSafe(F.col("c")), "left")
    room = F.greatest(F.lit(budget - history) - F.coalesce("lead", F.lit(0)), F.lit(0)).cast("bigint")
    cut = blocks.select("conv_id", "x", room.alias("room")).select("conv_id", "x", spans(F.col("x"), F.col("room")).alias("window"))
    t = cut.select("conv_id", F.explode(F.arrays_zip("x", "window")).alias("z")).select("conv_id", "z.x.*", "z.window")
    t = t.withColumn("before", F.col("upto") - F.col("tokens"))
    t = stored(t.withColumn("next", F.max("upto").over(Window.partitionBy("conv_id", "window"))))
    total = t.groupBy(F.col("conv_id").alias("c")).agg(F.max("upto").alias("total"))
    later = t.select(F.col("conv_id").alias("c"), F.col("window").alias("w")).where("w > 0").distinct()
    system = (F.col("before") == 0) & (F.col("role") == "system")
    shape = ["conv_id", "window", "upto", "role", "text", "again"]
    own = t.withColumn("again", F.lit(False)).select(*shape)
    last = t.where((F.col("next") - F.col("before") <= history) & ~system)
    last = last.join(total, F.col("conv_id").eqNullSafe(F.col("c"))).where("next < total").withColumn(
        "window", F.col("next")).withColumn("again", F.lit(True)).select(*shape)
    lead = t.where(system).join(later, F.col("conv_id").eqNullSafe(F.col("c"))).withColumn("window", F.col("w")).withColumn(
        "again", F.lit(True)).select(*shape)
    # a window holds its budget, or one longer turn beside its history and the system turn
    rows = own.unionByName(last).unionByName(lead).groupBy("conv_id", "window").agg(
        F.sort_array(F.collect_list(F.struct("upto", "role", "text", "again"))).alias("turns"))
    rows = rows.select("conv_id", "window", F.transform("turns", lambda x: F.struct(
        head_of(x["role"]).alias("head"), escaped(x["text"]).alias("body"), ((x["role"] == "assistant") & ~x["again"]).alias("learn"),
        x["again"].alias("again"))).alias("parts"))
    size = lambda p: F.length(p["head"]) + F.length(p["body"]) + len(END)
    start = lambda p, i: F.aggregate(F.slice("parts", 1, i), F.lit(0), lambda s, q: s + size(q)) + F.length(p["head"])
    loss = F.filter(F.transform("parts", lambda p, i: F.struct(
        start(p, i).alias("start"), (start(p, i) + F.length(p["body"])).alias("end"), p["learn"].alias("learn"))),
        lambda s: s["learn"] & (s["end"] > s["start"]))
    return rows.select(
        "conv_id", "window", F.array_join(F.transform("parts", lambda p: F.concat(p["head"], p["body"], F.lit(END))), "").alias("text"),
        F.size(F.filter("parts", lambda p: p["again"])).alias("repeated"),
        F.transform(loss, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))).alias("loss"))


def read_back(formatted: DataFrame) -> DataFrame:
    """conv_id, window, turns (role and text of the window's own turns), learned (unescaped text of
    each masked stretch) and chars, all taken from the formatted text."""
    pieces = F.split("text", END, -1)
    pieces = F.slice(pieces, F.col("repeated") + 1, F.size(pieces) - 1 - F.col("repeated"))
    head = lambda p: F.substring_index(p, CLOSE, 1)
    turns = F.transform(pieces, lambda p: F.struct(
        unescaped(F.substr(head(p), F.lit(len(OPEN) + 1)), ROLE).alias("role"),
        unescaped(F.substr(p, F.length(head(p)) + len(CLOSE) + 1)).alias("text")))
    learned = F.transform("loss", lambda s: unescaped(F.substr("text", s["start"] + 1, s["end"] - s["start"])))
    return formatted.select("conv_id", "window", turns.alias("turns"), learned.alias("learned"), F.length("text").alias("chars"))
