"""Chat formatting in budgeted, turn-aligned windows; DataFrame functions only.

Prefix sums of turn tokens place each conversation's turns on a line that is
cut at equal lengths: the budget less what a window may repeat, its history and
the system turn, but a quarter of the budget at least.  The turns that lie
between two cuts make a window; a turn that crosses a cut makes one of its own.
A window repeats the system turn, if both fit into the budget, and then of the
turns before it as many as fit, up to a limit of turns and of tokens.  So none
is above the budget, but for one of a single turn that is, which repeats
nothing.  Repeated turns are marked as such and are outside the loss mask: each
assistant turn is under the mask in exactly one window.

A turn is written `<|role|>text<|end|>`, a repeated one `<|=role|>text<|end|>`.
In texts and roles `%` becomes `%25` and `<` becomes `%3C`, in roles also `|`
becomes `%7C` and `=` becomes `%3D`, so nothing a text says can be read as a mark.

Defined results: null texts and roles are empty ones; turns are ordered by
(turn, role, text), null turns first; rows that repeat are turns each; a null
conv_id is a conversation of its own; texts of any length are whole; of several
system turns the first is repeated; an empty table gives no windows.  Other
columns of turns may have any names.  A conversation is put together in one
task, as its windows are its own text; the longest has to fit there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

END = "<|end|>"


def escaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("%"), F.lit("%25")), F.lit("<"), F.lit("%3C"))


def unescaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("%3C"), F.lit("<")), F.lit("%25"), F.lit("%"))


def escaped_role(role: Column) -> Column:
    return F.replace(F.replace(escaped(role), F.lit("|"), F.lit("%7C")), F.lit("="), F.lit("%3D"))


def unescaped_role(role: Column) -> Column:
    return unescaped(F.replace(F.replace(role, F.lit("%7C"), F.lit("|")), F.lit("%3D"), F.lit("=")))


def tokens(text: Column) -> Column:
    """Estimate: a token for each four characters, and four for the marks."""
    return F.ceil(F.length(text) / 4) + 4


def windows(turns: DataFrame, budget: int = 512, history_tokens: int = 128, history_turns: int = 4, counted: str | None = None) -> DataFrame:
    """conv_id, window (its first turn's place), tokens, formatted, loss_spans (start and length in characters of formatted).

    turns(conv_id, turn, role, text).  counted: a column with each turn's
    tokens, marks included; without it they are estimated, and so is the
    result's `tokens`.  One shuffle, on conv_id.
    """
    empty = F.lit("")
    size = tokens(F.coalesce("text", empty)) if counted is None else F.coalesce(F.greatest(F.col(counted).cast("long"), F.lit(1)), F.lit(1))
    t = turns.select("conv_id", "turn", F.coalesce("role", empty).alias("role"), F.coalesce("text", empty).alias("text"), size.alias("n"))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    t = t.select("conv_id", "role", "text", "n", F.row_number().over(order).alias("at"), (F.sum("n").over(so_far) - F.col("n")).alias("start"), F.sum("n").over(so_far).alias("stop"))
    one, by_place = F.struct("at", "start", "n", "role", "text"), Window.partitionBy("conv_id").orderBy("at")
    t = t.withColumns(
        {
            "one": one,
            "before": F.collect_list(one).over(by_place.rowsBetween(-history_turns, -1)),
            "system": F.first(F.when(F.col("role") == "system", one), ignorenulls=True).over(by_place.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)),
        }
    )
    fresh = F.greatest(budget - history_tokens - F.coalesce("system.n", F.lit(0)), F.lit(max(1, budget // 4)))
    first, last = F.floor(F.col("start") / fresh), F.floor((F.col("stop") - 1) / fresh)
    t = t.withColumn("span", 2 * first + F.when(first == last, 0).otherwise(1))
    w = t.groupBy("conv_id", "span").agg(F.sort_array(F.collect_list("one")).alias("new"), F.min_by("before", "at").alias("before"), F.first("system").alias("system"), F.sum("n").alias("n"))
    opens = F.col("new")[0]
    again = F.coalesce((F.col("system.at") < opens["at"]) & (F.col("system.n") + F.col("n") <= budget), F.lit(False))
    w = w.withColumn("room", budget - F.col("n") - F.when(again, F.col("system.n")).otherwise(0))
    near = F.filter("before", lambda x: (opens["start"] - x["start"] <= F.least(F.lit(history_tokens), F.col("room"))) & ~F.coalesce(x["at"] == F.col("system.at"), F.lit(False)))
    kept = F.when(again, F.array("system")).otherwise(F.slice("before", 1, 0))
    seg = lambda repeated: lambda x: F.struct(x["role"].alias("role"), F.lit(repeated).alias("repeated"), F.concat(F.lit("<|=" if repeated else "<|"), escaped_role(x["role"]), F.lit("|>")).alias("head"), escaped(x["text"]).alias("body"))
    total = budget - F.col("room") + F.aggregate(near, F.lit(0).cast("long"), lambda a, x: a + x["n"])
    w = w.select("conv_id", opens["at"].alias("window"), total.alias("tokens"), F.concat(F.transform(kept, seg(True)), F.transform(near, seg(True)), F.transform("new", seg(False))).alias("segs"))
    begin = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("spans"))

    def add(state: Column, s: Column) -> Column:
        text = state["at"] + F.length(s["head"])
        span = F.struct(text.alias("start"), F.length(s["body"]).alias("length"))
        under = (s["role"] == "assistant") & ~s["repeated"]
        return F.struct((text + F.length(s["body"]) + len(END)).alias("at"), F.when(under, F.concat(state["spans"], F.array(span))).otherwise(state["spans"]).alias("spans"))

    return w.select(
        "conv_id",
        "window",
        "tokens",
        F.concat_ws("", F.transform("segs", lambda s: F.concat(s["head"], s["body"], F.lit(END)))).alias("formatted"),
        F.aggregate("segs", begin, add, lambda state: state["spans"]).alias("loss_spans"),
    )


def parsed(formatted: Column) -> Column:
    """The turns a formatted window holds: array of (role, repeated, text), from its marks alone."""
    pieces = F.filter(F.split(formatted, "<\\|end\\|>"), lambda p: p != "")
    head = lambda p: F.substring_index(F.substr(p, F.lit(3)), "|>", 1)
    return F.transform(
        pieces,
        lambda p: F.struct(
            unescaped_role(F.regexp_replace(head(p), "^=", "")).alias("role"),
            F.startswith(head(p), F.lit("=")).alias("repeated"),
            unescaped(F.substr(p, F.length(head(p)) + 5)).alias("text"),
        ),
    )


def digests(written: DataFrame) -> DataFrame:
    """Per conversation, read from windows: turns and loss texts in order, as counts and sha256.

    A digest is of one conversation's whole text, so that text comes together here.
    """
    w = written.select("conv_id", "window", F.length("formatted").alias("chars"), F.filter(parsed(F.col("formatted")), lambda x: ~x["repeated"]).alias("new"), F.transform("loss_spans", lambda s: unescaped(F.substring(F.col("formatted"), s["start"] + 1, s["length"]))).alias("loss"))
    said = F.concat_ws("", F.transform("new", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))))
    w = w.select("conv_id", "chars", F.size("new").alias("n"), F.struct("window", said.alias("said"), F.concat_ws("", "loss").alias("loss")).alias("one"))
    c = w.groupBy("conv_id").agg(F.sum("n").alias("n_turns"), F.sort_array(F.collect_list("one")).alias("all"), F.sum("chars").cast("long").alias("formatted_chars"))
    loss = F.concat_ws("", "all.loss")
    return c.select(
        "conv_id",
        F.col("n_turns").cast("long").alias("n_turns"),
        F.sha2(F.concat_ws("", "all.said"), 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        "formatted_chars",
    )
