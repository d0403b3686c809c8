"""Conversations formatted as training windows of a token budget, with a loss mask.

Template, for each turn: ``<|im_start|>role<|im_sep|>text<|im_end|>`` and a line feed. Control strings (of this and of
other common templates) inside a role or text get a backslash after their first character; one that has backslashes
there gets one more, so taking one away gives the text back.

Windows hold whole turns. A turn's tokens are counted (words and signs, plus the marks); prefix sums of the counts
place each turn in a slab of half the room that the system turn leaves, so a slab's turns fit the room however the last
one lies; a turn longer than half the room stands alone (one longer than the whole room is the only case over the
budget). What room is left, up to ``HISTORY`` tokens, is filled with the turns just before, which are repeated without
loss; the first system turn is repeated in every window. Each assistant text is under the loss once.

Only column expressions, windows and joins. The repeated turns are found by a join on (conversation, slab of HISTORY
tokens), so a conversation of any length makes no more pairs than its windows can hold.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegrid.llm.common import text_of

BUDGET, HISTORY = 2048, 512
#: Tokens of a turn's marks and role.
MARKS = 5
START, SEP, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>\n"

_CONTROL = r"(\||/?s>|/?INST\]|</?SYS>>)"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, rf"([<\[])(\\*){_CONTROL}", r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, rf"([<\[])\\(\\*){_CONTROL}", r"$1$2$3")


def n_tokens(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"[\p{L}\p{N}_]+|[^\s\p{L}\p{N}_]")).cast("long")


def _turns(conversations: DataFrame) -> DataFrame:
    """Turns in order, with escaped parts, prefix sums of tokens and the system turn's tokens."""
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        escape(F.coalesce("role", F.lit(""))).alias("role"), escape(text_of()).alias("text"),
    ).withColumn("tokens", n_tokens(F.col("text")) + MARKS)
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    rows = rows.withColumn("k", F.row_number().over(order))
    whole = Window.partitionBy("conv_id")
    is_system = (F.col("k") == 1) & (F.col("role") == "system")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    body = F.when(is_system, 0).otherwise(F.col("tokens"))
    return rows.withColumns({
        "system": is_system,
        "room": F.lit(BUDGET) - F.coalesce(F.max(F.when(is_system, F.col("tokens"))).over(whole), F.lit(0)),
        "at": F.coalesce(F.sum(body).over(before), F.lit(0)),
    })


def _placed(turns: DataFrame) -> DataFrame:
    """Body turns with their window: slabs of half the room, cut before and after a longer turn."""
    half = F.greatest(F.floor(F.col("room") / 2), F.lit(1))
    order = Window.partitionBy("conv_id").orderBy("k")
    body = turns.filter("NOT system").withColumns({"slab": F.floor(F.col("at") / half), "long": F.col("tokens") > half})
    last = lambda c: F.lag(c).over(order)
    starts = last("slab").isNull() | (last("slab") != F.col("slab")) | F.col("long") | last("long")
    return body.withColumn("starts", starts).withColumn("w", F.sum(F.col("starts").cast("int")).over(order))


def format_windows(conversations: DataFrame) -> DataFrame:
    """One row a window: conv_id, window (from 0), tokens, n_turns (all that it shows), n_repeated (those at its start
    that an earlier window has too), text, and loss_spans: array of (start, length) in characters of ``text``.

    Null role or text: empty. Turns in order of turn (nulls first), then role and text; repeated rows are turns of
    their own. Null conv_id: one conversation of its own. Other columns are not read. Empty table: no rows.
    """
    turns = _turns(conversations)
    body = _placed(turns).select("conv_id", "k", "role", "text", "tokens", "at", "room", "w")
    windows = body.groupBy("conv_id", "w").agg(F.min("k").alias("first"), F.min("at").alias("from"), F.sum("tokens").alias("sum"), F.first("room").alias("room"))
    windows = windows.withColumn("back", F.least(F.lit(HISTORY), F.col("room") - F.col("sum")))
    # turns of history: in the window's slab of HISTORY tokens, or the one before
    slab = F.floor(F.col("from") / HISTORY)
    wanted = windows.filter("back > 0 AND w > 1").select("conv_id", "w", "first", "from", "back", F.explode(F.array(slab, slab - 1)).alias("h"))
    past = body.select(F.col("conv_id").alias("c"), "k", "role", "text", "tokens", "at", F.floor(F.col("at") / HISTORY).alias("h2"))
    close = F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("h") == F.col("h2")) & (F.col("k") < F.col("first")) & (F.col("at") >= F.col("from") - F.col("back"))
    history = wanted.join(past, close).select("conv_id", "w", "k", "role", "text", "tokens", F.lit(True).alias("again"))
    # a conversation of a system turn alone is one window of no body turn
    heads = turns.filter("system").select(F.col("conv_id").alias("c"), "k", "role", "text", "tokens")
    first = F.coalesce("w", F.lit(1)).alias("w")
    shown = heads.join(windows.select("conv_id", "w"), F.col("conv_id").eqNullSafe(F.col("c")), "left")
    top = shown.select(F.col("c").alias("conv_id"), first, "k", "role", "text", "tokens", (F.coalesce("w", F.lit(1)) > 1).alias("again"))
    every = body.select("conv_id", "w", "k", "role", "text", "tokens", F.lit(False).alias("again")).unionByName(history).unionByName(top)
    piece = F.concat(F.lit(START), F.col("role"), F.lit(SEP), F.col("text"), F.lit(END))
    loss = (F.col("role") == "assistant") & ~F.col("again")
    lead = F.length(F.concat(F.lit(START), F.col("role"), F.lit(SEP)))
    lists = every.groupBy("conv_id", "w").agg(
        F.sum("tokens").alias("tokens"),
        F.array_sort(F.collect_list(F.struct("k", piece.alias("piece"), lead.alias("lead"), F.length("text").alias("size"), loss.alias("loss"), F.col("again")))).alias("t"),
    )
    ends = F.aggregate("t", F.array(F.lit(0)), lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + F.length(x["piece"]))))
    lists = lists.withColumn("starts", ends)
    spans = F.filter(
        F.transform("t", lambda x, i: F.when(x["loss"], F.struct((F.get(F.col("starts"), i) + x["lead"]).cast("long").alias("start"), x["size"].cast("long").alias("length")))),
        lambda s: s.isNotNull(),
    )
    return lists.select(
        "conv_id", (F.col("w") - 1).cast("long").alias("window"), "tokens", F.size("t").cast("long").alias("n_turns"),
        F.size(F.filter("t", lambda x: x["again"])).cast("long").alias("n_repeated"),
        F.array_join(F.transform("t", lambda x: x["piece"]), "").alias("text"), spans.alias("loss_spans"),
    )


def read_windows(windows: DataFrame) -> DataFrame:
    """The windows' text taken apart again: turns (role and text, unescaped) that are new in each window, in order, and
    the texts under the loss mask."""
    split = F.slice(F.split("text", r"<\|im_start\|>"), 2, F.col("n_turns").cast("int"))
    new = F.slice(split, F.col("n_repeated").cast("int") + 1, F.greatest(F.size(split) - F.col("n_repeated").cast("int"), F.lit(0)))
    parts = lambda t: F.split(F.regexp_replace(t, r"<\|im_end\|>\n$", ""), r"<\|im_sep\|>")
    turns = F.transform(new, lambda t: F.struct(unescape(parts(t)[0]).alias("role"), unescape(parts(t)[1]).alias("text")))
    masked = F.transform("loss_spans", lambda s: unescape(F.substring(F.col("text"), s["start"] + 1, s["length"])))
    return windows.select("conv_id", "window", turns.alias("turns"), masked.alias("loss_texts"), F.length("text").cast("long").alias("chars"))
