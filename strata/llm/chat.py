"""Chat formatting by event-sourced reconstruction, in DataFrame expressions only.

A log row is an event ``(conv_id, seq, message, event, role, text)``:

* ``message``     opens (or opens again) a message with a role and a first text
* ``delta``       appends streamed text
* ``edit``        replaces the text
* ``regenerate``  throws the text away; deltas after it build the new one
* ``delete``      removes the message

``fold`` brings a log to its final messages, ``render`` writes a conversation in a template with
marked turns, escaped control strings and a loss mask, ``read_back`` reads a rendered string back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The template's marks.  Every mark starts with "<|", which escaping keeps out of texts.
TURN, SAYS, END = "<|turn|>", "<|says|>", "<|end|>"
#: First character of a control string, if the rest follows: this template's and other common ones.
CONTROL = r"<(?=\||/?s>|</?SYS>>)|\[(?=/?INST\])"
RESETS = ("message", "edit", "regenerate", "delete")


def escape(text: Column) -> Column:
    """Doubles backslashes, then puts one behind the first character of each control string."""
    return F.regexp_replace(F.regexp_replace(text, r"\\", r"\\\\"), CONTROL, r"$0\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def events_of_rows(conversations: DataFrame) -> DataFrame:
    """Rows ``(conv_id, turn, role, text)`` as a log: each row opens a message and streams its text.
    Rows are ordered by turn (null first), ties by role and text; repeated rows are separate turns."""
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    rows = conversations.select("conv_id", "turn", "role", "text").withColumn("message", F.row_number().over(order))
    opened = F.struct((F.col("message") * 2).alias("seq"), F.lit("message").alias("event"), F.col("role").alias("role"), F.lit("").alias("text"))
    streamed = F.struct((F.col("message") * 2 + 1).alias("seq"), F.lit("delta").alias("event"), F.lit(None).cast("string").alias("role"), F.col("text").alias("text"))
    return rows.select("conv_id", "message", F.inline(F.array(opened, streamed)))


def fold(log: DataFrame) -> DataFrame:
    """Final messages ``(conv_id, message, first_seq, role, text)``.

    A message's text is that of its last reset event and of the deltas after it.  Events with the
    same sequence number go by event name, role, text; repeated events count as often as they
    occur; null text is empty; null role is the last one given, or empty; a message that ends
    deleted, or events without a message number, give no row."""
    e = F.struct("seq", "event", "role", F.coalesce("text", F.lit("")).alias("text"))
    m = log.filter(F.col("message").isNotNull()).groupBy("conv_id", "message").agg(F.array_sort(F.collect_list(e)).alias("log"))
    last = F.array_max(F.transform("log", lambda x, i: F.when(x["event"].isin(*RESETS), i + 1).otherwise(0)))
    m = m.withColumn("live", F.slice("log", F.greatest(last, F.lit(1)), F.size("log")))
    roles = F.filter(F.transform("log", lambda x: x["role"]), lambda r: r.isNotNull())
    text = F.array_join(F.transform("live", lambda x: F.when(x["event"] == "regenerate", "").otherwise(x["text"])), "")
    return m.filter(F.col("live")[0]["event"] != "delete").select(
        "conv_id", "message", F.col("log")[0]["seq"].alias("first_seq"),
        F.coalesce(F.try_element_at(roles, F.lit(-1)), F.lit("")).alias("role"), text.alias("text"))


def render(messages: DataFrame, learned: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """``(conv_id, formatted, loss)``: the turns in order, and for each turn the code points
    ``[start, end)`` of its text in ``formatted`` if it is learned, else null.

    One conversation is one output string, so its turns meet in one task by contract."""
    order = Window.partitionBy("conv_id").orderBy("first_seq", "message")
    turn = messages.withColumn("head", F.concat(F.lit(TURN), escape(F.col("role")), F.lit(SAYS))).withColumn("body", escape(F.col("text")))
    turn = turn.select("conv_id", "first_seq", "message", F.concat("head", "body", F.lit(END)).alias("piece"), F.length("head").alias("h"), F.length("body").alias("b"), F.col("role").isin(*learned).alias("on"))
    turn = turn.withColumn("at", F.coalesce(F.sum(F.length("piece")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + F.col("h"))
    mask = F.when(F.col("on"), F.struct(F.col("at").alias("start"), (F.col("at") + F.col("b")).alias("end")))
    turns = turn.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("first_seq", "message", "piece", mask.alias("loss")))).alias("t"))
    return turns.select("conv_id", F.array_join("t.piece", "").alias("formatted"), F.col("t.loss").alias("loss"))


def read_back(formatted: DataFrame) -> DataFrame:
    """``(conv_id, chars, t: array<struct<role, text, learned>>)`` of rendered rows ``(conv_id, formatted,
    loss)``: ``chars`` is the length of ``formatted``, ``learned`` what stands in ``formatted`` between the code points of the turn's part of
    the mask, null if it has none.  A part that does not lie inside its turn raises.

    A turn's place is the running length of the turns before it, taken once for each conversation."""
    pieces = F.slice(F.split("formatted", r"<\|turn\|>", -1), 2, F.size("loss"))
    turn = formatted.select("conv_id", F.length("formatted").alias("chars"), F.posexplode_outer(F.arrays_zip(pieces.alias("piece"), F.col("loss").alias("loss"))).alias("i", "x"))
    turn = turn.select("conv_id", "chars", "i", "x.*")
    before = Window.partitionBy("conv_id").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    turn = turn.withColumn("at", F.coalesce(F.sum(F.length("piece") + len(TURN)).over(before), F.lit(0)) + len(TURN))
    inside = (F.col("loss.start") >= F.col("at")) & (F.col("loss.end") <= F.col("at") + F.length("piece")) & (F.col("loss.start") <= F.col("loss.end"))
    under = F.when(inside, F.substr("piece", (F.col("loss.start") - F.col("at") + 1).cast("int"), (F.col("loss.end") - F.col("loss.start")).cast("int"))).otherwise(
        F.raise_error(F.lit("a part of the mask lies outside its turn")).cast("string"))
    body = F.substr("piece", F.locate(SAYS, F.col("piece")) + len(SAYS))
    said = F.struct("i", unescape(F.substring_index("piece", SAYS, 1)).alias("role"), unescape(F.substring_index(body, END, 1)).alias("text"),
                    F.when(F.col("loss").isNotNull(), unescape(under)).alias("learned"))
    turns = turn.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.when(F.col("i").isNotNull(), said))).alias("t"), F.first("chars").alias("chars"))
    return turns.select("conv_id", "chars", F.transform("t", lambda x: F.struct(x["role"], x["text"], x["learned"])).alias("t"))


def format_chats(conversations: DataFrame, learned: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """Conversation rows -> ``(conv_id, formatted, loss)``.  Null ids form one conversation; null
    text and role are empty; an empty table gives no rows; other columns are ignored."""
    return render(fold(events_of_rows(conversations)), learned)
