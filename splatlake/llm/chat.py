"""Chat formatting by event-sourced reconstruction, with DataFrame functions only.

``messages`` folds an event log into final messages. Events of a conversation are ordered by ``seq``; each names the
message it is about by its ordinal (``msg``, ``part``):

* ``message``: the message with its role and whole text,
* ``delta``: text appended to it (a streamed piece),
* ``edit``: its text replaced,
* ``regenerate``: its text dropped and every later message that existed by then withdrawn; deltas that follow rebuild it.

``blocks`` renders messages with a template, in blocks of ``BLOCK`` successive ordinals of one conversation, and gives the
loss mask as spans of the rendered text; ``render`` joins the blocks to one text for each conversation. ``read_back``
parses rendered blocks again.

A message is ``[INST] role [/INST] text </s>`` without the blanks. In role and text a backslash becomes ``\\z``, ``<``
becomes ``\\l`` and ``[`` becomes ``\\b``, so no control string can stand inside, and the steps undone in reverse give the
text back. The loss mask holds each assistant text.

A conversation may hold a third of all events: the fold is by message, running maxima and sums go block by block first,
and only finished block texts meet in one row, which is the result's own size. Messages that share one ordinal (rows of
equal turn) are in one block.

Defined results: null text or role is empty; null ``seq`` or ``msg`` come first; null conversations are one conversation;
events with equal ``seq`` go by kind, then text; an unknown kind is passed over. An empty log gives an empty result.
Other columns are passed over.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Ordinals in a block.
BLOCK = 256
#: The template's control strings.
OPEN, MIDDLE, CLOSE = "[INST]", "[/INST]", "</s>"


def escape(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("\\"), F.lit("\\z")), F.lit("<"), F.lit("\\l")), F.lit("["), F.lit("\\b"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("\\b"), F.lit("[")), F.lit("\\l"), F.lit("<")), F.lit("\\z"), F.lit("\\"))


def _block() -> Column:
    return F.expr(f"msg div {BLOCK}")


def messages(events: DataFrame) -> DataFrame:
    """Final messages (conv_id, msg, part, role, text) of a log (conv_id, seq, msg, part, kind, role, text)."""
    e = events.select("conv_id", F.coalesce("seq", F.lit(-(1 << 62))).alias("seq"), F.coalesce("msg", F.lit(-(1 << 62))).alias("msg"), F.coalesce("part", F.lit(0)).alias("part"), "kind", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).where("kind in ('message', 'delta', 'edit', 'regenerate')")
    # an event's place in the log: resets sort by (seq, kind), and a message keeps what follows its last reset
    place = F.struct("seq", F.when(F.col("kind") == "delta", 1).otherwise(0).alias("late"))
    e = e.withColumn("place", place).withColumn("resets", F.col("kind") != "delta")
    one = e.groupBy("conv_id", "msg", "part").agg(
        F.max(F.when(F.col("resets"), F.col("place"))).alias("reset"),
        F.max(F.when(F.col("kind") == "regenerate", F.col("seq"))).alias("again"),
        F.min("seq").alias("born"),
        F.array_sort(F.collect_list(F.struct("place", "kind", "text"))).alias("log"),
        F.max_by("role", F.struct((F.col("kind") == "message").alias("m"), F.col("role") != "", "seq", "role")).alias("role"),
    )
    tail = F.filter("log", lambda x: F.col("reset").isNull() | (x["place"] >= F.col("reset")))
    text = F.array_join(F.transform(F.filter(tail, lambda x: x["kind"] != "regenerate"), lambda x: x["text"]), "")
    one = one.select("conv_id", "msg", "part", "role", "born", "again", text.alias("text"))
    # withdrawn: an earlier message was regenerated after this one was born
    one = one.withColumn("blk", _block())
    per = one.groupBy("conv_id", "blk").agg(F.max("again").alias("again"))
    before = Window.partitionBy("conv_id").orderBy("blk").rowsBetween(Window.unboundedPreceding, -1)
    per = per.select(F.col("conv_id").alias("c"), F.col("blk").alias("b"), F.max("again").over(before).alias("earlier"))
    inside = Window.partitionBy("conv_id", "blk").orderBy("msg", "part").rowsBetween(Window.unboundedPreceding, -1)
    one = one.withColumn("near", F.max("again").over(inside)).join(per, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("blk") == F.col("b")))
    return one.where(F.coalesce(F.greatest("near", "earlier") <= F.col("born"), F.lit(True))).select("conv_id", "msg", "part", "role", "text")


def from_turns(turns: DataFrame) -> DataFrame:
    """The log of a table of turns: every row is one message event, in the order of (turn, role, text).

    Rows that share conversation and turn are different messages, told apart by ``part``.
    """
    same = Window.partitionBy("conv_id", "turn").orderBy(F.coalesce("role", F.lit("")), F.coalesce("text", F.lit("")))
    t = turns.select("conv_id", "turn", "role", "text").withColumn("part", F.row_number().over(same) - 1)
    return t.select("conv_id", F.col("turn").alias("seq"), F.col("turn").alias("msg"), "part", F.lit("message").alias("kind"), "role", "text")


def blocks(final: DataFrame) -> DataFrame:
    """Rendered blocks: conv_id, blk, n_turns, formatted, spans (start and length of each assistant text in the block).

    A block is the messages of one conversation with the same ``msg`` range, in order.
    """
    turn = F.concat(F.lit(OPEN), escape("role"), F.lit(MIDDLE), escape("text"), F.lit(CLOSE))
    lead = F.length(escape("role")) + len(OPEN) + len(MIDDLE)
    m = final.select("conv_id", _block().alias("blk"), "msg", "part", turn.alias("turn"), lead.alias("lead"), F.length(escape("text")).alias("size"), (F.col("role") == "assistant").alias("loss"))
    before = Window.partitionBy("conv_id", "blk").orderBy("msg", "part").rowsBetween(Window.unboundedPreceding, -1)
    m = m.withColumn("at", F.coalesce(F.sum(F.length("turn")).over(before), F.lit(0)) + F.col("lead"))
    one = m.groupBy("conv_id", "blk").agg(F.count("*").alias("n_turns"), F.array_sort(F.collect_list(F.struct("msg", "part", "turn", "at", "size", "loss"))).alias("t"))
    return one.select("conv_id", "blk", "n_turns", F.array_join(F.transform("t", lambda x: x["turn"]), "").alias("formatted"), F.transform(F.filter("t", lambda x: x["loss"]), lambda x: F.struct(x["at"].alias("start"), x["size"].cast("long").alias("length"))).alias("spans"))


def render(block: DataFrame) -> DataFrame:
    """One row for each conversation: conv_id, n_turns, formatted, spans in the whole text."""
    before = Window.partitionBy("conv_id").orderBy("blk").rowsBetween(Window.unboundedPreceding, -1)
    b = block.withColumn("at", F.coalesce(F.sum(F.length("formatted")).over(before), F.lit(0)))
    b = b.withColumn("spans", F.transform("spans", lambda s: F.struct((s["start"] + F.col("at")).alias("start"), s["length"].alias("length"))))
    one = b.groupBy("conv_id").agg(F.sum("n_turns").alias("n_turns"), F.array_sort(F.collect_list(F.struct("blk", "formatted", "spans"))).alias("b"))
    return one.select("conv_id", "n_turns", F.array_join(F.transform("b", lambda x: x["formatted"]), "").alias("formatted"), F.flatten(F.transform("b", lambda x: x["spans"])).alias("spans"))


def read_back(block: DataFrame) -> DataFrame:
    """What rendered blocks say, one row for each conversation: conv_id, n_turns, turns (role, \\n, text, \\n of each
    turn), loss (all text under the mask, unescaped), formatted_chars."""
    parts = F.split("formatted", CLOSE, -1)
    body = F.slice(parts, F.lit(1), F.size(parts) - 1)
    middle = "\\Q" + MIDDLE + "\\E"
    turns = F.transform(body, lambda p: F.concat(unescape(F.substr(F.split(p, middle, 2)[0], F.lit(len(OPEN) + 1))), F.lit("\n"), unescape(F.split(p, middle, 2)[1]), F.lit("\n")))
    loss = F.transform("spans", lambda s: unescape(F.substr(F.col("formatted"), (s["start"] + 1).cast("int"), s["length"].cast("int"))))
    b = block.select("conv_id", "blk", F.size(body).cast("long").alias("n"), F.array_join(turns, "").alias("turns"), F.array_join(loss, "").alias("loss"), F.length("formatted").cast("long").alias("chars"))
    one = b.groupBy("conv_id").agg(F.sum("n").alias("n_turns"), F.sum("chars").alias("formatted_chars"), F.array_sort(F.collect_list(F.struct("blk", "turns", "loss"))).alias("b"))
    return one.select("conv_id", "n_turns", F.array_join(F.transform("b", lambda x: x["turns"]), "").alias("turns"), F.array_join(F.transform("b", lambda x: x["loss"]), "").alias("loss"), "formatted_chars")
