"""Chat formatting: an event log is folded into conversations, then rendered.

Only DataFrame functions are used. A log has one row per event::

    conv_id, seq, event, turn, role, text

* ``message`` starts a message of its turn (two of them are two messages);
* ``delta`` appends its text to the latest message of its turn;
* ``edit`` replaces that message's text;
* ``regenerate`` discards that message's text, and every event of a later turn
  that came before it.

Events are ordered by ``seq``; ties by event, role, text (nulls first), so
repeated rows are kept as they are. Null texts and roles are empty strings; a
null conversation id is a conversation of its own; an empty log gives no rows.
Only the named columns are read, so extra columns never clash.

A conversation is one output row; the folding windows and the final grouping
share one shuffle by conversation. Streamed deltas are joined per message before
the messages of a conversation meet.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    """What stands around roles and texts.

    Every control string is neutralised inside texts and roles by one more
    backslash before it (and before the backslashes it already has), so reading
    back is exact. The template keeps a blank between text and control strings:
    a text's own trailing backslash is then never taken for an escape.
    """

    open: str = "<s>[ROLE] "
    middle: str = " [/ROLE] "
    close: str = " </s>"
    controls: tuple[str, ...] = ("<s>", "</s>", "[ROLE]", "[/ROLE]", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
    loss_role: str = "assistant"

    @property
    def pattern(self) -> str:
        return "|".join(re.escape(c) for c in self.controls)

    def escape(self, text: Column) -> Column:
        return F.regexp_replace(text, rf"(?<!\\)(\\*+)({self.pattern})", r"\\$1$2")

    def unescape(self, text: Column) -> Column:
        return F.regexp_replace(text, rf"(?<!\\)\\(\\*+)({self.pattern})", "$1$2")


def fold_events(events: DataFrame) -> DataFrame:
    """One row per surviving message: conv_id, turn, msg_no, role, text."""
    e = events.select(
        "conv_id", "turn", "seq", F.coalesce("event", F.lit("message")).alias("event"), "role",
        F.coalesce("text", F.lit("")).alias("text"),
    )
    in_conv = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first())
    in_turn = Window.partitionBy("conv_id", "turn").orderBy(
        F.col("seq").asc_nulls_first(), "event", F.col("role").asc_nulls_first(), "text"
    )
    so_far = in_turn.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    of_message = Window.partitionBy("conv_id", "turn", "msg_no")
    regenerated = F.when(F.col("event") == "regenerate", F.col("seq"))
    # The latest regeneration of any earlier turn: all up to this turn's peers, less this turn's own.
    e = e.withColumn("turn_cut", F.max(regenerated).over(Window.partitionBy("conv_id", "turn")))
    e = e.withColumn("at_turn", F.dense_rank().over(in_conv))
    e = e.withColumn(
        "cut", F.max("turn_cut").over(Window.partitionBy("conv_id").orderBy("at_turn").rangeBetween(Window.unboundedPreceding, -1))
    )
    e = e.filter(F.col("cut").isNull() | F.coalesce(F.col("seq") >= F.col("cut"), F.lit(False)))
    e = e.withColumn("place", F.row_number().over(in_turn))
    e = e.withColumn("msg_no", F.sum((F.col("event") == "message").cast("long")).over(so_far))
    e = e.withColumn("reset", F.max(F.when(F.col("event") != "delta", F.col("place"))).over(of_message))
    e = e.withColumn("named", F.first("role", ignorenulls=True).over(of_message.orderBy("place").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    kept = e.filter(F.col("reset").isNull() | (F.col("place") >= F.col("reset")))
    pieces = F.array_sort(F.collect_list(F.struct("place", "text")))
    return kept.groupBy("conv_id", "turn", "msg_no").agg(
        F.coalesce(F.max("named"), F.lit("")).alias("role"),
        F.array_join(F.transform(pieces, lambda p: p["text"]), "").alias("text"),
    )


def format_chats(events: DataFrame, template: Template = Template()) -> DataFrame:
    """One row per conversation: conv_id, formatted, loss_spans (start and length in code points)."""
    t = template
    m = fold_events(events)
    m = m.withColumn("shown", t.escape(F.col("text")))
    m = m.withColumn("head", F.concat(F.lit(t.open), t.escape(F.col("role")), F.lit(t.middle)))
    m = m.withColumn("turn_text", F.concat("head", "shown", F.lit(t.close)))
    before = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "msg_no").rowsBetween(Window.unboundedPreceding, -1)
    m = m.withColumn("at", F.coalesce(F.sum(F.length("turn_text").cast("long")).over(before), F.lit(0)))
    span = F.struct((F.col("at") + F.length("head")).alias("start"), F.length("shown").cast("long").alias("length"))
    rows = F.sort_array(F.collect_list(F.struct("at", "turn_text")))
    spans = F.sort_array(F.collect_list(F.when(F.col("role") == t.loss_role, span)))
    return m.groupBy("conv_id").agg(
        F.array_join(F.transform(rows, lambda r: r["turn_text"]), "").alias("formatted"), spans.alias("loss_spans")
    )


def read_chats(formatted: DataFrame, template: Template = Template()) -> DataFrame:
    """Reads rendered conversations back: ``turns`` (role, text) and ``loss_text`` are added."""
    t = template

    def turn(piece: Column) -> Column:
        body = F.split(F.substring(piece, len(t.open) + 1, 2**31 - 1), re.escape(t.middle), 2)
        return F.struct(t.unescape(body[0]).alias("role"), t.unescape(body[1]).alias("text"))

    pieces = F.split("formatted", re.escape(t.close))
    pieces = F.slice(pieces, 1, F.greatest(F.size(pieces) - 1, F.lit(0)))
    loss = F.transform("loss_spans", lambda s: t.unescape(F.substring(F.col("formatted"), (s["start"] + 1).cast("int"), s["length"].cast("int"))))
    return formatted.withColumn("turns", F.transform(pieces, turn)).withColumn("loss_text", F.array_join(loss, ""))
