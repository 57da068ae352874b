"""Chat formatting by event-sourced reconstruction, with DataFrame functions only.

A log holds events (conv_id, turn, seq, kind, role, text):

* ``message``     a whole message,
* ``delta``       text that continues the message before it in its turn, or starts one,
* ``edit``        replaces the turn's message; what came earlier in this turn or a later one is void,
* ``regenerate``  empties the turn's message, to be streamed anew; it voids the same.

An event is void when a later ``edit`` or ``regenerate`` (by ``seq``) stands in its own turn or an
earlier one, which a running maximum over the turns tells. What is left is folded into messages,
messages into one string per conversation. Log and messages are partitioned by conversation once;
both windows and both aggregations use that one shuffle. A conversation is one output row, so it
has to fit one; conversations are many, and none of them shares a key with another.

Template: ``<turn>`` role ``<text>`` text ``</turn>`` and a line feed. In roles and texts a backslash
is doubled and a control string gets a backslash after its ``<``; dropping the backslash before any
character undoes both. The loss mask is a list of spans (code points) over the formatted string.

Nulls: null texts and roles are empty, a null turn comes first, a null seq counts as 0, null
conv_ids form one conversation. An event of any other kind, or of none, counts as a message, before
those of its turn and seq that are known. Very long texts make very long rows. Events equal in turn, seq and kind go by role, then text; repeated
events all count. An empty log gives no rows. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OPEN, BODY, CLOSE = "<turn>", "<text>", "</turn>\n"
KINDS = ("message", "edit", "regenerate", "delta")


def escape(text: Column) -> Column:
    doubled = F.replace(F.coalesce(text, F.lit("")), F.lit("\\"), F.lit("\\\\"))
    return F.regexp_replace(doubled, r"<(?=(?:/?turn|text)>)", r"<\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def fold_events(events: DataFrame) -> DataFrame:
    """conv_id, number, role, text: the final messages of each conversation, numbered in order."""
    kind_rank = F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.coalesce("kind", F.lit("message"))).cast("int")
    log = events.select("conv_id", "turn", F.coalesce("seq", F.lit(0)).cast("long").alias("seq"), kind_rank.alias("kind"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    reset = F.when(F.col("kind").isin(2, 3), F.col("seq"))
    upto_turn = Window.partitionBy("conv_id").orderBy("turn").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    live = log.withColumn("reset", F.max(reset).over(upto_turn)).filter(F.col("reset").isNull() | (F.col("seq") >= F.col("reset")))
    order = Window.partitionBy("conv_id").orderBy("turn", "seq", "kind", "role", "text")
    starts = (F.col("kind") != 4) | F.coalesce(~F.lag("turn").over(order).eqNullSafe(F.col("turn")), F.lit(True)) | (F.row_number().over(order) == 1)
    placed = live.withColumn("place", F.row_number().over(order)).withColumn("starts", starts.cast("int"))
    numbered = placed.withColumn("number", F.sum("starts").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    parts = F.transform(F.array_sort(F.collect_list(F.struct("place", "text"))), lambda x: x["text"])
    role = F.coalesce(F.min(F.when(F.col("role") != "", F.struct("place", "role")))["role"], F.lit(""))
    return numbered.groupBy("conv_id", "number").agg(role.alias("role"), F.array_join(parts, "").alias("text"))


def format_chats(events: DataFrame, trained_role: str = "assistant") -> DataFrame:
    """conv_id, n_messages, formatted and loss_spans (start and length of each trained text) of each conversation."""
    messages = fold_events(events).withColumns({"_role": escape(F.col("role")), "_text": escape(F.col("text"))})
    messages = messages.withColumn("_piece", F.concat(F.lit(OPEN), "_role", F.lit(BODY), "_text", F.lit(CLOSE)))
    before = Window.partitionBy("conv_id").orderBy("number").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.length("_piece")).over(before), F.lit(0)) + F.length("_role") + len(OPEN) + len(BODY)
    span = F.when(F.col("role") == trained_role, F.struct(start.cast("int").alias("start"), F.length("_text").alias("length")))
    rows = messages.withColumn("_span", span)
    listed = F.array_sort(F.collect_list(F.struct("number", "_piece", "_span")))
    chats = rows.groupBy("conv_id").agg(listed.alias("_all"))
    spans = F.filter(F.transform("_all", lambda x: x["_span"]), lambda x: x.isNotNull())
    return chats.select("conv_id", F.size("_all").cast("long").alias("n_messages"), F.array_join(F.transform("_all", lambda x: x["_piece"]), "").alias("formatted"), spans.alias("loss_spans"))


def parse_turns(formatted: Column) -> Column:
    """The messages of a formatted conversation: array of (role, text)."""
    pieces = F.split(formatted, CLOSE)

    def turn(piece: Column) -> Column:
        halves = F.split(F.substr(piece, F.lit(len(OPEN) + 1)), BODY)
        return F.struct(unescape(halves[0]).alias("role"), unescape(halves[1]).alias("text"))

    return F.transform(F.slice(pieces, F.lit(1), F.size(pieces) - 1), turn)


def masked_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substr(formatted, s["start"] + 1, s["length"]))), "")


def conversation_events(conversations: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text) as a log of whole messages."""
    return conversations.select("conv_id", "turn", F.lit(0).alias("seq"), F.lit("message").alias("kind"), "role", "text")
