"""Chat formatting from event logs, with DataFrame functions alone.

A log holds events of a conversation, in sequence: ``message`` opens a message with a role and a text; ``delta``
appends text to it; ``edit`` replaces its text so far; ``regenerate`` empties it, for the deltas of another attempt.
The log is dealt out by conversation once; windows over it then find, for each message, the last event that reset its
text, and what follows that is joined. Messages are rendered in order by a template:

    <|turn|>ROLE
    TEXT<|end|>

Control strings in roles and texts are broken up by a backslash after their first character, and backslashes are
doubled; a line feed in a role gets a backslash before it. So the marks stand in the output only where the template
put them, and every text is read back exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import partitions

# The control strings that are escaped, the template's own and those of other common templates.
CONTROL = ("<|", "|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")

OPEN, CLOSE = "<|turn|>", "<|end|>\n"
TRAINED = "assistant"
_CONTROL = r"<(?=\||s>|/s>|<SYS>>|</SYS>>)|\|(?=>)|\[(?=INST\]|/INST\])"
_HEAD = r"(?s)^([^\\\n]*+(?:\\.[^\\\n]*+)*+)\n(.*)$"


def escape(text: Column) -> Column:
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), f"({_CONTROL})", r"$1\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def messages(events: DataFrame) -> DataFrame:
    """(conv_id, message, role, text): the final messages of ``events`` (conv_id, message, seq, kind, role, text).

    ``message`` orders a conversation's messages; role is that of the message's first event that has one. Null roles
    and texts count as empty. Events before a message's last reset (``message``, ``edit`` or ``regenerate``) leave no
    text. Ties of seq go by kind and text. A conversation's rows stay in one partition from here on.
    """
    n = partitions(events.sparkSession)
    rows = events.repartition(n, "conv_id")
    back = Window.partitionBy("conv_id", "message").orderBy(F.desc("seq"), F.desc("kind"), F.desc("text"))
    resets = F.sum(F.col("kind").isin("message", "edit", "regenerate").cast("int")).over(back.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("later", F.coalesce(resets, F.lit(0)))
    part = F.when((F.col("later") == 0) & (F.col("kind") != "regenerate"), F.coalesce("text", F.lit("")))
    said = F.array_sort(F.collect_list(F.when(part.isNotNull(), F.struct("seq", "kind", part.alias("text")))))
    role = F.min(F.when(F.col("role").isNotNull(), F.struct("seq", "role"))).getField("role")
    return rows.groupBy("conv_id", "message").agg(F.coalesce(role, F.lit("")).alias("role"), F.array_join(F.transform(said, lambda x: x["text"]), "").alias("text"))


def render(msgs: DataFrame) -> DataFrame:
    """(conv_id, formatted, loss): one row per conversation of ``msgs`` (conv_id, message, role, text).

    formatted is all messages by the template; loss lists the spans (turn, start, end) that are trained on, the texts
    of the assistant's messages, in code points of that turn's part of formatted, which begins with OPEN.
    """
    role = F.replace(escape(F.coalesce("role", F.lit(""))), F.lit("\n"), F.lit("\\\n"))
    text = escape(F.coalesce("text", F.lit("")))
    head = F.concat(F.lit(OPEN), role, F.lit("\n"))
    turn = F.struct("message", head.alias("head"), text.alias("text"), (F.coalesce("role", F.lit("")) == TRAINED).alias("trained"))
    turns = msgs.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    formatted = F.array_join(F.transform("turns", lambda t: F.concat(t["head"], t["text"], F.lit(CLOSE))), "")
    span = F.transform("turns", lambda t, i: F.struct(i.alias("turn"), F.length(t["head"]).alias("start"), (F.length(t["head"]) + F.length(t["text"])).alias("end"), t["trained"].alias("trained")))
    spans = F.transform(F.filter(span, lambda s: s["trained"]), lambda s: F.struct(s["turn"].alias("turn"), s["start"].alias("start"), s["end"].alias("end")))
    return turns.select("conv_id", formatted.alias("formatted"), spans.alias("loss"))


def pieces(formatted: Column) -> Column:
    """The turns' parts of a formatted conversation."""
    return F.filter(F.split(formatted, r"(?=<\|turn\|>)"), lambda p: p != "")


def read_back(formatted: DataFrame) -> DataFrame:
    """(conv_id, turns, trained): roles and texts, and the texts under the loss mask, read from ``render``'s output alone."""
    body = F.transform(pieces(F.col("formatted")), lambda p: F.substring(p, len(OPEN) + 1, F.length(p) - len(OPEN) - len(CLOSE)))
    turns = F.transform(body, lambda b: F.struct(unescape(F.regexp_extract(b, _HEAD, 1)).alias("role"), unescape(F.regexp_extract(b, _HEAD, 2)).alias("text")))
    parts = pieces(F.col("formatted"))
    trained = F.transform("loss", lambda s: unescape(F.substring(F.element_at(F.col("parts"), s["turn"] + 1), s["start"] + 1, s["end"] - s["start"])))
    return formatted.withColumn("parts", parts).select("conv_id", "formatted", turns.alias("turns"), trained.alias("trained"))


def from_turns(rows: DataFrame) -> DataFrame:
    """Events of a table of whole turns (conv_id, turn, role, text): each row is a message; ties of turn go by role and text."""
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    message = F.row_number().over(order).cast("long")
    rows = rows.select("conv_id", F.col("turn"), "role", "text").repartition(partitions(rows.sparkSession), "conv_id")
    return rows.select("conv_id", message.alias("message"), message.alias("seq"), F.lit("message").alias("kind"), "role", "text")


def report(rows: DataFrame) -> DataFrame:
    """What each conversation of ``rows`` (conv_id, turn, role, text) reads like after formatting: digests of turns and of the loss text.

    Null roles and texts count as empty; a null conv_id is a conversation of its own; repeated rows are turns of
    their own. One conversation's text must fit in a row. Other columns are ignored.
    """
    back = read_back(render(messages(from_turns(rows))))
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    said = F.array_join("trained", "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(told, 256).alias("turns_sha256"),
        F.length(said).cast("long").alias("loss_chars"),
        F.sha2(said, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
