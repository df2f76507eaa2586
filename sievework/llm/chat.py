r"""Chat formatting with a grammar round trip, in DataFrame functions only.

Grammar of the output::

    conversation := turn*
    turn         := "### " name ": " body "</turn>\n"
    name         := "System" | "User" | "Assistant" | "Tool" | "role=" HEX*
    body         := any text without "### " and "</turn>", with escapes

Escape: a control string inside a text gets one backslash more inside it: ``<\*/turn>`` becomes ``<\\*/turn>`` and ``#\*## `` becomes
``#\\*## ``. The reader takes one away. Other backslashes mean nothing, so that code and formulas stay as they are. As each
occurrence only counts its backslashes up by one, the map is one to one for every text.

Each text is rendered as it is first; the deterministic reader parses that rendering, and only where the turn it recovers isn't
identical to the source the escaped rendering is taken. The whole conversation is then parsed once more and compared.

Defined cases: a null text or role counts as empty; turns are ordered by turn (null first), then role, then text, so that ties and
repeated rows have one order; a null conv_id is a conversation of its own; an empty table gives no rows. A conversation is one
training example and so one value: its turns meet in one row, however many they are. A very long text is read by the same expressions, in time in proportion to it. Other columns don't matter, whatever their
names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Names shown for the usual roles; any other role is shown in hex.
NAMES = {"system": "System", "user": "User", "assistant": "Assistant", "tool": "Tool"}
END = "</turn>\n"
HEADER = r"(?s)^### (System|User|Assistant|Tool|role=[0-9A-F]*): .*$"


def escaped(text: Column) -> Column:
    text = F.regexp_replace(text, r"<(\\*)/turn>", r"<$1\\/turn>")
    return F.regexp_replace(text, r"#(\\*)## ", r"#$1\\## ")


def unescaped(body: Column) -> Column:
    body = F.regexp_replace(body, r"<\\(\\*)/turn>", r"<$1/turn>")
    return F.regexp_replace(body, r"#\\(\\*)## ", r"#$1## ")


def header(role: Column) -> Column:
    name = F.concat(F.lit("role="), F.hex(F.encode(role, "UTF-8")))
    for k, v in NAMES.items():
        name = F.when(role == k, v).otherwise(name)
    return F.concat(F.lit("### "), name, F.lit(": "))


def _turn(piece: Column) -> Column:
    """What one piece before an end mark says: role, text and whether it keeps to the grammar."""
    name = F.regexp_extract(piece, HEADER, 1)
    role = F.decode(F.unhex(F.substring(name, 6, 1 << 30)), "UTF-8")
    for k, v in NAMES.items():
        role = F.when(name == v, k).otherwise(role)
    body = F.substring(piece, F.length(name) + 7, F.length(piece))
    return F.struct(role.alias("role"), unescaped(body).alias("text"), ((name != "") & ~F.contains(body, F.lit("### ")) & ~F.contains(body, F.lit("</turn>"))).alias("ok"))


def parsed(formatted: Column) -> Column:
    """The reader: an array of (role, text, ok). Text after the last end mark is a turn that is not ok."""
    pieces = F.split(formatted, r"\Q" + END + r"\E", -1)
    turns = F.transform(F.slice(pieces, 1, F.size(pieces) - 1), _turn)
    rest = F.element_at(pieces, -1)
    bad = F.struct(F.lit("").alias("role"), rest.alias("text"), F.lit(False).alias("ok"))
    return F.when(rest == "", turns).otherwise(F.concat(turns, F.array(bad)))


def _same(turns: Column, source: Column) -> Column:
    return turns == F.transform(source, lambda s: F.struct(s["role"].alias("role"), s["text"].alias("text"), F.lit(True).alias("ok")))


def format_chats(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row per conversation: conv_id, formatted, segments (in order; text and whether the loss counts it; joined they are formatted),
    n_escaped (turns that needed escapes) and round_trip (the reader recovers the source's turns). The loss mask covers the bodies of
    assistant turns. Other columns of turns are ignored."""
    rows = turns.select(
        F.col(conv_id).alias("conv_id"), F.col(turn).alias("turn"),
        F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"),
    )
    rows = rows.withColumn("head", header(F.col("role")))
    rows = rows.withColumn("plain_ok", _same(parsed(F.concat("head", "text", F.lit(END))), F.array(F.struct("role", "text"))))
    rows = rows.withColumn("body", F.when(F.col("plain_ok"), F.col("text")).otherwise(escaped(F.col("text"))))
    one = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text", "head", "body", "plain_ok"))).alias("turns"))
    segments = F.flatten(F.transform("turns", lambda t: F.array(
        F.struct(t["head"].alias("text"), F.lit(False).alias("loss")),
        F.struct(t["body"].alias("text"), (t["role"] == "assistant").alias("loss")),
        F.struct(F.lit(END).alias("text"), F.lit(False).alias("loss")),
    )))
    one = one.withColumn("segments", segments).withColumn("formatted", F.array_join(F.transform("segments", lambda s: s["text"]), ""))
    return one.select(
        "conv_id", "formatted", "segments",
        F.size(F.filter("turns", lambda t: ~t["plain_ok"])).cast("long").alias("n_escaped"),
        _same(parsed(F.col("formatted")), F.col("turns")).alias("round_trip"),
    )


def read_chats(formatted: DataFrame) -> DataFrame:
    """What the output of format_chats says, read back from it: conv_id, turns (role, text, ok), loss_text (all text under the mask, unescaped) and the other columns."""
    loss = F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: unescaped(s["text"]))
    return formatted.withColumns({"turns": parsed(F.col("formatted")), "loss_text": F.array_join(loss, "")})
