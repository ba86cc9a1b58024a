"""Chat logs to training text: conversations are rebuilt from their events, then rendered with a loss mask.

A log row is an event: `message` opens a message with its text, `delta` appends a streamed piece to it, `edit` replaces
its text, `regenerate` starts it again. Events of a turn are sorted by sequence and folded; messages are then put in the
order of turns and rendered. All of it is DataFrame functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Marks of the template. Texts and roles never contain "<" or ">" once escaped, so no text can imitate a mark.
OPEN, AFTER_ROLE, CLOSE = "<turn ", ">\n", "</turn>\n"
KINDS = ("message", "regenerate", "edit", "delta")


def escape(text: Column) -> Column:
    """Reversible: a backslash becomes \\b, "<" becomes \\l and ">" becomes \\g."""
    for plain, code in (("\\", "\\b"), ("<", "\\l"), (">", "\\g")):
        text = F.replace(text, F.lit(plain), F.lit(code))
    return text


def unescape(text: Column) -> Column:
    for plain, code in ((">", "\\g"), ("<", "\\l"), ("\\", "\\b")):
        text = F.replace(text, F.lit(code), F.lit(plain))
    return text


def fold_messages(log: DataFrame) -> DataFrame:
    """Events (conv_id, turn, seq, kind, role, text) to messages (conv_id, turn, place, role, text).

    Within a turn, events are taken by seq, then kind in the order of KINDS, then role and text. A `message` opens a new
    message; without one the first event does. The text is that of the last message, edit or regenerate event followed by
    the deltas after it. The role is the last that is not null, else empty. A null text is empty, a null or unknown kind
    counts as `message`. Repeated `message` rows each give a message.
    """
    rank = F.coalesce(F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind")), F.lit(0)).cast("int")
    event = F.struct("seq", F.when(rank == 0, 1).otherwise(rank).alias("kind"), "role", F.coalesce("text", F.lit("")).alias("text"))
    turns = log.groupBy("conv_id", "turn").agg(F.sort_array(F.collect_list(event)).alias("ev"))
    starts = F.filter(F.sequence(F.lit(0), F.size("ev") - 1), lambda i: (i == 0) | (F.get("ev", i)["kind"] == 1))
    turns = turns.withColumn("starts", starts)

    def message(start: Column, k: Column) -> Column:
        return F.slice("ev", start + 1, F.coalesce(F.get("starts", k + 1), F.size("ev")) - start)

    turns = turns.select("conv_id", "turn", F.posexplode(F.transform("starts", message)).alias("place", "ev"))
    last = F.greatest(F.lit(0), F.array_max(F.transform("ev", lambda e, i: F.when(e["kind"] < 4, i).otherwise(-1))))
    text = F.array_join(F.transform(F.slice("ev", last + 1, F.size("ev")), lambda e: e["text"]), "")
    role = F.coalesce(F.element_at(F.filter(F.transform("ev", lambda e: e["role"]), lambda r: r.isNotNull()), -1), F.lit(""))
    role = F.when(F.exists("ev", lambda e: e["role"].isNotNull()), role).otherwise("")
    return turns.select("conv_id", "turn", "place", role.alias("role"), text.alias("text"))


def format_chats(log: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """Events to one row per conversation: conv_id, formatted, loss (array of start, end in code points, end exclusive).

    Turns go in ascending order, a null turn first. The loss mask covers the escaped texts of `loss_role`. Rows with a null
    conv_id form one conversation of their own. Extra columns are ignored; an empty log gives no rows.
    """
    messages = fold_messages(log.select("conv_id", "turn", "seq", "kind", "role", "text"))
    head = F.concat(F.lit(OPEN), escape(F.col("role")), F.lit(AFTER_ROLE))
    parts = messages.select("conv_id", "turn", "place", head.alias("head"), escape(F.col("text")).alias("body"), (F.col("role") == loss_role).alias("learn"))
    total = F.length("head") + F.length("body") + len(CLOSE)
    so_far = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "place")
    parts = parts.withColumn("end", F.sum(total.cast("long")).over(so_far) - len(CLOSE))
    piece = F.struct("turn", "place", F.concat("head", "body", F.lit(CLOSE)).alias("piece"), F.when(F.col("learn"), F.struct((F.col("end") - F.length("body")).alias("start"), "end")).alias("span"))
    chats = parts.groupBy("conv_id").agg(F.sort_array(F.collect_list(piece)).alias("p"))
    return chats.select("conv_id", F.array_join(F.transform("p", lambda x: x["piece"]), "").alias("formatted"), F.filter(F.transform("p", lambda x: x["span"]), lambda s: s.isNotNull()).alias("loss"))


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted conversation: array of (role, text), unescaped."""
    blocks = F.filter(F.split(formatted, CLOSE, -1), lambda b: b != "")
    parts = F.transform(blocks, lambda b: F.split(F.substr(b, F.lit(len(OPEN) + 1)), AFTER_ROLE, 2))
    return F.transform(parts, lambda p: F.struct(unescape(p[0]).alias("role"), unescape(p[1]).alias("text")))


def read_loss(formatted: Column, loss: Column) -> Column:
    """All text under the loss mask, unescaped."""
    return unescape(F.array_join(F.transform(loss, lambda s: F.substr(formatted, (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int"))), ""))


def as_log(conversations: DataFrame) -> DataFrame:
    """Whole messages (conv_id, turn, role, text) as an event log."""
    return conversations.select("conv_id", "turn", F.col("turn").alias("seq"), F.lit("message").alias("kind"), "role", "text")


def chat_digest(conversations: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, read back from the formatted text."""
    chats = format_chats(as_log(conversations))
    turns = F.array_join(F.transform(read_turns(F.col("formatted")), lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    back = chats.select("conv_id", F.size(read_turns(F.col("formatted"))).cast("long").alias("n_turns"), F.sha2(turns.cast("binary"), 256).alias("turns_sha256"), read_loss(F.col("formatted"), F.col("loss")).alias("learnt"), F.length("formatted").cast("long").alias("formatted_chars"))
    return back.select("conv_id", "n_turns", "turns_sha256", F.length("learnt").cast("long").alias("loss_chars"), F.sha2(F.col("learnt").cast("binary"), 256).alias("loss_sha256"), "formatted_chars")
