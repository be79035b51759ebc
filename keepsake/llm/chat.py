"""Chat formatting by event sourcing, with DataFrame functions only.

A conversation is a log of events; its state is what folding the log gives. Events are rows
``conv_id, seq, kind, message_id, role, text``:

``open``        starts a message with a text
``delta``       appends a streamed piece to it
``edit``        replaces what it says so far
``regenerate``  replaces it and discards every message opened between it and this event
``delete``      removes it, unless a later open, edit or regenerate brings it back

The log is partitioned by conversation and sorted by sequence number. Equal sequence numbers are taken
in the order of kind, role and text; a null text is empty, a null role is an empty role, null keys are
keys like any other; repeated rows are events of their own. A conversation none of whose messages is
left has no output row.

The output of a conversation is one string, so one task has to hold one conversation, as it has to hold
any single value; nothing else is gathered.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

TURN, END = "<|turn|>", "<|end|>\n"
#: Replaced in order when escaping, in the opposite order when reading. No marker can occur in an
#: escaped text, because none is left with its first character.
ESCAPES = (("&", "&amp;"), ("<", "&lt;"), ("[INST]", "&#91;INST]"), ("[/INST]", "&#91;/INST]"))
ROLE_ESCAPES = (*ESCAPES, ("\n", "&#10;"))
RESETS = ("open", "edit", "regenerate", "delete")


def escape(x: Column, pairs=ESCAPES) -> Column:
    for plain, safe in pairs:
        x = F.replace(x, F.lit(plain), F.lit(safe))
    return x


def unescape(x: Column, pairs=ESCAPES) -> Column:
    for plain, safe in reversed(pairs):
        x = F.replace(x, F.lit(safe), F.lit(plain))
    return x


def turn_events(turns: DataFrame) -> DataFrame:
    """The log of finished turns ``conv_id, turn, role, text``: every row opens a message. Turns with
    the same number are ordered by role and text, nulls first."""
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    seq = F.row_number().over(order).cast("long")
    return turns.select("conv_id", seq.alias("seq"), F.lit("open").alias("kind"), "role", "text").withColumn(
        "message_id", F.col("seq"))


def fold(events: DataFrame) -> DataFrame:
    """Final messages ``conv_id, position, role, text``, where position is the sequence number of the
    event that started the message."""
    event = F.struct("seq", "kind", "role", F.coalesce("text", F.lit("")).alias("text"))
    log = events.groupBy("conv_id", "message_id").agg(F.sort_array(F.collect_list(event)).alias("log"))
    last_reset = F.array_max(F.transform("log", lambda e, i: F.when(e["kind"].isin(*RESETS), i)))
    live = log.select(
        "conv_id", "message_id", F.col("log")[0]["seq"].alias("position"),
        F.coalesce(F.col("log")[0]["role"], F.lit("")).alias("role"),
        F.array_max(F.transform("log", lambda e: F.when(e["kind"] == "regenerate", e["seq"]))).alias("again"),
        F.coalesce(last_reset, F.lit(0)).alias("first"), "log")
    before = Window.partitionBy("conv_id").orderBy("position", "message_id").rowsBetween(
        Window.unboundedPreceding, -1)
    live = live.withColumn("cut", F.max("again").over(before))
    kept = live.filter((F.col("log")[F.col("first")]["kind"] != "delete")
                       & (F.col("cut").isNull() | (F.col("cut") < F.col("position"))))
    said = F.array_join(F.transform(F.slice("log", F.col("first") + 1, F.size("log")), lambda e: e["text"]), "")
    return kept.select("conv_id", "position", "message_id", "role", said.alias("text"))


def render(messages: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """One row per conversation: ``conv_id, n_turns, formatted, loss``.

    ``loss`` has a struct for each text the model is trained on: ``turn`` (its number from 0), and
    ``start`` and ``length`` in code points within that turn, marker included.
    """
    role, text = escape(F.col("role"), ROLE_ESCAPES), escape(F.col("text"))
    made = messages.select("conv_id", "position", "message_id", F.col("role") == loss_role, role, text).toDF(
        "conv_id", "position", "message_id", "is_loss", "role", "text")
    turn = F.struct("position", "message_id", F.concat(F.lit(TURN), "role", F.lit("\n"), "text", F.lit(END)).alias("block"),
                    "is_loss", (F.lit(len(TURN) + 1) + F.length("role")).alias("start"), F.length("text").alias("length"))
    whole = made.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    loss = F.transform(F.filter(F.transform("turns", lambda t, i: F.struct(
        t["is_loss"].alias("is_loss"), i.alias("turn"), t["start"].alias("start"), t["length"].alias("length"))),
        lambda t: t["is_loss"]), lambda t: F.struct(t["turn"], t["start"], t["length"]))
    return whole.select("conv_id", F.size("turns").cast("long").alias("n_turns"),
                        F.array_join(F.transform("turns", lambda t: t["block"]), "").alias("formatted"),
                        loss.alias("loss"))


def format_events(events: DataFrame, loss_role: str = "assistant") -> DataFrame:
    return render(fold(events), loss_role)


def blocks(formatted: Column) -> Column:
    """The turns of a formatted text, still escaped, without their first marker."""
    parts = F.split(formatted, r"<\|turn\|>")
    return F.slice(parts, F.lit(2), F.size(parts))


def read_turns(formatted: Column) -> Column:
    """Array of ``role, text`` read back from a formatted text."""
    def turn(block: Column) -> Column:
        role = F.substring_index(block, "\n", 1)
        text = F.substr(block, F.length(role) + 2, F.length(block) - F.length(role) - 1 - len(END))
        return F.struct(unescape(role, ROLE_ESCAPES).alias("role"), unescape(text).alias("text"))
    return F.transform(blocks(formatted), turn)


def read_loss(formatted: Column, loss: Column) -> Column:
    """The texts under the loss mask, unescaped, in order."""
    own = blocks(formatted)
    return F.transform(loss, lambda s: unescape(
        F.substr(F.get(own, s["turn"]), s["start"] + 1 - len(TURN), s["length"])))


def digest(formatted: DataFrame) -> DataFrame:
    """What a formatted conversation says, read back from it."""
    back = formatted.select("conv_id", "n_turns", F.length("formatted").cast("long").alias("formatted_chars"),
                            read_turns(F.col("formatted")).alias("turns"),
                            F.array_join(read_loss(F.col("formatted"), F.col("loss")), "").alias("under"))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"),
                       F.length("under").cast("long").alias("loss_chars"), F.sha2("under", 256).alias("loss_sha256"),
                       "formatted_chars")
