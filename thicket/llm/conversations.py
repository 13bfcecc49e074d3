"""Conversations rebuilt from message rows.

The rows are an event log. ``fold`` reduces all events of one message (creation, edits, a repeated
delivery, a deletion) to its final turn: the event with the highest version wins, and a message
whose last event is a deletion is gone. ``verdicts`` validates every conversation from counters
alone, so a conversation with a third of all rows is summed up in parallel and never gathered;
``transcript`` emits the turns of those that pass, numbered without a sort, since the
sequence numbers of a valid conversation are consecutive.

A conversation is dropped if any of these holds: no row or no visible content; a row without
sequence number; numbers other than n consecutive ones from 0 or 1, each once; a role that
names none of the four speakers; no visible user or no visible assistant row; an assistant row
without visible content; no visible assistant row after the last visible user row.

A null message id is a message of its own. Rows without a conversation id are stray and ignored. Versions
of one message differ (arrival numbers are unique). Null content is not visible.
Empty tables give no conversations. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from thicket.functions.keys import key

#: The names clients give the four speakers.
SPEAKERS = {
    "user": ("user", "human", "customer", "prompter", "enduser", "end_user", "me"),
    "assistant": ("assistant", "ai", "bot", "model", "chatbot", "gpt", "chatgpt", "llm", "agent", "assistant_message"),
    "system": ("system", "developer", "sys"),
    "tool": ("tool", "function", "tool_result", "tool_call", "tool_response", "function_call", "observation"),
}
CODES = {s: i for i, s in enumerate(SPEAKERS)}
#: White space, controls and characters of no width.
_BLANK = r"[\s\p{Z}\p{Cc}\x{00AD}\x{034F}\x{061C}\x{115F}\x{1160}\x{17B4}\x{17B5}\x{180B}-\x{180F}\x{200B}-\x{200F}\x{202A}-\x{202E}\x{2060}-\x{206F}\x{3164}\x{FE00}-\x{FE0F}\x{FEFF}\x{FFA0}]"
_VISIBLE = r"[^" + _BLANK[1:]
#: Turns in one array of ``transcript_parts``.
PART = 64


def speaker(role: Column) -> Column:
    """user, assistant, system, tool, or null for a role that names no speaker."""
    names = [F.lit(x) for s, all_ in SPEAKERS.items() for n in all_ for x in (n, s)]
    return F.create_map(*names)[F.lower(F.regexp_replace(role, r"^[\s\p{Z}]+|[\s\p{Z}]+$", ""))]


def visible(content: Column) -> Column:
    return F.coalesce(content.rlike(_VISIBLE), F.lit(False))


def fold(events: DataFrame, version: str = "ingest_seq", deleted: Column | None = None) -> DataFrame:
    """One row per message: conversation_id, seq, who (code or null), seen, and the version v of its last event.

    One hash aggregate: the state of a message is what its event with the highest version says, in
    numbers only, so repeated deliveries and edits are folded before the shuffle as well as after it.
    """
    who = F.coalesce(F.create_map(*[F.lit(x) for s, i in CODES.items() for x in (s, i)])[speaker(F.col("role"))], F.lit(7))
    gone = F.lit(False) if deleted is None else F.coalesce(deleted, F.lit(False))
    ident = F.coalesce(key("message_id"), F.concat(F.lit("\x00"), F.col(version).cast("string")))
    code = who + F.when(visible(F.col("content")), 8).otherwise(0) + F.when(gone, 16).otherwise(0)
    slim = events.select(ident.alias("mid"), F.col("conversation_id").cast("long").alias("c"), F.col("seq").cast("long").alias("s"), code.cast("int").alias("code"), F.col(version).cast("long").alias("v"))
    last = slim.groupBy("mid").agg(F.max("v").alias("v"), F.max_by("c", "v").alias("conversation_id"), F.max_by("s", "v").alias("seq"), F.max_by("code", "v").alias("code"))
    known = F.col("code").bitwiseAND(7)
    return last.where("conversation_id IS NOT NULL AND code < 16").select("conversation_id", "seq", F.when(known < 7, known).alias("who"), (F.col("code") >= 8).alias("seen"), "v")


def counters(turns: DataFrame) -> DataFrame:
    """One row per conversation with all the verdict needs.

    A first aggregate by (conversation, number) splits even the largest conversation over all tasks and
    makes repeated numbers countable without a distinct aggregate.
    """
    user = (F.col("who") == CODES["user"]) & F.col("seen")
    bot = (F.col("who") == CODES["assistant"]) & F.col("seen")
    per_seq = turns.groupBy("conversation_id", "seq").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.col("seen").cast("long")).alias("seen"),
        F.sum(F.col("who").isNull().cast("long")).alias("unknown"),
        F.sum(user.cast("long")).alias("users"),
        F.sum(bot.cast("long")).alias("bots"),
        F.sum(((F.col("who") == CODES["assistant"]) & ~F.col("seen")).cast("long")).alias("mute"),
    )
    return per_seq.groupBy("conversation_id").agg(
        F.sum("n").alias("n"), F.count("seq").alias("places"), F.sum(F.when(F.col("seq").isNull(), F.col("n")).otherwise(0)).alias("no_seq"),
        F.min("seq").alias("lo"), F.max("seq").alias("hi"), F.sum("seen").alias("seen"), F.sum("unknown").alias("unknown"),
        F.sum("users").alias("users"), F.sum("bots").alias("bots"), F.sum("mute").alias("mute"),
        F.max(F.when(F.col("users") > 0, F.col("seq"))).alias("last_user"), F.max(F.when(F.col("bots") > 0, F.col("seq"))).alias("last_bot"),
    )


#: Reasons to drop a conversation, over the columns of ``counters``.
REASONS = {
    "empty": "coalesce(n, 0) = 0 OR seen = 0",
    "no_seq": "no_seq > 0",
    "numbering": "places <> n OR lo NOT IN (0, 1) OR hi - lo + 1 <> n",
    "unknown_role": "unknown > 0",
    "no_user": "users = 0",
    "no_assistant": "bots = 0",
    "mute_assistant": "mute > 0",
    "unanswered": "last_bot IS NULL OR last_user IS NULL OR last_bot <= last_user",
}


def verdicts(messages: DataFrame, conversations: DataFrame, **options) -> DataFrame:
    """(conversation_id, n, lo, reasons) for every id of either table; reasons is empty for those to keep."""
    return verdicts_of(fold(messages, **options), messages, conversations)


def verdicts_of(turns: DataFrame, messages: DataFrame, conversations: DataFrame) -> DataFrame:
    """The same from folded turns."""
    per = counters(turns)
    listed = conversations.select("conversation_id").unionByName(messages.select("conversation_id")).where("conversation_id IS NOT NULL").distinct()
    why = F.array_compact(F.array(*[F.when(F.coalesce(F.expr(e), F.lit(False)), name) for name, e in REASONS.items()]))
    return listed.join(per, "conversation_id", "left").select("conversation_id", F.coalesce("n", F.lit(0)).alias("n"), "lo", why.alias("reasons"))


def transcript(messages: DataFrame, conversations: DataFrame, version: str = "ingest_seq", **options) -> DataFrame:
    """(conversation_id, part, turn, speaker, content) of the conversations that stay; turns count from 1.

    Everything is decided on rows without their text; the text then moves once, to the place of its
    (conversation, part), where it meets the surviving turns. A part holds ``PART`` sequence numbers, so a
    conversation of any length is spread.
    """
    turns = fold(messages, version=version, **options)
    kept = verdicts_of(turns, messages, conversations).where(F.size("reasons") == 0).select("conversation_id", "lo")
    names = F.element_at(F.array(*[F.lit(s) for s in SPEAKERS]), F.col("who") + 1)
    last = turns.join(kept, "conversation_id").select("conversation_id", _part(F.col("seq")).alias("part"), "v", (F.col("seq") - F.col("lo") + 1).alias("turn"), names.alias("speaker"))
    text = messages.where("conversation_id IS NOT NULL AND seq IS NOT NULL").select(
        F.col("conversation_id").cast("long").alias("conversation_id"), _part(F.col("seq").cast("long")).alias("part"), F.col(version).cast("long").alias("v"),
        F.struct(F.col("content").alias("content")).alias("t"), F.lit(None).cast("struct<turn:bigint,speaker:string>").alias("w"),
    )
    named = last.select("conversation_id", "part", "v", F.lit(None).cast("struct<content:string>").alias("t"), F.struct("turn", "speaker").alias("w"))
    # both sides in one placement by (conversation, part), which the grouping by version and any later one by part reuse
    both = text.unionByName(named).repartition("conversation_id", "part").groupBy("conversation_id", "part", "v")
    met = both.agg(F.first("t", ignorenulls=True).alias("t"), F.first("w", ignorenulls=True).alias("w")).where("t IS NOT NULL AND w IS NOT NULL")
    return met.select("conversation_id", "part", "w.turn", "w.speaker", "t.content")


def _part(seq: Column) -> Column:
    return F.floor(seq / PART)


def transcript_parts(turns: DataFrame) -> DataFrame:
    """Turns gathered in order into arrays of at most ``PART``: (conversation_id, part, turns)."""
    item = F.struct("turn", "speaker", "content")
    return turns.groupBy("conversation_id", "part").agg(F.array_sort(F.collect_list(item)).alias("turns"))
