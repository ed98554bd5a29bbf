"""Chat formatting with Spark expressions only.

Template of a conversation: its turns in order, adjacent turns of one role
merged into a block::

    <turn assistant>
    first text<part>second text</turn>

Texts and roles are escaped first, a backslash as ``\\b`` and ``<`` as ``\\l``
(in roles ``>`` as ``\\g`` and a line feed as ``\\n`` too). So ``<`` in the
output always begins a marker, every backslash begins a code, and two plain
replacements, ``\\l`` first, undo it. Merged texts stay apart by ``<part>``, so
single turns can be read back. The loss mask covers the texts of assistant
turns, without markers.

Method: turn structs are collected per conversation and sorted; the places where
the role changes cut them into blocks, whose texts an array aggregation merges,
and the blocks are concatenated, in time linear in the turns but for the sort. ``read_back`` parses a
formatted string into turns again.

Scale: one shuffle by conversation. A formatted conversation is one string, so
its size (2 GB at most, as any string of Spark) bounds a task's memory; a
conversation is never spread over rows.

Nulls and odd rows: a null text is empty, a null role is the empty role. Turns
sort by (turn, role, text), null turns first; repeated rows are turns of their
own. A null conv_id is a conversation. An empty table gives no rows. Extra
columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LOSS_ROLES = ("assistant",)


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\b")), F.lit("<"), F.lit("\\l"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\l"), F.lit("<")), F.lit("\\b"), F.lit("\\"))


def _escape_role(role: Column) -> Column:
    return F.replace(F.replace(escape(role), F.lit(">"), F.lit("\\g")), F.lit("\n"), F.lit("\\n"))


def _unescape_role(role: Column) -> Column:
    return unescape(F.replace(F.replace(role, F.lit("\\n"), F.lit("\n")), F.lit("\\g"), F.lit(">")))


def format_chats(conversations: DataFrame) -> DataFrame:
    """(conv_id, formatted) of each conversation."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    role = F.coalesce(F.col("role").cast("string"), F.lit(""))
    rows = conversations.select("conv_id", F.struct(F.col("turn").alias("turn"), role.alias("role"), text.alias("text")).alias("t"))
    ordered = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    turns = ordered.select("conv_id", F.transform("turns", lambda t: F.struct(_escape_role(t["role"]).alias("role"), escape(t["text"]).alias("text"))).alias("turns"))
    # Where blocks begin; a column of its own, so that it isn't computed for each block again.
    opens = lambda i: (i == 0) | (F.get("turns", i)["role"] != F.get("turns", i - 1)["role"])
    opened = turns.select("conv_id", "turns", F.filter(F.sequence(F.lit(0), F.size("turns") - 1), opens).alias("starts"))

    def block(start: Column, k: Column) -> Column:
        own = F.slice("turns", start + 1, F.coalesce(F.get("starts", k + 1), F.size("turns")) - start)
        merged = F.array_join(F.transform(own, lambda t: t["text"]), "<part>")
        return F.concat(F.lit("<turn "), F.get("turns", start)["role"], F.lit(">\n"), merged, F.lit("</turn>\n"))

    return opened.select("conv_id", F.array_join(F.transform("starts", block), "").alias("formatted"))


def read_back(formatted: Column) -> Column:
    """The turns (role, text) of a formatted conversation, unescaped."""
    blocks = F.filter(F.split(formatted, "</turn>\n"), lambda b: b != "")

    def turns(b: Column) -> Column:
        role = F.substring_index(F.substr(b, F.lit(len("<turn ") + 1)), ">\n", 1)
        body = F.substr(b, F.char_length(role) + F.lit(len("<turn ") + len(">\n") + 1))
        return F.transform(F.split(body, "<part>"), lambda t: F.struct(_unescape_role(role).alias("role"), unescape(t).alias("text")))

    return F.flatten(F.transform(blocks, turns))


def chat_digests(formatted: DataFrame, loss_roles: tuple[str, ...] = LOSS_ROLES) -> DataFrame:
    """Digests of what :func:`format_chats` wrote, read back from its strings."""
    turns = formatted.select("conv_id", "formatted", read_back(F.col("formatted")).alias("turns"))
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join(F.transform(F.filter("turns", lambda t: t["role"].isin(*loss_roles)), lambda t: t["text"]), "")
    read = turns.select("conv_id", F.size("turns").cast("long").alias("n_turns"), told.alias("told"), loss.alias("loss"), F.char_length("formatted").cast("long").alias("formatted_chars"))
    return read.select("conv_id", "n_turns", F.sha2("told", 256).alias("turns_sha256"), F.char_length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars")
