"""Chat formatting with Spark expressions: turns are collected, sorted, merged where the role stays, and joined.

A message is ``### role: text</turn>`` and a line feed. Adjacent turns of one role form one message, their texts
parted by ``</part>``. Inside a text or role the control strings ``###``, ``</turn>`` and ``</part>``, the colon and space and the backslash
are written ``\\h``, ``\\t``, ``\\p``, ``\\c`` (in roles alone) and ``\\b``, so no text can look like a mark and reading back gives exactly the turns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Control strings and what stands for them in a text; the backslash is written first and read last.
BACKSLASH, ESCAPES = ("\\", "\\b"), (("###", "\\h"), ("</turn>", "\\t"), ("</part>", "\\p"))
END, PART = "</turn>\n", "</part>"


def escape(text: Column) -> Column:
    for raw, written in (BACKSLASH, *ESCAPES):
        text = F.replace(text, F.lit(raw), F.lit(written))
    return text


def unescape(text: Column) -> Column:
    for raw, written in (*ESCAPES, BACKSLASH):
        text = F.replace(text, F.lit(written), F.lit(raw))
    return text


def merged(turns: Column) -> Column:
    """Messages (role, parts): turns (role, text) in order, those of one role in a row together."""
    def starts(t: Column, i: Column) -> Column:
        return (i == 0) | ~F.element_at(turns, F.greatest(i, F.lit(1)))["role"].eqNullSafe(t["role"])

    first = F.filter(F.transform(turns, lambda t, i: F.when(starts(t, i), i)), lambda i: i.isNotNull())
    last = F.concat(F.slice(first, 2, F.size(first)), F.array(F.size(turns)))
    return F.zip_with(first, last, lambda a, b: F.struct(F.element_at(turns, a + 1)["role"].alias("role"), F.transform(F.slice(turns, a + 1, b - a), lambda t: t["text"]).alias("parts")))


def format_chats(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, formatted): one text for each conversation.

    Turns are sorted by number (nulls first), then role and text; repeated rows are repeated turns. Null texts and roles
    count as empty. A null conv_id is a conversation of its own. Other columns don't matter. An empty table gives an
    empty result. A conversation is one value of the result, so all of its turns meet in one row; what is shuffled
    before is collected by task.
    """
    rows = turns.select(F.col(id_col).cast("long").alias("conv_id"), F.struct(
        F.col(turn_col).cast("long").alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).alias("t"))
    collected = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns"))
    message = lambda m: F.concat(F.lit("### "), F.replace(escape(m["role"]), F.lit(": "), F.lit("\\c")), F.lit(": "), F.array_join(F.transform(m["parts"], escape), PART), F.lit(END))
    return collected.select("conv_id", merged(F.col("turns")).alias("m")).select("conv_id", F.array_join(F.transform("m", message), "").alias("formatted"))


def parse_chats(chats: DataFrame) -> DataFrame:
    """(conv_id, formatted, turns array of (role, text)): what ``format_chats`` was given, read from its output alone."""
    lines = F.slice(F.split("formatted", END, -1), 1, F.size(F.split("formatted", END, -1)) - 1)
    role = lambda x: unescape(F.replace(F.substring_index(F.substring(x, 5, F.char_length(x)), ": ", 1), F.lit("\\c"), F.lit(": ")))
    body = lambda x: F.substring(x, F.instr(x, ": ") + 2, F.char_length(x))
    turns = F.flatten(F.transform(lines, lambda x: F.transform(F.split(body(x), PART, -1), lambda t: F.struct(role(x).alias("role"), unescape(t).alias("text")))))
    return chats.select("conv_id", "formatted", turns.alias("turns"))


def loss_text(turns: Column, role: str = "assistant") -> Column:
    """All text under the loss mask: each assistant text once, in order."""
    return F.array_join(F.transform(F.filter(turns, lambda t: t["role"] == role), lambda t: t["text"]), "")


def digest(parsed: DataFrame) -> DataFrame:
    """Numbers and digests of the turns read back."""
    listed = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return parsed.withColumn("loss", loss_text(F.col("turns"))).select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(listed.cast("binary"), 256).alias("turns_sha256"),
        F.char_length("loss").cast("long").alias("loss_chars"), F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"))
