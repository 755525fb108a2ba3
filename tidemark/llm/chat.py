"""Prefix-target expansion of conversations into training examples, with column functions only.

Every assistant turn becomes one example: all turns before it as context, then the reply, which
alone is trainable. Turns after the last reply form one more example with nothing trainable, so the
examples of a conversation hold all of its turns.

Template of a turn: `### role`, line feed, text, `</turn>`, line feed. Inside roles and texts the
backslash, `<`, `#` (and in roles the line feed) are written `\\\\`, `\\l`, `\\h`, `\\n`, so neither marker can
appear there and reading back is a plain split.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed values of the template.
HEAD, END, REPLY_ROLE = "### ", "</turn>\n", "assistant"


def _swap(text: Column, old: str, new: str) -> Column:
    return F.replace(text, F.lit(old), F.lit(new))


def escape(text: Column) -> Column:
    return _swap(_swap(_swap(text, "\\", "\\\\"), "<", "\\l"), "#", "\\h")


def unescape(text: Column) -> Column:
    """Inverse of escape: `<` and `#` are free in escaped text and hold the first two results meanwhile."""
    marked = _swap(_swap(_swap(text, "\\\\", "<"), "\\l", "#"), "\\h", "\\")
    return F.translate(marked, "<#\\", "\\<#")


def escape_role(role: Column) -> Column:
    return _swap(escape(role), "\n", "\\n")


def unescape_role(role: Column) -> Column:
    marked = _swap(_swap(_swap(_swap(role, "\\\\", "<"), "\\l", "#"), "\\n", "\n"), "\\h", "\\")
    return F.translate(marked, "<#\\", "\\<#")


def prefix_examples(conversations: DataFrame) -> DataFrame:
    """One row per assistant turn (and one for turns after the last): conv_id, example_no, n_turns, text,
    loss_start, loss_chars.

    The loss mask covers loss_chars code points of text from loss_start on (0-based): the escaped
    reply, without markers. Turns are ordered by (turn, role, text), nulls first; repeated rows stay.
    A null role or text counts as empty, a null conv_id is a conversation of its own, other columns
    are not read. A conversation is one row while its examples are made, so a task holds one
    conversation and one example at a time.
    """
    turns = conversations.select(
        F.col("conv_id"), F.col("turn").alias("t"), F.coalesce("role", F.lit("")).alias("r"),
        F.coalesce("text", F.lit("")).alias("x"))
    whole = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("t", "r", "x"))).alias("c"))
    whole = whole.select(
        "conv_id",
        F.transform("c", lambda c: F.concat(F.lit(HEAD), escape_role(c["r"]), F.lit("\n"))).alias("heads"),
        F.transform("c", lambda c: escape(c["x"])).alias("bodies"),
        F.transform("c", lambda c: c["r"] == REPLY_ROLE).alias("replies"))
    n = F.size("heads")
    targets = F.filter(
        F.sequence(F.lit(1), n), lambda k: F.element_at("replies", k) | (k == n))
    rows = whole.select(
        "conv_id", "heads", "bodies", "replies", F.posexplode(targets).alias("example_no", "k"))
    head, body = F.element_at("heads", F.col("k")), F.element_at("bodies", F.col("k"))
    before = F.array_join(
        F.zip_with(F.slice("heads", 1, F.col("k") - 1), F.slice("bodies", 1, F.col("k") - 1),
                   lambda h, b: F.concat(h, b, F.lit(END))), "")
    rows = rows.select(
        "conv_id", F.col("example_no").cast("long").alias("example_no"), F.col("k").cast("long").alias("n_turns"),
        F.element_at("replies", F.col("k")).alias("is_reply"), before.alias("before"), head.alias("head"),
        body.alias("body"))
    return rows.select(
        "conv_id", "example_no", "n_turns",
        F.concat("before", "head", "body", F.lit(END)).alias("text"),
        (F.length("before") + F.length("head")).cast("long").alias("loss_start"),
        F.when(F.col("is_reply"), F.length("body")).otherwise(0).cast("long").alias("loss_chars"))


def read_turns(text: Column) -> Column:
    """array<struct<role, text>> read back from an example's text."""
    pieces = F.slice(F.split(text, END, -1), 1, F.size(F.split(text, END, -1)) - 1)
    return F.transform(pieces, lambda p: F.struct(
        unescape_role(F.substring(F.substring_index(p, "\n", 1), len(HEAD) + 1, 1 << 30)).alias("role"),
        unescape(F.substring(p, F.instr(p, "\n") + 1, F.length(p))).alias("text")))


def expansion_digests(examples: DataFrame) -> DataFrame:
    """One row per conversation, all of it read back from the examples' texts and masks.

    conv_id, n_turns, turns_sha256 (role, line feed, text, line feed per turn), loss_chars and
    loss_sha256 of the trainable text, unescaped, formatted_chars over all examples, n_examples.
    """
    loss = unescape(F.substring(F.col("text"), F.col("loss_start") + 1, F.col("loss_chars")))
    last = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.col("example_no").desc()))
    rows = examples.select(
        "conv_id", "example_no", loss.alias("loss"), F.length("text").cast("long").alias("chars"),
        F.when(last == 1, F.col("text")).alias("whole"))
    per = rows.groupBy("conv_id").agg(
        F.element_at(F.collect_list("whole"), 1).alias("whole"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("example_no", "loss"))), lambda e: e["loss"]),
                     "").alias("loss"),
        F.sum("chars").alias("formatted_chars"), F.count("*").alias("n_examples"))
    per = per.withColumn("turns", read_turns(F.col("whole")))
    log = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return per.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.encode(log, "UTF-8"), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.encode("loss", "UTF-8"), 256).alias("loss_sha256"), "formatted_chars", "n_examples")
