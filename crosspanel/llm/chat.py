"""Chat formatting of typed content parts.

A message's content is an array of parts ``struct<kind, text, ref, tokens>``; a plain text is an
array of one text part.  The visitor flattens the parts in order: a text part becomes its escaped
text; an image, audio or document part becomes a numbered placeholder (counted over the
conversation) and an attachment record of its kind, reference and the tokens it expands to.

Template: ``[TURN]role[SAYS]content[END]`` per turn.  ``&``, ``<`` and ``[`` inside texts,
roles and references are written ``&amp;``, ``&lt;`` and ``&#91;``, so no control string can
be spelled by a text, and unescaping gives the text back exactly.  The loss mask is an array of
spans (start and length in characters of the formatted text) that cover the text parts of
assistant turns, not their placeholders; ``masked_text`` cuts them out and unescapes them.

Parts are numbered and placed by running sums over the conversation, so a turn of many parts, or
a conversation of many turns, costs its sort.  Turns are sorted by turn, then role and parts
(nulls first); equal rows stay.  Null texts, roles and parts are empty; a part of any other kind,
or none, counts as text; rows with a null conversation form one conversation.  A conversation is
one output row, so its turns are gathered by the task that writes it, long texts included.  An
empty table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Tokens that an attachment expands to where its part states none.
DEFAULT_TOKENS = {"image": 576, "audio": 750, "document": 2048}
TURN, SAYS, END = "[TURN]", "[SAYS]", "[END]"
PART = "struct<kind:string,text:string,ref:string,tokens:bigint>"


def escaped(text: Column) -> Column:
    out = F.replace(F.coalesce(text, F.lit("")), F.lit("&"), F.lit("&amp;"))
    return F.replace(F.replace(out, F.lit("<"), F.lit("&lt;")), F.lit("["), F.lit("&#91;"))


def unescaped(text: Column) -> Column:
    out = F.replace(F.replace(text, F.lit("&#91;"), F.lit("[")), F.lit("&lt;"), F.lit("<"))
    return F.replace(out, F.lit("&amp;"), F.lit("&"))


def text_parts(text: Column) -> Column:
    """A plain text as an array of one text part."""
    return F.array(
        F.struct(F.lit("text").alias("kind"), F.coalesce(text, F.lit("")).alias("text"),
                 F.lit(None).cast("string").alias("ref"), F.lit(0).cast("bigint").alias("tokens"))
    )


def is_attachment(part: Column) -> Column:
    return F.coalesce(part["kind"].isin(*DEFAULT_TOKENS), F.lit(False))


def part_tokens(part: Column) -> Column:
    default = F.lit(0)
    for kind, tokens in DEFAULT_TOKENS.items():
        default = F.when(part["kind"] == kind, tokens).otherwise(default)
    return F.coalesce(part["tokens"], default).cast("bigint")


def visit(part: Column, number: Column) -> Column:
    """The written form of one part; ``number`` counts the attachments up to it."""
    held = F.concat(F.lit("<"), part["kind"], F.lit(":"), number.cast("string"), F.lit(">"))
    return F.when(is_attachment(part), held).otherwise(escaped(part["text"]))


def visited_parts(
    rows: DataFrame, conv_col: str, turn_col: str, role_col: str, parts: Column
) -> DataFrame:
    """One row per part in its conversation's order (nth message, pos), with its written form.

    A message without parts has one row, whose part is null.
    """
    messages = rows.select(
        F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).cast("long").alias("turn"),
        F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("role"),
        parts.cast(f"array<{PART}>").alias("parts"),
    )
    in_order = W.partitionBy("conv_id").orderBy("turn", "role", "parts")
    up_to = W.partitionBy("conv_id").orderBy("nth", "pos").rowsBetween(W.unboundedPreceding, 0)
    before = W.partitionBy("conv_id").orderBy("nth", "pos").rowsBetween(W.unboundedPreceding, -1)
    last = F.coalesce(F.size("parts") - 1, F.lit(0))
    return (
        messages.withColumn("nth", F.row_number().over(in_order))
        .select("conv_id", "nth", "role", F.greatest(last, F.lit(0)).alias("last"),
                F.posexplode_outer("parts").alias("pos", "part"))
        .withColumn("pos", F.coalesce("pos", F.lit(0)))
        .withColumn("attached", is_attachment(F.col("part")))
        .withColumn("number", F.sum(F.col("attached").cast("int")).over(up_to))
        .withColumn("piece", visit(F.col("part"), F.col("number")))
        .withColumn("opening", F.when(
            F.col("pos") == 0, F.concat(F.lit(TURN), escaped(F.col("role")), F.lit(SAYS))).otherwise(""))
        .withColumn("written", F.concat(
            "opening", "piece", F.when(F.col("pos") == F.col("last"), F.lit(END)).otherwise("")))
        .withColumn("start", F.coalesce(F.sum(F.length("written")).over(before), F.lit(0)) + F.length("opening"))
    )


def format_chat(
    rows: DataFrame,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
    parts_col: str | None = None,
    learned_role: str = "assistant",
) -> DataFrame:
    """conv_id, formatted, mask (array of start, length), attachments (array of number, kind,
    ref, tokens) and attachment_tokens of each conversation."""
    parts = F.col(parts_col) if parts_col else text_parts(F.col(text_col))
    visited = visited_parts(rows, conv_col, turn_col, role_col, parts)
    learned = (F.col("role") == learned_role) & ~F.col("attached") & (F.length("piece") > 0)
    span = F.struct("start", F.length("piece").cast("long").alias("length"))
    record = F.struct(
        "number", F.col("part.kind").alias("kind"), F.col("part.ref").alias("ref"),
        part_tokens(F.col("part")).alias("tokens"))
    gathered = visited.groupBy("conv_id").agg(
        F.sort_array(F.collect_list(F.struct("nth", "pos", "written"))).alias("pieces"),
        F.sort_array(F.collect_list(F.when(learned, span))).alias("mask"),
        F.sort_array(F.collect_list(F.when(F.col("attached"), record))).alias("attachments"),
    )
    return gathered.select(
        "conv_id", F.array_join("pieces.written", "").alias("formatted"), "mask", "attachments",
        F.aggregate("attachments", F.lit(0).cast("bigint"), lambda s, a: s + a["tokens"])
        .alias("attachment_tokens"),
    )


def masked_text(formatted: Column, mask: Column) -> Column:
    """The text under the mask, unescaped.

    Cut from a form of four bytes a character, where the place of a span is known without
    reading what precedes it; the outer ``transform`` holds that form as a variable.
    """
    def cut(wide: Column) -> Column:
        spans = F.transform(mask, lambda s: F.decode(
            F.substr(wide, (4 * s["start"] + 1).cast("int"), (4 * s["length"]).cast("int")), "UTF-32"))
        return unescaped(F.array_join(spans, ""))

    return F.transform(F.array(F.encode(formatted, "UTF-32")), cut)[0]


def read_back(formatted: Column) -> Column:
    """Turns of a formatted conversation: array of struct<role, text> (texts unescaped)."""
    pieces = F.split(formatted, r"\[TURN\]")
    turns = F.slice(pieces, F.lit(2), F.size(pieces))

    def one(t: Column) -> Column:
        halves = F.split(t, r"\[SAYS\]")
        return F.struct(
            unescaped(halves[0]).alias("role"),
            unescaped(F.regexp_replace(halves[1], r"\[END\]$", "")).alias("text"),
        )

    return F.transform(turns, one)
