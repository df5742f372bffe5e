"""Chat formatting with typed content parts.

A turn holds a list of parts: text, image, audio or document.  A visitor flattens them in order: texts are escaped, every
other part becomes a placeholder, and its reference and the number of tokens that it expands to are recorded.  A turn is

    <|turn|>role<|text|>body<|end|>

Control strings start with ``<`` or ``[``; inside texts and roles each of these, and each backslash, is followed by a
backslash, so a text can never spell ``<|end|>``, ``</s>`` or ``[INST]``, and the escape can be taken back exactly.

All of it is column expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import empty_as

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
#: Tokens that a part expands to: pixels of an image patch's side, audio tokens a second, tokens of a document page.
PATCH = 28
AUDIO_RATE = 25
PAGE_TOKENS = 256
#: The type of a list of content parts.
PARTS = ("array<struct<type:string,text:string,ref:string,width:bigint,height:bigint,seconds:double,pages:bigint>>")
TRAINED_ROLE = "assistant"


def escape(text: Column) -> Column:
    """Put a backslash after every control character and every backslash."""
    return F.regexp_replace(text, r"([\\<\[])", r"$1\\")


def unescape(text: Column) -> Column:
    """Take ``escape`` back."""
    return F.regexp_replace(text, r"([\\<\[])\\", "$1")


def text_parts(col: str) -> Column:
    """A plain text column as a list with one text part; null is the empty text."""
    none = F.lit(None)
    return F.array(F.struct(
        F.lit("text").alias("type"), empty_as(col).alias("text"), none.cast("string").alias("ref"),
        none.cast("bigint").alias("width"), none.cast("bigint").alias("height"),
        none.cast("double").alias("seconds"), none.cast("bigint").alias("pages")))


def json_parts(col: str) -> Column:
    """A JSON list of parts; what is not one is a single text part."""
    parsed = F.from_json(F.col(col), PARTS)
    return F.when(F.col(col).rlike(r"^\s*\[") & parsed.isNotNull(), parsed).otherwise(text_parts(col))


def _visit(part: Column) -> Column:
    """(kind, shown, ref, tokens) of one part; an unknown type is kept as a placeholder without tokens."""
    kind = F.coalesce(part["type"], F.lit("text"))
    known = F.when(kind.isin("text", "image", "audio", "document"), kind).otherwise(F.lit("other"))

    def up(x: Column) -> Column:
        return F.ceil(F.greatest(F.coalesce(x, F.lit(0.0)), F.lit(0.0))).cast("long")

    tokens = (F.when(known == "image", up(part["width"] / PATCH) * up(part["height"] / PATCH))
              .when(known == "audio", up(part["seconds"] * AUDIO_RATE))
              .when(known == "document", up(part["pages"].cast("double")) * PAGE_TOKENS).otherwise(F.lit(0).cast("long")))
    shown = F.when(known == "text", escape(F.coalesce(part["text"], F.lit("")))).otherwise(
        F.concat(F.lit("<|"), known, F.lit("|>")))
    return F.struct(known.alias("kind"), shown.alias("shown"), part["ref"].alias("ref"), tokens.alias("tokens"))


def format_conversations(turns: DataFrame, parts: str = "parts") -> DataFrame:
    """One row per conversation of ``turns`` (conv_id, turn, role, ``parts``).

    Returns ``conv_id, formatted, turns, attachments, placeholder_tokens``; ``turns`` is an array in order of
    (role, start, end, body_start, body_end, loss) with code-point positions in ``formatted`` (end exclusive) and
    ``loss`` true where the body is trained on; ``attachments`` is an array of (turn, part, kind, ref, tokens) in the
    order of the placeholders.

    Turns go by ``turn`` (nulls last), ties by role, then body.  Null roles and texts are empty; repeated rows are
    repeated turns; rows without a conv_id are one conversation; a turn without parts has an empty body.  Other columns
    are ignored and an empty table gives an empty result.  A conversation is one row of the result and has to fit in
    one; flattening and escaping come before the shuffle."""
    seen = F.transform(F.coalesce(F.col(parts), F.array().cast(PARTS)), _visit)
    flat = (turns.select("conv_id", F.col("turn").cast("long").alias("turn"), empty_as("role").alias("role"), seen.alias("seen"))
            .withColumn("body", F.array_join(F.transform("seen", lambda p: p["shown"]), ""))
            .withColumn("head", F.concat(F.lit(TURN), escape(F.col("role")), F.lit(TEXT)))
            .withColumn("files", F.filter(F.transform("seen", lambda p, i: F.struct(
                i.alias("part"), p["kind"].alias("kind"), p["ref"].alias("ref"), p["tokens"].alias("tokens"))),
                lambda p: p["kind"] != "text"))
            .withColumn("_n", F.length("head") + F.length("body") + len(END)))
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_last(), "role", "body")
    placed = (flat.withColumn("_no", F.row_number().over(order))
              .withColumn("_to", F.sum(F.col("_n").cast("long")).over(order.rowsBetween(Window.unboundedPreceding, 0))))
    begin = F.col("_to") - F.col("_n")
    body = begin + F.length("head")
    one = F.struct(
        F.col("_no").alias("no"), F.concat("head", "body", F.lit(END)).alias("shown"),
        F.struct("role", begin.alias("start"), F.col("_to").alias("end"), body.alias("body_start"),
                 (body + F.length("body")).alias("body_end"), (F.col("role") == TRAINED_ROLE).alias("loss")).alias("mark"),
        F.col("files"))
    rows = placed.groupBy("conv_id").agg(F.array_sort(F.collect_list(one)).alias("all"))
    files = F.flatten(F.transform("all", lambda t: F.transform(t["files"], lambda p: F.struct(
        (t["no"] - 1).alias("turn"), p["part"].alias("part"), p["kind"].alias("kind"), p["ref"].alias("ref"),
        p["tokens"].alias("tokens")))))
    return rows.select(
        "conv_id", F.array_join(F.transform("all", lambda t: t["shown"]), "").alias("formatted"),
        F.transform("all", lambda t: t["mark"]).alias("turns"), files.alias("attachments"),
        F.aggregate(files, F.lit(0).cast("long"), lambda s, p: s + p["tokens"]).alias("placeholder_tokens"))


def read_back(formatted: Column) -> Column:
    """The turns of a formatted conversation as an array of (role, text): the inverse of the template for text parts."""
    pieces = F.split(formatted, r"<\|end\|>", -1)
    pieces = F.slice(pieces, 1, F.size(pieces) - 1)
    return F.transform(pieces, lambda x: F.struct(
        unescape(F.substring(F.substring_index(x, TEXT, 1), len(TURN) + 1, 1 << 30)).alias("role"),
        unescape(F.substring(x, F.length(F.substring_index(x, TEXT, 1)) + len(TEXT) + 1, F.lit(1 << 30))).alias("text")))


def masked_text(formatted: Column, turns: Column) -> Column:
    """All text under the loss mask, unescaped; each span is cut from its own turn, so the work is linear."""
    pieces = F.split(formatted, r"<\|end\|>", -1)
    cut = F.zip_with(F.slice(pieces, 1, F.size(turns)), turns, lambda x, t: F.when(t["loss"], unescape(F.substring(
        x, (t["body_start"] - t["start"] + 1).cast("int"), (t["body_end"] - t["body_start"]).cast("int")))).otherwise(F.lit("")))
    return F.array_join(cut, "")
