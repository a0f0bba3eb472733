"""Operator 7: chat formatting with typed content parts. DataFrame functions only.

A message's content is an array of parts. A visitor (one expression a part type)
turns the parts into one string: texts are escaped, an image, audio or document
part leaves an ordered placeholder, and its reference and the tokens that it
will take up are recorded beside it.

Layout of a turn: <|turn|>role<|says|>content<|end|>. In roles and texts a
backslash is doubled and one is put inside each control string, so none survives
and taking every backslash's next character as it is gives the text back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TURN, SAYS, END = "<|turn|>", "<|says|>", "<|end|>"
PLACEHOLDER = {"image": "<|image|>", "audio": "<|audio|>", "document": "<|document|>"}
#: Starts of control strings: every <|...|> of this template, and markers that other templates use.
CONTROL = r"<(?=\||/?s>)|\[(?=/?INST\])"
PART = "struct<type:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>"
PATCH, AUDIO_RATE, PAGE_TOKENS = 28, 25, 256


def escape(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, r"\\", r"\\\\"), CONTROL, r"$0\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def text_part(text: Column) -> Column:
    """A content of one text part."""
    return F.array(F.struct(F.lit("text").alias("type"), text.alias("text"), F.lit(None).alias("ref"), F.lit(None).alias("width"), F.lit(None).alias("height"), F.lit(None).alias("seconds"), F.lit(None).alias("pages"))).cast(f"array<{PART}>")


def visit_string(part: Column) -> Column:
    """What a part leaves in the formatted text; an unknown type or a null leaves nothing."""
    out = F.when(part["type"] == "text", escape(F.coalesce(part["text"], F.lit(""))))
    for kind, mark in PLACEHOLDER.items():
        out = out.when(part["type"] == kind, F.lit(mark))
    return out.otherwise(F.lit(""))


def visit_tokens(part: Column) -> Column:
    """The tokens that a part's placeholder expands to; 0 for texts and for missing measures."""
    of = lambda c: F.coalesce(part[c], F.lit(0))
    return (
        F.when(part["type"] == "image", F.ceil(of("width") / PATCH) * F.ceil(of("height") / PATCH))
        .when(part["type"] == "audio", F.ceil(of("seconds") * AUDIO_RATE))
        .when(part["type"] == "document", of("pages").cast("long") * PAGE_TOKENS)
        .otherwise(F.lit(0))
        .cast("long")
    )


def format_conversations(messages: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", content: str = "content", learn: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """One row a conversation: `formatted`, `loss_spans` (start and length in code points), `attachments`, `n_turns`, `expanded_tokens`.

    content is an array of parts (see PART), or a string, which stands for one
    text part. Messages are ordered by turn; equal turns by role, then text,
    so repeated rows are repeated turns. Null roles and contents are empty. The
    loss mask covers the content of the roles in `learn`. attachments has one
    entry a placeholder, in their order: its turn (from 0), type, reference and
    tokens. A null conversation id is a conversation of its own. Conversations
    are the unit: the messages of one meet in one row. Other columns are dropped.
    """
    parts = F.col(f"`{content}`") if messages.schema[content].dataType.typeName() == "array" else text_part(F.col(f"`{content}`"))
    parts = F.coalesce(parts, F.array().cast(f"array<{PART}>"))
    pieces = messages.select(F.col(f"`{conv}`").alias("conv"), F.col(f"`{turn}`").alias("turn"), F.coalesce(F.col(f"`{role}`"), F.lit("")).alias("role"), parts.cast(f"array<{PART}>").alias("parts"))
    pieces = pieces.select(
        "conv", "turn", "role",
        F.array_join(F.transform("parts", visit_string), "").alias("content"),
        F.transform(F.filter("parts", lambda p: p["type"].isin(*PLACEHOLDER)), lambda p: F.struct(p["type"].alias("type"), p["ref"].alias("ref"), visit_tokens(p).alias("tokens"))).alias("attached"),
        F.array_join(F.transform("parts", lambda p: F.coalesce(p["text"], F.lit(""))), "").alias("said"),
    )
    head = F.concat(F.lit(TURN), escape(F.col("role")), F.lit(SAYS))
    ordered = Window.partitionBy("conv").orderBy(F.col("turn").asc_nulls_first(), "role", "said", "content")
    # The pieces hold their content once; lengths and places are added to them here.
    placed = pieces.withColumns({"head": head, "size": F.length(head) + F.length("content") + len(END)}).withColumns({"number": F.row_number().over(ordered), "upto": F.sum(F.col("size").cast("long")).over(ordered.rowsBetween(Window.unboundedPreceding, 0))})
    row = F.struct("number", F.concat("head", "content", F.lit(END)).alias("piece"), F.col("role").isin(*learn).alias("learn"), (F.col("upto") - F.length("content") - len(END)).alias("start"), F.length("content").cast("long").alias("length"), "attached")
    grouped = placed.groupBy("conv").agg(F.array_sort(F.collect_list(row)).alias("rows"))
    attachments = F.flatten(F.transform("rows", lambda r: F.transform(r["attached"], lambda a: F.struct((r["number"] - 1).alias("turn"), a["type"].alias("type"), a["ref"].alias("ref"), a["tokens"].alias("tokens")))))
    out = grouped.select(
        F.col("conv").alias(conv),
        F.size("rows").cast("long").alias("n_turns"),
        F.array_join(F.transform("rows", lambda r: r["piece"]), "").alias("formatted"),
        F.transform(F.filter("rows", lambda r: r["learn"]), lambda r: F.struct(r["start"].alias("start"), r["length"].alias("length"))).alias("loss_spans"),
        attachments.alias("attachments"),
    )
    return out.withColumn("expanded_tokens", F.aggregate("attachments", F.lit(0).cast("long"), lambda s, a: s + a["tokens"]))


def parse_turns(formatted: Column) -> Column:
    """The turns of a formatted conversation: array of role and content as text; placeholders stay in it."""
    turns = F.slice(F.split(formatted, r"<\|turn\|>", -1), 2, 1 << 30)
    return F.transform(turns, lambda t: F.struct(unescape(F.substring_index(t, SAYS, 1)).alias("role"), unescape(F.regexp_replace(F.substring_index(t, SAYS, -1), r"<\|end\|>$", "")).alias("text")))


def masked_text(formatted: str = "formatted", spans: str = "loss_spans") -> Column:
    """All text under the loss mask, unescaped, nothing between."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.col(formatted).substr((s["start"] + 1).cast("int"), s["length"].cast("int")))), "")
