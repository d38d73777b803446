"""Chat formatting with typed content parts (operator 2).

A message has an ordered array of parts. A visitor flattens them: text goes in as it is (escaped), an image, audio
or document part becomes a numbered placeholder, and its reference and the number of tokens it will expand to are recorded.

    <turn>assistant\\n ... </turn>\\n

Every control string begins with "<". In roles and texts "%" is written %0 and "<" is written %1, so no text can hold a
control string, and what was written can be read back exactly: first %1, then %0, neither of which makes the other.

The loss mask is a list of character spans (code points, end exclusive) of the formatted text: the texts of the turns
whose role is learned.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PART = "struct<type:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>"
LEARNED = ("assistant",)
PATCH = 14            # pixels along one side of an image patch, one token each
AUDIO_TOKENS = 25     # a second
PAGE_TOKENS = 512     # a page

TURN, TURN_END, NEW_LINE = "<turn>", "</turn>\n", "\n"


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("%"), F.lit("%0")), F.lit("<"), F.lit("%1"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("%1"), F.lit("<")), F.lit("%0"), F.lit("%"))


def escape_role(role: Column) -> Column:
    """A role stands on its line, so its own line ends are escaped too."""
    return F.replace(escape(role), F.lit("\n"), F.lit("%2"))


def expanded_tokens(part: Column) -> Column:
    """Tokens that a part other than text expands to; parts without a size take one. Text has 0 here."""
    image = F.ceil(part["width"] / F.lit(PATCH)) * F.ceil(part["height"] / F.lit(PATCH))
    sized = (
        F.when(part["type"] == "image", image)
        .when(part["type"] == "audio", F.ceil(part["seconds"] * F.lit(AUDIO_TOKENS)))
        .when(part["type"] == "document", part["pages"].cast("long") * PAGE_TOKENS)
    )
    return F.when(F.coalesce(part["type"], F.lit("text")) == "text", F.lit(0).cast("long")).otherwise(
        F.greatest(F.coalesce(sized.cast("long"), F.lit(1).cast("long")), F.lit(1).cast("long")))


def visit(parts: Column) -> Column:
    """The texts that parts become, in order. Placeholders name the type and the tokens: <image 256>."""
    return F.transform(parts, lambda p: F.when(F.coalesce(p["type"], F.lit("text")) == "text", escape(F.coalesce(p["text"], F.lit(""))))
                       .otherwise(F.concat(F.lit("<"), escape(p["type"]), F.lit(" "), expanded_tokens(p).cast("string"), F.lit(">"))))


def format_chat(messages: DataFrame, learned=LEARNED) -> DataFrame:
    """From messages (conv_id, turn, role, parts) one row a conversation: conv_id, n_turns, formatted, loss_spans, attachments.

    parts has the type of `PART`. Turns are ordered by turn, then role and body, so that ties give the same text again; null
    turns come first, repeated rows stay repeated. A null role is empty; null parts are an empty text; null conv_id is a
    conversation. `attachments` lists (turn, type, ref, tokens) in the order of the placeholders. Messages are formatted where they
    are read; only a conversation's own text, which is the result, comes together in one row.
    """
    body = F.array_join(visit(F.coalesce("parts", F.array().cast(f"array<{PART}>"))), "")
    role = F.coalesce("role", F.lit(""))
    other = F.filter("parts", lambda p: F.coalesce(p["type"], F.lit("text")) != "text")
    turns = messages.select(
        "conv_id",
        F.struct(
            "turn", role.alias("role"), body.alias("body"),
            F.transform(F.coalesce(other, F.array().cast(f"array<{PART}>")), lambda p: F.struct(p["type"].alias("type"), p["ref"].alias("ref"), expanded_tokens(p).alias("tokens"))).alias("attached"),
        ).alias("t"),
    )
    joined = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("ts"))
    head = lambda t: F.concat(F.lit(TURN), escape_role(t["role"]), F.lit(NEW_LINE))
    # a turn's text begins after its head; a running end gives the offsets
    placed = F.aggregate(
        "ts", F.struct(F.lit(0).cast("long").alias("end"), F.array().cast("array<struct<start:bigint,end:bigint>>").alias("spans")),
        lambda s, t: F.struct(
            (s["end"] + F.length(head(t)) + F.length(t["body"]) + len(TURN_END)).alias("end"),
            F.when(t["role"].isin(*learned), F.concat(s["spans"], F.array(F.struct(
                (s["end"] + F.length(head(t))).alias("start"), (s["end"] + F.length(head(t)) + F.length(t["body"])).alias("end"))))).otherwise(s["spans"]).alias("spans"),
        ),
    )
    return joined.select(
        "conv_id", F.size("ts").cast("long").alias("n_turns"),
        F.array_join(F.transform("ts", lambda t: F.concat(head(t), t["body"], F.lit(TURN_END))), "").alias("formatted"),
        placed["spans"].alias("loss_spans"),
        F.flatten(F.transform("ts", lambda t: F.transform(t["attached"], lambda a: F.struct(t["turn"].alias("turn"), a["type"].alias("type"), a["ref"].alias("ref"), a["tokens"].alias("tokens"))))).alias("attachments"),
    )


def read_turns(formatted: Column) -> Column:
    """The turns (role, text) of a formatted text, unescaped; placeholders stand in the text as written."""
    pieces = F.filter(F.split(formatted, TURN), lambda p: p != "")
    return F.transform(pieces, lambda p: F.struct(
        unescape(F.replace(F.substring_index(p, NEW_LINE, 1), F.lit("%2"), F.lit("\n"))).alias("role"),
        unescape(p.substr(F.instr(p, NEW_LINE) + 1, F.length(p) - F.instr(p, NEW_LINE) - len(TURN_END))).alias("text"),
    ))


def read_loss(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, nothing between."""
    return F.array_join(F.transform(spans, lambda s: unescape(formatted.substr((s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int")))), "")
