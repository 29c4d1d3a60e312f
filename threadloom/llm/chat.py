"""Chat formatting with typed content parts.

A visitor turns each part of a turn into text: text parts are escaped, images,
audio and documents become ordered placeholders, and each of these leaves a
record of its reference and of the tokens it stands for.  The formatted text can
be read back.  DataFrame functions only.

A turn is ``<|turn|>role\\nbody<|end|>\\n``, with the role URL-encoded.  In bodies a
backslash is doubled, and a control string gets a backslash after its first
character, so no control string is left inside a text and every text comes back
as it was.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from threadloom.llm.common import let

TURN, END = "<|turn|>", "<|end|>\n"
#: Control strings of this and of other usual templates: fixed values.
CONTROL = ("<|", "</s>", "<s>", "[INST]", "[/INST]")
PARTS = "array<struct<type:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>>"


@dataclass(frozen=True)
class TokenRules:
    """Tokens that an attachment stands for."""

    image_patch: int = 14
    image_merge: int = 2
    audio_per_second: float = 25.0
    document_per_page: int = 600


def escape(text: Column) -> Column:
    out = F.replace(F.coalesce(text, F.lit("")), F.lit("\\"), F.lit("\\\\"))
    for c in CONTROL:
        out = F.replace(out, F.lit(c), F.lit(f"{c[0]}\\{c[1:]}"))
    return out


def unescape(text: Column) -> Column:
    for c in CONTROL:
        text = F.replace(text, F.lit(f"{c[0]}\\{c[1:]}"), F.lit(c))
    return F.replace(text, F.lit("\\\\"), F.lit("\\"))


class PartVisitor:
    """One method per part type; each gives the tokens of an attachment, ``text`` the escaped text."""

    def __init__(self, rules: TokenRules = TokenRules()):
        self.rules = rules

    def text(self, part: Column) -> Column:
        return escape(part["text"])

    def image(self, part: Column) -> Column:
        side = self.rules.image_patch * self.rules.image_merge
        across, down = (F.ceil(F.coalesce(part[c], F.lit(0)) / side) for c in ("width", "height"))
        return F.greatest(across * down, F.lit(1).cast("long"))

    def audio(self, part: Column) -> Column:
        seconds = F.coalesce(part["seconds"], F.lit(0.0))
        return F.greatest(F.ceil(seconds * self.rules.audio_per_second), F.lit(1).cast("long"))

    def document(self, part: Column) -> Column:
        return F.greatest(F.coalesce(part["pages"], F.lit(0)), F.lit(1)).cast("long") * self.rules.document_per_page

    def kind(self, part: Column) -> Column:
        """The attachment type of a part; null for text, also for a part of a type that is not known."""
        return F.when(part["type"].isin("image", "audio", "document"), part["type"])

    def visit(self, part: Column, turn_no: Column, part_no: Column) -> Column:
        kind = self.kind(part)
        mark = F.concat(F.lit("<|"), kind, F.lit(" "), turn_no + 1, F.lit("."), part_no + 1, F.lit("|>"))
        tokens = F.when(kind == "image", self.image(part)).when(kind == "audio", self.audio(part))
        tokens = tokens.when(kind == "document", self.document(part))
        attachment = F.when(
            kind.isNotNull(),
            F.struct(mark.alias("placeholder"), kind.alias("type"), part["ref"].alias("ref"), tokens.alias("tokens")),
        )
        return F.struct(F.coalesce(mark, self.text(part)).alias("body"), attachment.alias("attachment"))


def format_chats(turns: DataFrame, rules: TokenRules = TokenRules()) -> DataFrame:
    """``(conv_id, turn, role, parts)`` -> one row per conversation.

    ``formatted`` text; ``loss_spans``: ``start`` (from 1) and ``length`` in code
    points of every assistant body; ``attachments`` in order, each with its
    placeholder, type, reference and expanded token count; ``n_turns``.

    Turns go by ``turn`` (nulls first), ties by role and parts; repeated rows stay.
    A null role or text is empty, null parts are none, a part of an unknown type is
    its text.  All rows with a null ``conv_id`` are one conversation.  Only whole
    conversations meet in a task: one is one output row.
    """
    visitor = PartVisitor(rules)
    row = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.col("parts").cast(PARTS).alias("parts"))
    chats = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(row)).alias("_turns"))

    def visited(t: Column, no: Column) -> Column:
        parts = F.coalesce(t["parts"], F.array().cast(PARTS))
        return F.struct(t["role"].alias("role"), F.transform(parts, lambda p, k: visitor.visit(p, no, k)).alias("parts"))

    def segment(t: Column) -> Column:
        head = F.concat(F.lit(TURN), F.url_encode(t["role"]), F.lit("\n"))
        body = F.array_join(F.transform(t["parts"], lambda p: p["body"]), "")
        return F.struct((t["role"] == "assistant").alias("learn"), head.alias("head"), body.alias("body"))

    def step(state: Column, s: Column) -> Column:
        start, length = state["next"] + F.length(s["head"]), F.length(s["body"])
        span = F.array(F.struct(start.alias("start"), length.alias("length")))
        return F.struct(
            (start + length + len(END)).alias("next"),
            F.when(s["learn"], F.concat(state["spans"], span)).otherwise(state["spans"]).alias("spans"),
        )

    none = F.array().cast("array<struct<start:int,length:int>>")
    return (
        chats.withColumn("_visited", F.transform("_turns", visited))
        .withColumn("_segments", F.transform("_visited", segment))
        .select(
            "conv_id",
            F.size("_turns").cast("long").alias("n_turns"),
            F.array_join(F.transform("_segments", lambda s: F.concat(s["head"], s["body"], F.lit(END))), "").alias("formatted"),
            F.aggregate("_segments", F.struct(F.lit(1).alias("next"), none.alias("spans")), step)["spans"].alias("loss_spans"),
            F.flatten(
                F.transform("_visited", lambda t: F.filter(F.transform(t["parts"], lambda p: p["attachment"]), lambda a: a.isNotNull()))
            ).alias("attachments"),
        )
    )


def read_back(formatted: Column) -> Column:
    """The turns of a formatted text, as structs of ``role`` and ``text``; placeholders stay in the text."""
    pieces = F.slice(F.split(formatted, r"<\|turn\|>"), F.lit(2), F.greatest(F.size(F.split(formatted, r"<\|turn\|>")) - 1, F.lit(0)))

    def turn(piece: Column) -> Column:
        def parsed(head: Column) -> Column:
            body = F.substring(piece, head + 1, F.length(piece) - head - F.lit(len(END)))
            return F.struct(F.url_decode(F.substring(piece, F.lit(1), head - 1)).alias("role"), unescape(body).alias("text"))

        return let(F.locate("\n", piece), parsed)

    return F.transform(pieces, turn)


def learned_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, in order."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substring(formatted, s["start"], s["length"]))), "")
