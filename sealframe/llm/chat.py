"""Chat formatting with relational and array expressions only.

A conversation becomes one text: each run of turns of one role is a block
`<|im_start|>role\\n…<|im_end|>\\n`, the texts of its turns separated by `<|im_sep|>`. In
texts and roles `\\` is written `\\\\` and `<|` is written `<\\|`, so no text can hold a mark and
the way back is exact; a line break in a role is written `<\\n`.

Cases: null role and text count as empty; turns go by turn, role, text (nulls first), so ties
and repeated rows have one order and all stay; rows with a null conversation id form one
conversation; an empty table gives an empty result; other columns are ignored. The text of
one conversation is one value, so a conversation is bounded by Spark's 2 GB for a value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Turns whose spans are gathered at a time.
STRETCH = 256
START, SEPARATOR, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>\n"


def escape(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("<\\|"), F.lit("<|")), F.lit("\\\\"), F.lit("\\"))


def _escape_role(c: Column) -> Column:
    return F.replace(escape(c), F.lit("\n"), F.lit("<\\n"))


def _unescape_role(c: Column) -> Column:
    return unescape(F.replace(c, F.lit("<\\n"), F.lit("\n")))


def format_conversations(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", trained_role: str = "assistant") -> DataFrame:
    """(conv_id, formatted, loss_spans): spans {start, chars} of the trained role's texts,
    zero-based code points of `formatted`."""
    rows = df.select(F.col(conv).alias("conv_id"), F.struct(F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text")).alias("t"))
    turns = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))

    def piece(t: Column, i: Column) -> Column:
        before, after = F.get(F.col("turns"), i - 1)["role"], F.get(F.col("turns"), i + 1)["role"]
        head = F.when(before.isNotNull() & (before == t["role"]), F.lit(SEPARATOR)).otherwise(F.concat(F.lit(START), _escape_role(t["role"]), F.lit("\n")))
        tail = F.when(after.isNotNull() & (after == t["role"]), F.lit("")).otherwise(F.lit(END))
        return F.struct(head.alias("head"), escape(t["text"]).alias("body"), tail.alias("tail"), (t["role"] == trained_role).alias("loss"))

    pieces = turns.select("conv_id", F.transform("turns", piece).alias("pieces"))
    span = "array<struct<start:bigint,chars:bigint>>"
    zero = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast(span).alias("spans"))

    def advance(acc: Column, p: Column) -> Column:
        start, chars = acc["at"] + F.length(p["head"]), F.length(p["body"]).cast("long")
        spans = F.when(p["loss"], F.array_append(acc["spans"], F.struct(start.alias("start"), chars.alias("chars")))).otherwise(acc["spans"])
        return F.struct((start + chars + F.length(p["tail"])).alias("at"), spans.alias("spans"))

    # Appending copies an array, so spans are made by stretches of turns, from 0 on in each, and moved on.
    stretch = lambda k: F.aggregate(F.slice("pieces", k * STRETCH + 1, STRETCH), zero, advance)
    made = pieces.withColumn("made", F.transform(F.sequence(F.lit(0), F.floor((F.size("pieces") - 1) / STRETCH).cast("int")), stretch))
    first = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<bigint>").alias("starts"))
    starts = F.aggregate("made", first, lambda acc, m: F.struct((acc["at"] + m["at"]).alias("at"), F.array_append(acc["starts"], acc["at"]).alias("starts")))["starts"]
    moved = F.zip_with("made", starts, lambda m, s: F.transform(m["spans"], lambda x: F.struct((x["start"] + s).alias("start"), x["chars"].alias("chars"))))
    return made.select(
        "conv_id",
        F.array_join(F.transform("pieces", lambda p: F.concat(p["head"], p["body"], p["tail"])), "").alias("formatted"),
        F.flatten(moved).alias("loss_spans"),
    )


def read_turns(formatted: Column) -> Column:
    """Array of {role, text} back from a formatted text."""
    blocks = F.slice(F.split(formatted, r"<\|im_end\|>\n"), F.lit(1), F.size(F.split(formatted, r"<\|im_end\|>\n")) - 1)

    def block(b: Column) -> Column:
        cut = F.instr(b, "\n")
        role = _unescape_role(F.substring(b, F.lit(len(START) + 1), cut - len(START) - 1))
        body = F.substring(b, cut + 1, F.length(b))
        return F.transform(F.split(body, r"<\|im_sep\|>"), lambda x: F.struct(role.alias("role"), unescape(x).alias("text")))

    return F.flatten(F.transform(blocks, block))


def masked_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, in order."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substring(formatted, (s["start"] + 1).cast("int"), s["chars"].cast("int")))), "")
