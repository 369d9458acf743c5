r"""Chat formatting with a grammar round trip.

A turn is rendered as ``### role: text</turn>`` and a newline.  The grammar is

    conversation = { turn }
    turn         = "### " role ": " text "</turn>\n"

with ``\x`` standing for x in roles and texts.  A turn is first rendered as it
is and parsed again; where the parser doesn't recover the same role and text, or
the text holds a control string, its content is escaped: backslashes are
doubled and a backslash is put into every control string.  Rendered turns never
hold the end mark inside, so conversations parse turn by turn.  The whole is
parsed once more and compared with the source.  DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HEAD, MIDDLE, END = "### ", ": ", "</turn>"
ROLE_END = END + "\n"


def escape(text: Column) -> Column:
    r"""Doubles ``\``, and parts ``</turn>``, ``###`` and ``: `` by one."""
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for control in (END, MIDDLE):
        out = F.replace(out, F.lit(control), F.lit(control[0] + "\\" + control[1:]))
    return F.regexp_replace(out, "#(?=##)", r"#\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def parse_turn(rendered: Column) -> Column:
    """struct(role, text) of one rendered turn without its end mark; null if it is none."""
    pattern = r"(?s)\A### (.*?): (.*)\z"
    role, text = (unescape(F.regexp_extract(rendered, pattern, i)) for i in (1, 2))
    return F.when(rendered.rlike(pattern), F.struct(role.alias("role"), text.alias("text")))


def parse(formatted: Column) -> Column:
    """array<struct(role, text)> of a formatted conversation."""
    parts = F.split(formatted, r"</turn>\n", -1)
    return F.transform(F.slice(parts, 1, F.size(parts) - 1), parse_turn)


def format_conversations(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", learn: str = "assistant") -> DataFrame:
    """One row per conversation: conv_id, formatted, loss_spans (array<struct(start, length)>, code points), round_trip.

    Turns are ordered by ``turn`` (null first) and, in ties, by role and text;
    repeated rows stay.  Null roles and texts count as empty.  A null conv_id is
    a conversation of its own.  The loss mask covers the (escaped) texts of the
    role ``learn``.  ``round_trip`` says that the parser recovered all turns;
    a conversation of which it doesn't raises an error.  Other columns are not
    read; an empty table gives none.
    """
    said = turns.select(F.col(conv_id).alias("conv_id"), F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    plain = F.concat(F.lit(HEAD), F.col("role"), F.lit(MIDDLE), F.col("text"))
    back = parse(F.concat(plain, F.lit(ROLE_END)))
    same = (F.size(back) == 1) & (back[0]["role"] == F.col("role")) & (back[0]["text"] == F.col("text"))
    control = F.lit(False)
    for c in (END, "###"):
        control = control | F.contains("text", F.lit(c)) | F.contains("role", F.lit(c))
    said = said.withColumn("plain", F.coalesce(same, F.lit(False)) & ~control)
    said = said.withColumn("r", F.when(F.col("plain"), F.col("role")).otherwise(escape(F.col("role"))))
    said = said.withColumn("t", F.when(F.col("plain"), F.col("text")).otherwise(escape(F.col("text"))))
    grouped = said.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text", "r", "t"))).alias("turns"))
    rendered = F.transform("turns", lambda x: F.concat(F.lit(HEAD), x["r"], F.lit(MIDDLE), x["t"], F.lit(ROLE_END)))
    grouped = grouped.withColumn("formatted", F.array_join(rendered, ""))

    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("spans"))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + len(HEAD) + F.length(x["r"]) + len(MIDDLE)
        span = F.struct(start.alias("start"), F.length(x["t"]).alias("length"))
        return F.struct((start + F.length(x["t"]) + len(ROLE_END)).alias("at"), F.when(x["role"] == learn, F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"]).alias("spans"))

    grouped = grouped.withColumn("loss_spans", F.aggregate("turns", zero, step)["spans"])
    source = F.transform("turns", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text")))
    grouped = grouped.withColumn("round_trip", F.coalesce(parse(F.col("formatted")) == source, F.lit(False)))
    failed = F.raise_error(F.concat(F.lit("a conversation doesn't survive the round trip: "), F.coalesce(F.col("conv_id").cast("string"), F.lit("null"))))
    return grouped.select("conv_id", F.when(F.col("round_trip"), F.col("formatted")).otherwise(failed).alias("formatted"), "loss_spans", "round_trip")


def loss_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped span by span and joined."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substring(formatted, s["start"] + 1, s["length"]))), "")
