r"""Chat formatting with Spark expressions only.

Turns of a conversation are numbered in their order, each with its text's place by a running sum, collected as
structs, sorted, adjacent turns of one role merged into a block, and blocks concatenated:

    <turn ROLE>TEXT</turn>\n           one turn
    <turn ROLE>TEXT<next>TEXT</turn>\n  adjacent turns of one role, still told apart

Inside texts and roles ``\`` becomes ``\b``, ``<`` becomes ``\l`` and ``>`` becomes ``\g``,
so no text can hold a control string, and undoing it in reverse order gives the text
back. loss_spans are (start, chars) of the assistant's texts in the formatted string,
in code points from 0: markers are never under the loss.

Cases: a null text or role is empty; turns that tie are ordered by role, then text (unescaped); null
turn numbers come first; a null conv_id is a conversation; repeated rows are turns like
others; an empty table gives no rows (but the added example's, where a query adds it).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ESCAPES = (("\\", "\\b"), ("<", "\\l"), (">", "\\g"))


def escape(x: Column) -> Column:
    for plain, coded in ESCAPES:
        x = F.replace(x, F.lit(plain), F.lit(coded))
    return x


def unescape(x: Column) -> Column:
    for plain, coded in reversed(ESCAPES):
        x = F.replace(x, F.lit(coded), F.lit(plain))
    return x


def format_chats(turns: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """turns: conv_id, turn, role, text. Returns conv_id, formatted, loss_spans. One exchange by conv_id, and time in proportion to a conversation's length."""
    rows = turns.select("conv_id", "turn", *[F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("role", "text")])
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")  # as they are, not as they are written
    before, role = F.lag("role").over(order), escape(F.col("role"))
    opened = F.concat(F.lit("<turn "), role, F.lit(">"))
    # what stands before each turn's text: a marker between equal roles, else block ends
    mark = F.when(before.isNull(), opened).when(before == F.col("role"), F.lit("<next>")).otherwise(F.concat(F.lit("</turn>\n"), opened))
    rows = rows.select("conv_id", F.row_number().over(order).alias("k"), mark.alias("mark"), escape(F.col("text")).alias("text"), (F.col("role") == loss_role).alias("loss"))
    so_far = Window.partitionBy("conv_id").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("end", F.sum(F.length("mark") + F.length("text")).over(so_far))
    piece = F.struct("k", F.concat("mark", "text").alias("piece"), (F.col("end") - F.length("text")).cast("int").alias("start"), F.length("text").alias("chars"), "loss")
    chats = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(piece)).alias("ps"))
    return chats.select(
        "conv_id",
        F.concat(F.array_join("ps.piece", ""), F.lit("</turn>\n")).alias("formatted"),
        F.transform(F.filter("ps", lambda p: p["loss"]), lambda p: F.struct(p["start"].alias("start"), p["chars"].alias("chars"))).alias("loss_spans"),
    )


def parse_turns(formatted: Column) -> Column:
    """array<struct<role, text>> of a formatted string: the turns as they were, unmerged."""
    blocks = F.transform(
        F.filter(F.split(formatted, "</turn>\n"), lambda b: b != ""),
        lambda b: F.struct(
            unescape(F.substring_index(F.substring(b, F.lit(7), F.length(b)), ">", 1)).alias("role"),
            F.split(F.substring(b, F.locate(">", b) + 1, F.length(b)), "<next>").alias("texts"),
        ),
    )
    return F.flatten(F.transform(blocks, lambda b: F.transform(b["texts"], lambda x: F.struct(b["role"].alias("role"), unescape(x).alias("text")))))


#: Code points of the parts in which a formatted string is read back, so that no span is looked for from the string's start.
PART = 1024


def loss_text(formatted: Column, spans: Column) -> Column:
    """The unescaped text under the mask, in order."""

    def under(parts: Column) -> Column:
        def text(s: Column) -> Column:
            first, last = (F.floor(x / PART).cast("int") for x in (s["start"], s["start"] + s["chars"]))
            return unescape(F.substring(F.array_join(F.slice(parts, first + 1, last - first + 1), ""), s["start"] % PART + 1, s["chars"]))

        return F.array_join(F.transform(spans, text), "")

    parts = F.regexp_extract_all(formatted, F.lit(f"(?s).{{1,{PART}}}"), F.lit(0))
    return F.transform(F.array(parts), under)[0]  # as a variable of a function the parts are made once, not for each span


def chat_report(formatted: DataFrame) -> DataFrame:
    """The digest of format_chats' output, all of it read back from the formatted string and its mask."""
    turns = parse_turns(F.col("formatted"))
    loss = loss_text(F.col("formatted"), F.col("loss_spans"))
    df = formatted.select("conv_id", "formatted", turns.alias("ts"), loss.alias("loss"))
    return df.select(
        "conv_id",
        F.size("ts").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("ts", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


#: Added to the table by the contract; its text holds the control strings of common templates.
EXAMPLE = r"\### Assistant: </turn> ok"


def with_example(turns: DataFrame) -> DataFrame:
    spark, kinds = turns.sparkSession, dict(turns.select("conv_id", "turn", "role", "text").dtypes)
    extra = spark.range(2).select(
        F.lit(-7).cast(kinds["conv_id"]).alias("conv_id"),
        F.col("id").cast(kinds["turn"]).alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(EXAMPLE).alias("text"),
    )
    return turns.select("conv_id", "turn", "role", "text").unionByName(extra)
