"""Chat formatting with Spark expressions: turns sorted, adjacent turns of a role merged, control strings escaped."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, SEP, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>\n"
LEARNED = "assistant"


def escaped(text: Column, line: bool = False) -> Column:
    """No control string can be in the result: & becomes &amp; and <| becomes &lt;| (on one line also the line feed &nl;)."""
    out = F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<|"), F.lit("&lt;|"))
    return F.replace(out, F.lit("\n"), F.lit("&nl;")) if line else out


def unescaped(text: Column, line: bool = False) -> Column:
    """What escaped() was given: after an &, only its own three forms occur."""
    out = F.replace(text, F.lit("&nl;"), F.lit("\n")) if line else text
    return F.replace(F.replace(out, F.lit("&lt;|"), F.lit("<|")), F.lit("&amp;"), F.lit("&"))


def format_chats(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(id, formatted, loss_spans): one row a conversation.

    A block `<|im_start|>role, line feed, text<|im_end|>, line feed` holds adjacent turns of one role, their
    texts parted by `<|im_sep|>`, so that turns can be read back. loss_spans are the places (code points, from
    0, ends exclusive) of the assistant's texts. Turns are in the order of turn, role and text (null
    first); null roles and texts count as empty; repeated rows are turns each; null ids are one conversation; an
    empty table gives an empty table; other columns are left out.
    """
    one = F.struct(F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("role"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    df = turns.select(F.col(id_col), one.alias("one")).groupBy(id_col).agg(F.array_sort(F.collect_list("one")).alias("turns"))
    df = df.withColumn("first", F.filter(F.sequence(F.lit(0), F.size("turns") - 1), lambda i: (i == 0) | (F.get("turns", i)["role"] != F.get("turns", i - 1)["role"])))
    df = df.withColumn("next", F.concat(F.slice("first", 2, F.greatest(F.size("first"), F.lit(1))), F.array(F.size("turns"))))
    merged = F.zip_with("first", "next", lambda a, b: F.struct(F.get("turns", a)["role"].alias("role"), F.transform(F.slice("turns", a + 1, b - a), lambda t: escaped(t["text"])).alias("texts")))
    df = df.select(id_col, merged.alias("blocks"))
    block = lambda b: F.concat(F.lit(START), escaped(b["role"], True), F.lit("\n"), F.array_join(b["texts"], SEP), F.lit(END))
    spans = F.aggregate(
        "blocks",
        F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,end:bigint>>").alias("spans")),
        lambda acc, b: F.aggregate(
            b["texts"],
            F.struct((acc["at"] + len(START) + F.length(escaped(b["role"], True)) + 1).cast("long").alias("at"), acc["spans"].alias("spans")),
            lambda x, t: F.struct((x["at"] + F.length(t) + len(SEP)).cast("long").alias("at"), F.when(b["role"] == LEARNED, F.concat(x["spans"], F.array(F.struct(x["at"].alias("start"), (x["at"] + F.length(t)).cast("long").alias("end"))))).otherwise(x["spans"]).alias("spans")),
            lambda x: F.struct((x["at"] - len(SEP) + len(END)).cast("long").alias("at"), x["spans"].alias("spans")),
        ),
        lambda acc: acc["spans"],
    )
    return df.select(id_col, F.array_join(F.transform("blocks", block), "").alias("formatted"), spans.alias("loss_spans"))


def read_back(formatted: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """(id, turns, loss_text): the turns (role, text) and all text under the loss mask, from the formatted texts alone and their spans."""
    parts = F.slice(F.split("formatted", r"<\|im_start\|>", -1), 2, F.greatest(F.size(F.split("formatted", r"<\|im_start\|>", -1)) - 1, F.lit(0)))

    def turns_of(b: Column) -> Column:
        head = F.substring_index(b, "\n", 1)
        body = F.substring(b, F.length(head) + 2, F.length(b) - F.length(head) - 1 - len(END))
        return F.transform(F.split(body, r"<\|im_sep\|>", -1), lambda t: F.struct(unescaped(head, True).alias("role"), unescaped(t).alias("text")))

    under = F.array_join(F.transform("loss_spans", lambda s: unescaped(F.substring(F.col("formatted"), (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int")))), "")
    return formatted.select(id_col, F.flatten(F.transform(parts, turns_of)).alias("turns"), under.alias("loss_text"), "formatted")
