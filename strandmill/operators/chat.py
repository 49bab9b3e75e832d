"""Chat turns to conversations, messages to text, with the usual aliases of roles and fields."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandmill.functions import text as t


def normalise_messages(messages: Column, role: tuple[str, ...], content: tuple[str, ...]) -> Column:
    """``array<struct<role, content>>`` with common role names and stripped contents; empty ones go, none left is null."""
    pick = lambda x, fields: F.coalesce(*[x[f].cast("string") for f in fields])
    made = F.transform(messages, lambda x: F.struct(t.chat_role(pick(x, role)).alias("role"), t.strip(F.coalesce(pick(x, content), F.lit(""))).alias("content")))
    kept = F.filter(made, lambda x: x["content"] != "")
    return F.when(F.size(kept) > 0, kept)


def conversations(turns: DataFrame, key: str, turn: str, role: str, text: str) -> DataFrame:
    """One row a conversation: its messages in order. A conversation is one record of the corpus and is held as one."""
    rows = turns.select(key, F.struct(F.col(turn).alias("turn"), F.col(role).alias("role"), F.col(text).alias("text")).alias("m"))
    return rows.groupBy(key).agg(F.array_sort(F.collect_list("m")).alias("messages")).withColumn("messages", normalise_messages(F.col("messages"), ("role",), ("text",)))


def flatten(messages: Column) -> Column:
    """``role: content`` lines."""
    return F.array_join(F.transform(messages, lambda x: F.concat(x["role"], F.lit(": "), x["content"])), "\n")


def flatten_text(*parts) -> Column:
    """The parts that are there, stripped, on lines of their own."""
    return F.array_join(F.filter(F.array(*[t.strip(t.text_of(p)) for p in parts]), lambda x: x != ""), "\n")
