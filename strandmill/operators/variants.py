"""Rows of unknown shape as VARIANT columns: which keys they carry, what they are good for, and an inventory by source and file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandmill.functions import text as t
from strandmill.operators.boards import position_key

# Keys whose lists make a conversation; keys that name a row, in order; the position that games start from.
CONVERSATION_KEYS = ("messages", "conversations", "dialogue")
ROW_KEYS = ("pipeline_key", "position_id", "source_row_id", "id", "game_id")
START = "rnbqkbnr/pppppppp/8/8/8/8/PPPPPPPP/RNBQKBNR w KQkq - 0 1"
COUNTERS = ("rows", "explicit_fen_rows", "explicit_move_list_rows", "recoverable_board_anchor_rows", "natural_text_rows", "conversation_rows", "board_anchored_rows", "text_only_rows", "unusable_rows")


def parsed(lines: DataFrame, value: str, into: str = "row") -> DataFrame:
    """``lines`` with ``into``: the JSON object of each line as a variant, null for what is no object."""
    read = F.try_parse_json(value)
    return lines.withColumn(into, F.when(F.schema_of_variant(read).startswith("OBJECT"), read))


def part(row: Column, key: str) -> Column:
    """The value under a key: a variant, one that holds null where the key does, and null without the key."""
    return F.try_variant_get(row, f'$["{key}"]', "variant")


def has_key(row: Column, key: str) -> Column:
    return part(row, key).isNotNull()


def is_list(row: Column, key: str) -> Column:
    return F.coalesce(F.schema_of_variant(part(row, key)).startswith("ARRAY"), F.lit(False))


def plain(row: Column, key: str) -> Column:
    """A value as text, stripped; null where it is missing, null or blank."""
    return F.nullif(t.strip(F.try_variant_get(row, f'$["{key}"]', "string")), F.lit(""))


def key_presence(rows: DataFrame, row: str, keys: list[str]) -> DataFrame:
    """``(key, n, presence)``: whether ``all``, ``none`` or only ``some`` of the rows carry each key, a null under it counts."""
    listed = rows.select(F.explode(F.array(*[F.struct(F.lit(k).alias("key"), has_key(F.col(row), k).alias("there")) for k in keys])).alias("k")).select("k.*")
    return listed.groupBy("key").agg(F.count_if("there").alias("n"), F.when(F.bool_and("there"), "all").when(F.bool_or("there"), "some").otherwise("none").alias("presence"))


def require_consistent(rows: DataFrame, row: str, key: str) -> bool:
    """Whether rows carry the key; an error if only some of them do."""
    found = rows.agg(F.bool_and(has_key(F.col(row), key)).alias("all"), F.bool_or(has_key(F.col(row), key)).alias("any")).first()
    if found["any"] and not found["all"]:
        raise ValueError(f"only some rows carry {key!r}")
    return bool(found["all"])


def shapes(rows: DataFrame, row: str, by: str) -> DataFrame:
    """``(by, shape)``: the merged schema of all rows of a group."""
    return rows.groupBy(by).agg(F.schema_of_variant_agg(row).alias("shape"))


def is_conversation(row: Column) -> Column:
    found = F.lit(False)
    for key in CONVERSATION_KEYS:
        found = found | is_list(row, key)
    return found


def classified(rows: DataFrame, row: str = "row") -> DataFrame:
    """``rows`` with ``text``, ``messages``, ``fen``, ``anchor``, ``moves`` and ``kind``.

    Rows under the schema ``conversation`` have the text of their messages, a line each; others prompt, response and text.
    The anchor of a board is an explicit position, else a game in the text: its position header, or the start of games. A
    row with text and anchor is ``board_anchored``, one with text ``text_only``, any other, and what is no object,
    ``unusable``. The moves of a game in the text are not read: that takes the rules of play.
    """
    v = F.col(row)
    talk = F.coalesce(plain(v, "schema") == "conversation", F.lit(False))
    items = F.when(is_list(v, "messages"), F.try_variant_get(v, "$.messages", "array<variant>"))
    said = F.filter(F.transform(items, lambda m: F.when(F.schema_of_variant(m).startswith("OBJECT"), F.struct(F.coalesce(plain(m, "role"), F.lit("unknown")).alias("role"), plain(m, "content").alias("content")))), lambda m: m["content"].isNotNull())
    messages = F.when(talk & (F.size(said) > 0), said)
    lines = F.array_join(F.transform(messages, lambda m: F.concat(m["role"], F.lit(": "), m["content"])), "\n")
    text = F.when(talk, lines).otherwise(F.nullif(F.concat_ws("\n", *[plain(v, k) for k in ("prompt", "response", "text")]), F.lit("")))
    read = rows.withColumns({"text": text, "messages": messages, "_fen": F.nullif(F.try_variant_get(v, "$.fen", "string"), F.lit("")), "moves": moves_of(v)})
    header = F.nullif(F.regexp_extract("text", r'(?m)^\[FEN "([^"]*)"\]', 1), F.lit(""))
    game = F.when(F.col("text").contains("["), F.coalesce(header, F.lit(START)))
    game = F.when(position_key(game).rlike(r"^(?:[1-8pnbrqkPNBRQK]+/){7}[1-8pnbrqkPNBRQK]+ [wb] "), game)
    anchored = read.withColumns({"fen": F.coalesce("_fen", game), "anchor": F.when(F.col("_fen").isNotNull(), "fen").when(game.isNotNull(), "pgn_mainline")}).drop("_fen")
    kind = F.when(F.col("text").isNull(), "unusable").when(F.col("anchor").isNotNull(), "board_anchored").otherwise("text_only")
    return anchored.withColumn("kind", kind)


def moves_of(row: Column) -> Column:
    """The list under ``candidate_moves``, or the words of its text."""
    listed = F.when(is_list(row, "candidate_moves"), F.try_variant_get(row, "$.candidate_moves", "array<string>"))
    return F.coalesce(listed, t.split_list(F.coalesce(F.try_variant_get(row, "$.candidate_moves", "string"), F.lit(""))))


def normalized(kinds: DataFrame, source: str = "source", row: str = "row") -> DataFrame:
    """The usable rows in one shape: ids, source, schema, text, kind of text, position, group that splits keep together.

    A row is named by the first of ``ROW_KEYS`` that it has, else by a digest of itself. Its group is the game of its
    metadata, else a digest of the first 2,048 characters of a game's text, else its name.
    """
    v = F.col(row)
    own = F.concat(F.lit("row_"), F.substring(F.sha2(F.to_json(v), 256), 1, 16))
    name = F.coalesce(*[F.nullif(F.try_variant_get(v, f"$.{k}", "string"), F.lit("")) for k in ROW_KEYS], own)
    game = F.nullif(F.try_variant_get(v, "$.metadata.game_id", "string"), F.lit(""))
    told = F.concat(F.lit("pgn_"), F.substring(F.sha2(F.substring(F.coalesce(F.try_variant_get(v, "$.text", "string"), F.lit("")), 1, 2048), 256), 1, 16))
    named = kinds.select(F.inline(F.array(F.struct("*")))).where("kind <> 'unusable'").withColumn("source_row_id", name)  # filters stay above: below, they would parse each row again for every use
    return named.select(
        F.concat(F.lit("aux_"), F.substring(F.sha2(F.concat_ws(":", source, "source_row_id"), 256), 1, 16)).alias("aux_id"), F.coalesce(F.nullif(F.try_variant_get(v, "$.source", "string"), F.lit("")), F.col(source)).alias("source"),
        F.coalesce(F.nullif(F.try_variant_get(v, "$.schema", "string"), F.lit("")), F.lit("unknown")).alias("source_schema"), "source_row_id", "kind", "text", "messages",
        F.when(F.col("messages").isNotNull(), "conversation").otherwise("natural_text").alias("text_kind"), "fen", position_key("fen").alias("fen_4field"), "anchor", "moves",
        F.when(F.col("kind") == "board_anchored", F.coalesce(game, F.when(F.col("anchor") == "pgn_mainline", told), "source_row_id")).alias("split_group_id"))


def inventory(kinds: DataFrame, sources: list[str], source: str = "source", file: str = "file", row: str = "row") -> DataFrame:
    """A row of counters for each source and file; a source of ``sources`` without rows has one of zeros, without file."""
    there = lambda c: F.count_if(c)
    counted = kinds.groupBy(F.col(source).alias("source"), F.col(file).alias("file")).agg(
        F.count("*").alias("rows"), there(F.nullif(F.try_variant_get(row, "$.fen", "string"), F.lit("")).isNotNull()).alias("explicit_fen_rows"), there(F.size("moves") > 0).alias("explicit_move_list_rows"),
        there(F.col("anchor").isNotNull()).alias("recoverable_board_anchor_rows"), there(F.col("text").isNotNull()).alias("natural_text_rows"), there(F.col("messages").isNotNull()).alias("conversation_rows"),
        *[there(F.col("kind") == k).alias(f"{k}_rows") for k in ("board_anchored", "text_only", "unusable")])
    known = counted.sparkSession.createDataFrame([(s,) for s in sources], "source string")
    missing = known.join(counted.select("source").distinct(), "source", "left_anti").select("source", F.lit(None).cast("string").alias("file"), *[F.lit(0).cast("long").alias(c) for c in COUNTERS])
    return counted.union(missing)
