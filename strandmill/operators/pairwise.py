"""Rows of prompts that explain two moves and of the choice between them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandmill.functions import text as t
from strandmill.operators.builders import clean_segment

# How a prompt names its position, its two moves with their texts, and how an answer names its choice.
POSITION = '(?i)FEN of the given chess board is "([^"]+)"'
CHOICES = "(?is)MoveA:([a-h][1-8][a-h][1-8][nbrq]?)(.*)MoveB:([a-h][1-8][a-h][1-8][nbrq]?)(.*)"
CHOSEN = "(?i)Move([AB]):([a-h][1-8][a-h][1-8][nbrq]?)"


def variant_of(member: str) -> Column:
    """What a member's rows explain, by its name."""
    name = F.lower(F.col(member))
    return F.when(name.contains("strategy"), "strategy").when(name.contains("tactic"), "tactic").when(name.contains("noexplain"), "no_explain").otherwise("both")


def pairwise_rows(lines: DataFrame, source: str) -> DataFrame:
    """Rows of lines ``(path, member, line, value)`` that hold prompts of two explained moves and the choice between them.

    Only ``.jsonl`` members, and none without explanations; blank lines count for line numbers only. A row needs position,
    both moves, a choice that is one of them, and a text of the chosen move. Whether the move is legal is not tested.
    """
    kept = lines.where(F.col("member").endswith(".jsonl") & (t.strip(t.text_of("value")) != "")).withColumn("variant", variant_of("member")).where("variant <> 'no_explain'")
    read = kept.select("*", F.from_json("value", "input string, output string, instruction string").alias("r"))
    asked, told = t.text_of("r.input"), t.text_of("r.output")
    part = lambda i: F.regexp_extract(asked, CHOICES, i)
    letter, move = F.upper(F.regexp_extract(told, CHOSEN, 1)), F.lower(F.regexp_extract(told, CHOSEN, 2))
    text = F.when(letter == "A", part(2)).otherwise(part(4))
    row = read.select(
        "variant", "path", "member", "line", F.concat(F.regexp_extract("member", "([^/]*)$", 1), F.lit(":"), F.col("line").cast("string")).alias("source_row_id"),
        t.strip(F.regexp_extract(asked, POSITION, 1)).alias("fen"), F.array(F.lower(part(1)), F.lower(part(3))).alias("candidate_moves"), move.alias("target_move_uci"),
        F.when(F.col("variant") == "tactic", clean_segment(text, "tactic")).otherwise(clean_segment(text)).alias("comment_text"))
    whole = row.where((F.col("fen") != "") & (F.col("target_move_uci") != "") & F.array_contains("candidate_moves", F.col("target_move_uci")) & (F.col("comment_text") != ""))
    key = lambda tail, prefix: F.concat(F.lit(prefix), F.substring(F.sha2(F.concat(F.lit(source + ":"), "source_row_id", F.lit(tail)), 256), 1, 16))
    return whole.select(key(":comment", "sidecar_").alias("sidecar_id"), key("", "mate_game_").alias("game_id"), key(":0", "pos_").alias("position_id"), F.col("variant").alias("source_family"), "source_row_id", "fen",
                        "candidate_moves", "target_move_uci", "comment_text", F.concat("variant", F.lit("_explanation")).alias("comment_source"), F.lit("pairwise_explanation").alias("record_semantics"))
