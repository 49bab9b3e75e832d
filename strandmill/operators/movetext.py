"""Annotated games: headers, moves, comments and variations of game texts, read by a stack of variations in one pass.

Moves are taken as they are written; whether they are legal takes the rules of play, which are left out.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

#: Comments in braces or to the end of a line, headers, numeric annotations, brackets, results, move numbers, moves.
PIECE = re.compile(r"""\{(?P<brace>[^}]*)(?:\}|\Z) | ;(?P<rest>[^\n]*) | (?:(?<=\n)|\A)(?P<escape>%[^\n]*) | (?:(?<=\n)|\A)\[(?P<header>\w+)\s+"(?P<value>(?:[^"\\]|\\.)*)"\s*\]
  | \$(?P<nag>\d+) | (?P<open>\() | (?P<close>\)) | (?P<result>1-0|0-1|1/2-1/2|\*) | (?P<number>\d+\.*) | (?P<move>[A-Za-z][A-Za-z0-9+\#=:-]*) | (?P<mark>[!?]{1,2})""", re.VERBOSE)
# The numbers of annotations that marks stand for.
MARKS = {"!": 1, "?": 2, "!!": 3, "??": 4, "!?": 5, "?!": 6}

NODE = pa.struct([("ply", pa.int32()), ("depth", pa.int32()), ("variation", pa.int32()), ("move", pa.string()), ("before", pa.list_(pa.string())), ("after", pa.list_(pa.string())), ("nags", pa.list_(pa.int32()))])
GAME = pa.struct([("headers", pa.map_(pa.string(), pa.string())), ("result", pa.string()), ("nodes", pa.list_(NODE))])
NODE_SQL = "struct<ply:int,depth:int,variation:int,move:string,before:array<string>,after:array<string>,nags:array<int>>"


def read_game(text: str) -> dict:
    """Headers, result and nodes of one game.

    A comment before the first move of a line belongs to that move (``before``), any other to the move it follows. A
    bracket opens a variation that stands for the move before it; a closing one without an opening is passed over, and
    what is open at the end ends there. ``variation`` numbers the lines of a game, the main line is 0.
    """
    headers: dict[str, str] = {}
    nodes: list[dict] = []
    stack: list[tuple[int, int, dict | None]] = []
    ply, variation, made, last, waiting, result = 0, 0, 0, None, [], None
    for m in PIECE.finditer(text):
        kind = m.lastgroup
        if kind in ("brace", "rest"):
            comment = " ".join((m[kind] or "").split())
            if comment:
                (waiting if last is None else last["after"]).append(comment)
        elif kind == "value":
            headers.setdefault(m["header"], re.sub(r"\\(.)", r"\1", m["value"]))
        elif kind == "move":
            ply += 1
            last = {"ply": ply, "depth": len(stack), "variation": variation, "move": m[0], "before": waiting, "after": [], "nags": []}
            waiting = []
            nodes.append(last)
        elif kind in ("nag", "mark") and last is not None:
            last["nags"].append(min(int(m["nag"][:9]), 2**31 - 1) if kind == "nag" else MARKS[m["mark"]])
        elif kind == "open":
            stack.append((ply, variation, last))
            made += 1
            ply, variation, last = max(0, ply - 1), made, None
        elif kind == "close" and stack:
            ply, variation, last = stack.pop()
            waiting = []
        elif kind == "result" and not stack:
            result = result or m["result"]
    return {"headers": list(headers.items()), "result": result, "nodes": nodes}


def games(text: Column) -> Column:
    """:func:`read_game` of a string column; a null text is a game without anything."""
    @arrow_udf(f"struct<headers:map<string,string>,result:string,nodes:array<{NODE_SQL}>>")
    def of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            for start in range(0, max(1, len(batch)), 256):
                yield pa.array([read_game(x.as_py() or "") for x in batch.slice(start, 256)], GAME)

    return of(text)


def node_comment(node: Column) -> Column:
    """``struct(text, source, nags)`` of a node: its comments with a blank line between, the names of the parts that are
    there, the distinct annotations in order; null where there is nothing."""
    nags = F.array_sort(F.array_distinct(node["nags"]))
    before, after = (F.nullif(F.array_join(node[c], " "), F.lit("")) for c in ("before", "after"))
    source = F.concat_ws("+", F.when(before.isNotNull(), "starting_comment"), F.when(after.isNotNull(), "comment"), F.when(F.size(nags) > 0, "nag"))
    return F.when(source != "", F.struct(F.concat_ws("\n\n", before, after).alias("text"), source.alias("source"), nags.alias("nags")))


def annotated_nodes(rows: DataFrame, key: str, text: str) -> DataFrame:
    """``(key, headers, ply, depth, variation, move, comment_text, comment_source, nags)`` of the nodes that are commented on."""
    nodes = rows.select(key, games(F.col(text)).alias("_g")).select(key, "_g.headers", F.explode("_g.nodes").alias("_n"))
    noted = nodes.withColumn("_c", node_comment(F.col("_n"))).where(F.col("_c").isNotNull())
    return noted.select(key, "headers", *[F.col(f"_n.{c}").alias(c) for c in ("ply", "depth", "variation", "move")], F.col("_c.text").alias("comment_text"), F.col("_c.source").alias("comment_source"), F.col("_c.nags").alias("nags"))
