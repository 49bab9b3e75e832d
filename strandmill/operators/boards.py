"""Fields of board positions that arithmetic and string functions give: keys, squares, moves, relations of squares.

Rules of play (legal moves, game notation) would be a library of their own beside Spark and are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandmill.functions import text as t


def position_key(fen) -> Column:
    """The first four fields of a position, without clocks; null where there are fewer."""
    parts = F.filter(F.split(t.strip(t.text_of(fen)), t.SPACE + "+"), lambda x: x != "")
    return F.when(F.size(parts) >= 4, F.array_join(F.slice(parts, 1, 4), " "))


def square_row(square: Column) -> Column:
    return (7 - F.floor(square / 8)).cast("int")


def square_column(square: Column) -> Column:
    return F.pmod(square, F.lit(8)).cast("int")


def square_of(name: Column) -> Column:
    """``a1`` is 0, ``h8`` is 63; null for anything else."""
    return F.when(name.rlike("^[a-h][1-8]$"), (F.ascii(F.substring(name, 2, 1)) - 49) * 8 + F.ascii(name) - 97)


def name_of(square: Column) -> Column:
    return F.concat(F.chr(97 + F.pmod(square, F.lit(8))), (F.floor(square / 8) + 1).cast("string"))


def move_parts(move: Column) -> Column:
    """``struct(src, dst, promotion)`` of a move such as ``e7e8q``; promotion 0 for none, else 1 to 4 of n, b, r, q."""
    promoted = F.when(F.length(move) == 5, F.instr(F.lit("nbrq"), F.substring(move, 5, 1))).otherwise(0)
    return F.when(move.rlike("^[a-h][1-8][a-h][1-8][nbrq]?$"), F.struct(
        square_of(F.substring(move, 1, 2)).alias("src"), square_of(F.substring(move, 3, 2)).alias("dst"), promoted.cast("int").alias("promotion")))


def encode_move(src: Column, dst: Column, promotion: Column) -> Column:
    return F.concat(name_of(src), name_of(dst), F.when(promotion > 0, F.substring(F.lit("nbrq"), promotion, F.lit(1))).otherwise(""))


def square_relations(spark: SparkSession) -> DataFrame:
    """The 4,096 pairs of squares: 1 one rank, 2 one file, 3 one diagonal, 4 a knight's jump, 0 the same square and the rest."""
    pairs = spark.range(4096).select(F.floor(F.col("id") / 64).cast("int").alias("a"), F.pmod("id", F.lit(64)).cast("int").alias("b"))
    dr, dc = F.abs(square_row(F.col("a")) - square_row(F.col("b"))), F.abs(square_column(F.col("a")) - square_column(F.col("b")))
    return pairs.withColumn("relation", F.when((dr == 0) & (dc == 0), 0).when(dr == 0, 1).when(dc == 0, 2).when(dr == dc, 3).when((dr + dc == 3) & (dr > 0) & (dc > 0), 4).otherwise(0))
