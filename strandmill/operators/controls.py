"""Null controls: keyed permutations of rows, many at once, and a statistic held against what they give."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandmill.operators.ranking import placed
from strandmill.sources.shared import written

ROUNDS = 6


def feistel(place: Column, n: int, seed: Column, walks: int = 96) -> Column:
    """Where the permutation of 0 to n - 1 of a seed takes a place: a Feistel network over the next power of two, walked
    along its cycle until it is inside the range.

    Each row works out its partner alone, without a sort, so any number of permutations is read in one scan. At most half
    of the network's values are outside, so a walk of ``walks`` steps that ends there, an error, does not happen.
    """
    bits = max(2, (n - 1).bit_length())
    low = bits // 2
    mask_low, mask_high = F.lit((1 << low) - 1), F.lit((1 << (bits - low)) - 1)

    def step(x: Column) -> Column:
        pair = F.struct(F.shiftright(x, low).alias("high"), x.bitwiseAND(mask_low).alias("low"))

        def turned(p: Column, i: Column) -> Column:  # each half is changed by the other in turn, which can be undone
            high = p["high"].bitwiseXOR(F.xxhash64(p["low"], seed, i).bitwiseAND(mask_high))
            return F.struct(high.alias("high"), p["low"].bitwiseXOR(F.xxhash64(high, seed, -i).bitwiseAND(mask_low)).alias("low"))

        out = F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), pair, turned)
        return F.shiftleft(out["high"], low).bitwiseOR(out["low"])

    walked = lambda x, steps: F.aggregate(F.sequence(F.lit(1), F.lit(steps)), x, lambda x, _: F.when(x >= n, step(x)).otherwise(x))
    near = F.struct(walked(step(place), min(4, walks)).alias("at"))  # a sixteenth of the rows, at most, walks on
    found = F.element_at(F.transform(F.array(near), lambda p: F.when(p["at"] < n, p["at"]).otherwise(walked(p["at"], max(1, walks - 4)))), 1)
    return F.when(found < n, found).otherwise(F.raise_error(F.lit("a walk of a permutation did not end")).cast("long"))


def assignments(rows: DataFrame, key: str, order: list[Column], controls: int, seed: int = 0) -> DataFrame:
    """``(control, key, partner)``: ``controls`` permutations of the rows, each a different one, numbered from 1.

    Rows get their place once; a control's partner is the row at the place that its permutation gives.
    """
    at = written(placed(rows.select(key), (), order, "_place"), "places")
    n = at.count()
    asked = at.select(F.explode(F.sequence(F.lit(1), F.lit(controls))).alias("control"), key, F.col("_place"))
    to = asked.withColumn("_to", feistel(F.col("_place"), max(1, n), F.col("control") + seed)).select("control", key, "_to")
    return to.join(at.select(F.col(key).alias("partner"), F.col("_place").alias("_to")), "_to").select("control", key, "partner")


def statistic(rows: DataFrame, key: str, left: str, right: str, assigned: DataFrame | None = None) -> DataFrame:
    """``(control, n, value)``: the mean inner product of each row's ``left`` with its partner's ``right``; without an
    assignment the row itself is its partner, as control 0."""
    product = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    if assigned is None:
        return rows.agg(F.lit(0).alias("control"), F.count("*").alias("n"), F.avg(product(left, right)).alias("value"))
    held = assigned.join(rows.select(key, F.col(left).alias("_l")), key).join(rows.select(F.col(key).alias("partner"), F.col(right).alias("_r")), "partner")
    return held.groupBy("control").agg(F.count("*").alias("n"), F.avg(product("_l", "_r")).alias("value"))


def falsification(real: DataFrame, nulls: DataFrame) -> DataFrame:
    """One row: the real value, mean, least and largest of the null ones, how many reach it, and p, of which the real one is part."""
    one = real.select(F.col("value").alias("real"))
    both = nulls.join(F.broadcast(one))  # one row
    return both.groupBy("real").agg(
        F.count("*").alias("controls"), F.avg("value").alias("null_mean"), F.min("value").alias("null_least"), F.max("value").alias("null_most"), F.count_if(F.col("value") >= F.col("real")).alias("reached"),
        ((F.count_if(F.col("value") >= F.col("real")) + 1) / (F.count("*") + 1)).alias("p"))
