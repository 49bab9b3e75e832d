"""Holdout regimes as bits of a row: no row is copied for each regime it is in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandmill.sources.shared import written


def with_bits(rows: DataFrame, fields: list[str], split: str, least: int, least_test: int) -> tuple[DataFrame, DataFrame]:
    """``rows`` with ``_values``, the numbers of their eligible values, and the regimes ``(regime, field, value, number)``.

    A regime holds out one value of a field: its test rows are the test rows with the value, its other rows all others
    without it. Values with fewer than ``least`` rows, or ``least_test`` test rows, make none. Rows get the numbers of
    their own values, one for each field at most, however many regimes there are.
    """
    pairs = rows.select(split, F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("value")) for f in fields])).alias("p")).select(split, "p.*")
    counts = pairs.where("value is not null").groupBy("field", "value").agg(F.count("*").alias("n"), F.count_if(F.col(split) == "test").alias("tests")).where((F.col("n") >= least) & (F.col("tests") >= least_test))
    known = written(counts.select(F.concat_ws(":", "field", "value").alias("regime"), "field", "value", (F.row_number().over(Window.orderBy("field", "value")) - 1).cast("int").alias("number")), "regimes")
    few = known.count() <= 100_000
    for f in fields:
        own = known.where(F.col("field") == f).select(F.col("value").alias(f"_v_{f}"), F.col("number").alias(f"_n_{f}"))
        rows = rows.join(F.broadcast(own) if few else own, F.col(f).cast("string") == F.col(f"_v_{f}"), "left").drop(f"_v_{f}")
    numbers = F.array_compact(F.array(*[F.col(f"_n_{f}") for f in fields]))
    return rows.withColumn("_values", numbers).drop(*[f"_n_{f}" for f in fields]), known


def holds(number: Column, split: str) -> Column:
    """Whether a row is in the regime of a number: test rows have its value, others do not."""
    return (F.col(split) == "test") == F.array_contains("_values", number)


def rows_of(rows: DataFrame, known: DataFrame, regime: str, split: str) -> DataFrame:
    """The rows of one regime, by a test of each row; an unknown regime is an error."""
    found = known.where(F.col("regime") == regime).select("number").collect()
    if not found:
        raise KeyError(regime)
    return rows.where(holds(F.lit(found[0]["number"]), split)).withColumn("regime", F.lit(regime))


def sizes(rows: DataFrame, known: DataFrame, split: str) -> DataFrame:
    """``(regime, split, n)``: rows of each split in each regime.

    Rows are counted by split and by (split, number); what a regime keeps of a split is all of it, or all but those that
    have its value, so nothing grows with rows times regimes.
    """
    totals = rows.groupBy(split).agg(F.count("*").alias("_all"))
    with_value = rows.select(split, F.explode("_values").alias("number")).groupBy(split, "number").agg(F.count("*").alias("_own"))
    every = known.join(F.broadcast(totals))  # a row for each split
    counted = every.join(with_value, [split, "number"], "left").withColumn("_own", F.coalesce("_own", F.lit(0)))
    return counted.select("regime", split, F.when(F.col(split) == "test", F.col("_own")).otherwise(F.col("_all") - F.col("_own")).alias("n")).where("n > 0")


def bitmaps(rows: DataFrame, key: str) -> DataFrame:
    """``(number, bucket, bits)``: the keys (from 0 on) of each value as bitmaps of 32,768 keys."""
    listed = rows.select(F.explode("_values").alias("number"), key)
    return listed.groupBy("number", F.bitmap_bucket_number(key).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(key)).alias("bits"))
