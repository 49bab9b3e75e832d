"""Sharding along a Hilbert curve: quantised metadata dimensions, one sort by curve index, runs of equal row counts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from strandmill.llm.common import free_names, materialize


def hilbert_index(cells: np.ndarray, bits: int) -> np.ndarray:
    """Curve index of each row of ``cells`` (rows x dimensions, values below 2**bits).

    Transposes axes to the curve bit plane by bit plane, from the highest: a set bit inverts the lower bits of the
    first axis, a clear one exchanges them with the axis; then Gray decoding, and the planes are interleaved.
    """
    x = cells.astype(np.int64).T.copy()
    planes = [1 << b for b in range(bits - 1, 0, -1)]
    for q in planes:
        for axis in x:
            low, flip = q - 1, (axis & q) != 0
            change = np.where(flip, 0, (x[0] ^ axis) & low)
            if axis is not x[0]:
                axis ^= change
            x[0] ^= np.where(flip, low, change)
    for i in range(1, len(x)):
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    for q in planes:
        turn ^= np.where(x[-1] & q, q - 1, 0)
    x ^= turn
    out = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for axis in x:
            out = out << 1 | axis >> b & 1
    return out


def category(column: Column, bits: int) -> Column:
    """A cell for each value by hash; null has cell 0."""
    return F.coalesce(F.pmod(F.crc32(column.cast("string")), F.lit((1 << bits) - 1)) + 1, F.lit(0)).cast("int")


def magnitude(column: Column, bits: int) -> Column:
    """Half powers of two; null and what is not positive have cell 0."""
    return F.coalesce(F.when(column > 0, F.least(F.floor(F.log2(column.cast("double")) * 2), F.lit((1 << bits) - 1))), F.lit(0)).cast("int")


def interval(column: Column, low: Column, high: Column, bits: int) -> Column:
    """Equal widths from ``low`` to ``high``; null has cell 0."""
    width = high.cast("double") - low.cast("double") + 1
    return F.coalesce(F.floor((column.cast("double") - low.cast("double")) / width * (1 << bits)), F.lit(0)).cast("int")


def curve_index(cells: list[Column], bits: int) -> Column:
    @arrow_udf("bigint")
    def of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array(hilbert_index(batch.values.to_numpy(zero_copy_only=False).reshape(len(batch), -1), bits) if len(batch) else [], pa.int64())

    return of(F.array(*cells))


def hilbert_shards(rows: DataFrame, cells: list[Column], ties: list[str], shards: int = 40, bits: int = 5) -> DataFrame:
    """``rows`` with ``curve`` (long), ``shard`` (int) and ``slot`` (long): runs of the curve, counts at most one apart.

    Rows are sorted over ranges of (curve, ``ties``) and written once with their range and place, so that a lost
    executor changes no number; only the row counts of the ranges are added up in one place. A hot cell is split by
    the ties, like any other run. Rows that tie in everything get neighbouring places in either order. Null keys, null
    texts and null ties come first in their cell. Fewer rows than shards leave shards empty, an empty table gives an
    empty one. Columns named like the new ones are replaced.
    """
    at, place, n, before, every, rank, shard = free_names(rows.columns, "_range", "_place", "_n", "_before", "_all", "_rank", "_shard")
    placed = rows.withColumn("curve", curve_index(cells, bits))
    ordered = placed.repartitionByRange("curve", *ties).sortWithinPartitions("curve", *ties)
    kept = materialize(ordered.withColumns({
        at: F.spark_partition_id(), place: F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)}), "hilbert")
    counts = kept.groupBy(at).agg(F.count("*").alias(n))
    starts = counts.select(at, (F.sum(n).over(Window.orderBy(at)) - F.col(n)).alias(before), F.sum(n).over(Window.partitionBy()).alias(every))
    ranked = kept.join(starts, at).withColumn(rank, F.col(before) + F.col(place))
    first = F.expr(f"({shard} * {every} + {shards - 1}) div {shards}")  # the smallest rank of the shard
    return (ranked.withColumn(shard, F.expr(f"({rank} * {shards}) div {every}")).withColumns({"shard": F.col(shard).cast("int"), "slot": (F.col(rank) - first).cast("long")})
            .drop(at, place, before, every, rank, shard))


def write_shards(rows: DataFrame, path: str) -> None:
    """One folder per shard, rows in slot order."""
    rows.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def shard_bounds(rows: DataFrame, dimensions: list[str]) -> DataFrame:
    """Smallest and largest value of each dimension per shard: what a reader needs to skip files."""
    return rows.groupBy("shard").agg(F.count("*").alias("rows"), *[f(c).alias(f"{n}_{c}") for c in dimensions for n, f in (("min", F.min), ("max", F.max))])


def op5_hilbert_sharding(spark, sf_dir):
    from strandmill.llm.common import table

    text = F.coalesce("text", F.lit(""))
    light = materialize(table(spark, sf_dir, "documents").select(
        "doc_id", "lang", "source", (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text).alias("text_crc32")), "shard-rows")
    ends = light.agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).first()
    cells = [magnitude(F.col("size"), 5), category(F.col("lang"), 5), category(F.col("source"), 5),
             interval(F.col("doc_id"), F.lit(ends["low"]), F.lit(ends["high"]), 5)]
    return hilbert_shards(light, cells, ["text_crc32", "doc_id"]).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
