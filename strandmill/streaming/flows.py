"""Row-local stages and windows on streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from strandmill.functions import scoring, text as t
from strandmill.functions.hashing import SplitConfig, split_of
from strandmill.operators.dedup import digest


def stream_table(spark: SparkSession, path: str, pattern: str | None = None, files_per_trigger: int = 16) -> DataFrame:
    """Parquet files as they arrive; the schema is that of the files there are.

    With a pattern, files of that name in a folder; else a table, which is a file or a folder of files. That path is
    given as a glob, since a stream takes a plain one for a folder.
    """
    named = lambda reader: reader.option("pathGlobFilter", pattern) if pattern else reader
    stream = spark.readStream.schema(named(spark.read).parquet(path).schema).option("maxFilesPerTrigger", files_per_trigger)
    return named(stream).parquet(path if pattern else f"{path[:-1]}[{path[-1]}]")


def curate_rows(rows: DataFrame, key: str, text: str, config: SplitConfig = SplitConfig()) -> DataFrame:
    """Split, template and informativeness of each row: the same for a stream and for a table."""
    return scoring.informativeness(rows.withColumns({"split": split_of(key, config), "template": t.template(text)}), text)


def first_arrivals(rows: DataFrame, text: str, time: str, late: str = "1 hour") -> DataFrame:
    """Rows whose normalised text did not arrive within ``late`` before; state is bounded by the watermark."""
    return rows.withColumn("_key", F.coalesce(digest(t.normalize(text, "punct_light")), F.lit(""))).withWatermark(time, late).dropDuplicatesWithinWatermark(["_key"]).drop("_key")


def windowed_counts(rows: DataFrame, time: str, by: list[str], size: str = "1 hour", late: str = "2 hours", **aggregates: Column) -> DataFrame:
    """``(start, by..., n, ...)``: counts, and what else is asked for, by time window and group."""
    grouped = rows.withWatermark(time, late).groupBy(F.window(time, size).alias("w"), *by)
    return grouped.agg(F.count("*").alias("n"), *[v.alias(k) for k, v in aggregates.items()]).select(F.col("w.start").alias("start"), *by, "n", *aggregates)


def run_available(stream: DataFrame, name: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Works off what is there, into an in-memory table for reports and tests."""
    query = stream.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def append_files(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    query = stream.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query
