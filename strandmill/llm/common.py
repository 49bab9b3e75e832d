"""Shared helpers: table reading, shared-folder materialisation, exact hashes, connected components."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Words of the contracts, as the body of a regular expression.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``. Where it is unset, a local session gets one
    of its own, as in tests; a cluster has no folder that would be shared, so that is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        import tempfile

        found = tempfile.mkdtemp(prefix="strandmill-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def materialize(df: DataFrame, tag: str, replaces: DataFrame | None = None) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: cuts lineage and survives lost executors.

    ``replaces``, an earlier result of this function that nothing reads after ``df`` is written, is deleted.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/strandmill/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    if replaces is not None:
        delete(spark, replaces.written_to)
    return out


def tidy(spark: SparkSession) -> None:
    """Lets Spark drop shuffle files and broadcasts of steps that are done: its cleaner acts on what the driver's collector finds."""
    spark._jvm.System.gc()


def delete(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def join_hot(rows: DataFrame, values: DataFrame, key: str, count: str, total: int, least: int = 500, parts: int = 500) -> DataFrame:
    """``rows`` joined with ``values(key, ..., count)``, ``count`` being how many of the ``total`` rows have the key.

    Keys with more than a ``parts``-th of all rows, so fewer than ``parts`` of them, are joined where their rows lie;
    only the other rows are shuffled to their key.
    """
    hot = F.col(count) > max(least, total // parts)
    few = values.where(hot)
    there = rows.join(F.broadcast(few), key)
    rest = rows.join(F.broadcast(few.select(key)), key, "left_anti").join(values.where(~hot), key)
    return there.select(*rest.columns).union(rest)


def running_sum(rows: DataFrame, by: list[str], order: list[str], weight: Column, into: str, tag: str) -> DataFrame:
    """``rows`` with the sum of ``weight`` over the earlier rows of their group in ``order``, however large the group is.

    Rows are sorted over ranges of (group, order), which are written; windows run inside a range, and over the ranges'
    sums of a group.
    """
    ranged = materialize(rows.withColumn("_w", weight).repartitionByRange(*by, *order).sortWithinPartitions(*by, *order).withColumn("_range", F.spark_partition_id()), tag)
    here = F.sum("_w").over(Window.partitionBy(*by, "_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    sums = ranged.groupBy(*by, "_range").agg(F.sum("_w").alias("_s"))
    before = F.sum("_s").over(Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    starts = sums.select(*by, "_range", F.coalesce(before, F.lit(0)).alias("_before"))
    return ranged.withColumn("_here", F.coalesce(here, F.lit(0))).join(starts, [*by, "_range"]).withColumn(into, F.col("_before") + F.col("_here")).drop("_w", "_range", "_here", "_before")


def free_names(columns: list[str], *wanted: str) -> list[str]:
    """``wanted`` names, each with as many underscores as make it no column's name; Spark's names ignore case."""
    taken = {c.lower() for c in columns}
    out = []
    for name in wanted:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


@contextmanager
def arrow_rows(spark: SparkSession, rows: int) -> Iterator[None]:
    """Arrow batches of at most ``rows`` rows in what is planned inside: a batch of long rows lies outside the heap, once
    on each side of the Python worker, and is as large as its rows."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def keep_arrow_rows(spark: SparkSession, rows: int) -> None:
    """As ``arrow_rows``, from now on: for what is returned unplanned and written by the caller."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, str(rows))


def slices(batches, rows: int = 256):
    """Runs of at most ``rows`` rows of Arrow batches, without copies: what a function holds beside a batch stays small."""
    for batch in batches:
        for start in range(0, len(batch), rows):
            yield batch.slice(start, rows)


def text_slices(texts, most: int = 8_000_000):
    """Runs of an Arrow string array of about ``most`` bytes, without copies; a longer text is a run of its own."""
    start = size = 0
    for i, n in enumerate(pc.binary_length(texts).to_pylist()):
        if size and size + (n or 0) > most:
            yield texts.slice(start, i - start)
            start, size = i, 0
        size += n or 0
    if len(texts) > start:
        yield texts.slice(start)


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once per row, as the variable of a one-element transform."""
    return F.element_at(F.transform(F.array(value), body), 1)


def components(edges: DataFrame, tag: str = "components", max_rounds: int = 60) -> DataFrame:
    """Connected components of ``edges(a long, b long)`` as ``(node, component)``, component the smallest node.

    Alternates large-star and small-star steps: every step is one grouped minimum and one join, so a node with a
    hot number of links costs partial aggregates, never a list, and its links are joined where they lie. Each round is
    written to the shared folder, the one before is deleted, and the loop ends when a round leaves the edges as they were.
    """
    def star(links: DataFrame, larger: bool, total: int) -> DataFrame:
        """Large star: a node's larger neighbours link to its smallest; small star: its smaller ones and itself."""
        if larger:
            links = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = links.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"), F.count("*").alias("c"))
        moved = join_hot(links.where("b > a") if larger else links, low, "a", "c", total).select(F.col("b").alias("a"), F.col("m").alias("b"))
        out = moved if larger else moved.union(low.select("a", F.col("m").alias("b")))
        return out.where("a <> b").distinct()

    current = materialize(
        edges.where("a is not null and b is not null and a <> b")
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), tag)
    state = lambda: tuple(current.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
    mark = state()
    for _ in range(max_rounds):
        current = materialize(star(star(current, True, 2 * mark[0]), False, mark[0]), tag, current)
        tidy(edges.sparkSession)
        now = state()
        if now == mark:
            break
        mark = now
    else:
        raise RuntimeError(f"components did not settle within {max_rounds} rounds")
    return current.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
        current.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
