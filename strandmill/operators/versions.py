"""Versions of a table compared by order-free fingerprints: only key ranges that differ are joined."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandmill.operators.ranking import first_n
from strandmill.sources.shared import written

#: Children of a node of the tree; a bucket and its child tell 2^24 ranges of hashed keys apart.
FAN = 4096


def row_hash(columns: list[str]) -> Column:
    """64 bits of a row's values; nulls, and what stands in which column, count."""
    return F.xxhash64(*[x for c in columns for x in (F.col(c), F.col(c).isNull())])


def bucket(key: str) -> Column:
    return F.pmod(F.xxhash64(F.lit("bucket"), F.col(key)), F.lit(FAN * FAN))


def fingerprints(rows: DataFrame, node: Column, columns: list[str]) -> DataFrame:
    """``(node, n, total, mixed)``: rows of each node, the sum of their hashes, and the sum of other ones.

    Sums do not depend on order, partitions or tasks, and repeated rows count as often as they are there.
    """
    other = F.xxhash64(F.lit("other"), row_hash(columns))
    return rows.groupBy(node.alias("node")).agg(F.count("*").alias("n"), F.sum(row_hash(columns).cast("decimal(38,0)")).alias("total"), F.sum(other.cast("decimal(38,0)")).alias("mixed"))


def table_lock(rows: DataFrame, columns: list[str]) -> DataFrame:
    """One row: rows and fingerprint of a whole table, as text that a lock file keeps."""
    one = rows.agg(F.count("*").alias("n"), F.coalesce(F.sum(row_hash(columns).cast("decimal(38,0)")), F.lit(0)).alias("total"))
    return one.select("n", F.md5(F.concat_ws(":", F.col("n").cast("string"), F.col("total").cast("string"))).alias("fingerprint"))


def differing(before: DataFrame, after: DataFrame) -> DataFrame:
    """Nodes of which two sets of fingerprints differ, and how often each has rows; a tree's node has ``FAN`` children at most."""
    a, b = before.alias("a"), after.alias("b")
    same = F.col("a.n").eqNullSafe(F.col("b.n")) & F.col("a.total").eqNullSafe(F.col("b.total")) & F.col("a.mixed").eqNullSafe(F.col("b.mixed"))
    return a.join(b, F.col("a.node") == F.col("b.node"), "full").where(~same).select(F.coalesce("a.node", "b.node").alias("node"))


def suspects(before: DataFrame, after: DataFrame, key: str, columns: list[str]) -> tuple[DataFrame, DataFrame]:
    """The rows of both versions whose range of hashed keys differs: of few buckets first, then of their children.

    Both steps read keys and compared columns and shuffle one row a node and task; rows with a null key are left out.
    """
    keyed = [v.where(F.col(key).isNotNull()).withColumn("_b", bucket(key)) for v in (before, after)]
    top = F.floor(F.col("_b") / FAN)
    first = written(differing(*[fingerprints(v, top, columns) for v in keyed]), "buckets")
    inside = [v.join(F.broadcast(first), top == F.col("node"), "left_semi") for v in keyed]  # at most FAN rows
    leaves = written(differing(*[fingerprints(v, F.col("_b"), columns) for v in inside]), "leaves")
    few = F.broadcast(leaves) if leaves.count() <= 1_000_000 else leaves
    found = [v.join(few, F.col("_b") == F.col("node"), "left_semi").drop("_b") for v in inside]
    return found[0], found[1]


def changes(before: DataFrame, after: DataFrame, key: str, columns: list[str], order: str | None = None) -> DataFrame:
    """``(key, status, changed)``: keys that were added, removed or changed, with the columns that differ.

    Of rows of one key the last by ``order`` counts; without an order keys must be unique. Only rows of ranges that
    differ are joined, in proportion to the change.
    """
    def last(rows: DataFrame) -> DataFrame:
        if order is None:
            return rows.select(key, F.struct(*columns).alias("_row"))
        return rows.groupBy(key).agg(F.max_by(F.struct(*columns), order).alias("_row"))

    a, b = (last(v) for v in suspects(before, after, key, [*columns, *([order] if order else [])]))
    both = a.withColumnRenamed("_row", "_a").join(b.withColumnRenamed("_row", "_b"), key, "full")
    changed = F.array_compact(F.array(*[F.when(~F.col(f"_a.{c}").eqNullSafe(F.col(f"_b.{c}")), F.lit(c)) for c in columns]))
    status = F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "removed").when(F.size(changed) > 0, "changed")
    return both.select(key, status.alias("status"), F.when(status == "changed", changed).otherwise(F.array().cast("array<string>")).alias("changed")).where("status is not null")


def change_report(found: DataFrame, key: str, sample: int = 50) -> DataFrame:
    """``(status, n, ids)``: how many keys of each status, and the first ``sample`` of them."""
    listed = first_n(found, "status", [F.col(key)], sample, "_place").groupBy("status").agg(F.array_sort(F.collect_list(key)).alias("ids"))  # so many at most
    return found.groupBy("status").agg(F.count("*").alias("n")).join(listed, "status")
