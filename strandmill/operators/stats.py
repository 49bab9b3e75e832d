"""Counts, shares, nearest-rank percentiles, moments and seeds' summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandmill.operators.ranking import names, running


def named(column: str, empty: str = "unknown") -> Column:
    """The value as text; null or empty is ``unknown``."""
    return F.coalesce(F.nullif(F.col(column).cast("string"), F.lit("")), F.lit(empty))


def rounded(x: Column, places: int = 6) -> Column:
    """``x`` to so many decimals, scaled in doubles as SQL engines do; ``F.round`` takes the shortest decimal: of 41 / 640,
    which is below 0.0640625, it makes 0.064063."""
    return F.round(x * 10.0**places) / 10.0**places


def count_by(rows: DataFrame, column: str) -> DataFrame:
    return rows.groupBy(named(column).alias(column)).agg(F.count("*").alias("n"))


def shares(counts: DataFrame, by=(), value: str = "n", into: str = "share") -> DataFrame:
    """``counts`` with each row's share of its group's sum; a group without anything has shares of 0."""
    total = F.sum(value).over(Window.partitionBy(*names(by)))
    return counts.withColumn(into, F.when(total > 0, F.round(F.col(value) / total, 6)).otherwise(0.0))


def pivot_counts(rows: DataFrame, by, column: str, values: list[str], total: str = "total") -> DataFrame:
    """A row per group with the count of each of ``values``, 0 where there is none, and of all rows."""
    return rows.groupBy(*names(by)).agg(
        F.count("*").alias(total), *[F.count_if(F.col(column) == v).alias(v) for v in values])


def label_of(p: float) -> str:
    return f"p{round(p * 100):d}"


def distribution(rows: DataFrame, by, value: str, percentiles=(0.5, 0.9), weight: str | None = None) -> DataFrame:
    """``n, mean, max`` and nearest-rank percentiles of each group.

    The rank is round-half-even((n - 1) * p). Equal values are counted before they move; running counts over ranges of
    the distinct values give the ranks, so one large group is ranked in many tasks. Nulls are not counted; no group, no row.
    A row with a ``weight`` counts as so many.
    """
    by = names(by)
    counted = rows.groupBy(*by, F.col(value).alias("_v")).agg((F.sum(weight) if weight else F.count("*")).alias("_c"), F.count(value).alias("_known"))
    counted = counted.where("_known > 0").drop("_known")  # nulls go by a count: a filter of the value would repeat below the projection all that makes it
    placed = running(counted, by, [F.col("_v")], F.col("_c"), "_before")
    sizes = placed.select(*by, "_v", "_c").groupBy(*by).agg(F.sum("_c").alias("n"), F.round(F.sum(F.col("_v") * F.col("_c")) / F.sum("_c"), 6).alias("mean"), F.max("_v").alias("max"))
    groups = sizes.select(*[F.col(c).alias(f"_by{i}") for i, c in enumerate(by)], "n", "mean", "max", *[F.bround((F.col("n") - 1) * F.lit(float(p))).cast("long").alias(f"_at{j}") for j, p in enumerate(percentiles)])
    first, last = F.col("_before"), F.col("_before") + F.col("_c")
    match = F.lit(True)
    for i, c in enumerate(by):
        match &= F.col(c).eqNullSafe(F.col(f"_by{i}"))
    found = placed.join(groups, match)
    return found.groupBy(*by, "n", "mean", "max").agg(*[
        F.min(F.when((F.col(f"_at{j}") >= first) & (F.col(f"_at{j}") < last), F.col("_v"))).alias(label_of(p)) for j, p in enumerate(percentiles)])


def mean_and_spread(rows: DataFrame, by, values: list[str]) -> DataFrame:
    """Means and sample deviations over the rows of a group, such as seeds; one row deviates by 0."""
    return rows.groupBy(*names(by)).agg(F.count("*").alias("runs"), *[x for v in values for x in (
        F.round(F.avg(v), 6).alias(f"{v}_mean"), F.round(F.coalesce(F.stddev_samp(v), F.lit(0.0)), 6).alias(f"{v}_std"))])


def plus_minus(mean: str, std: str) -> Column:
    return F.format_string("%.6f ± %.6f", F.col(mean), F.col(std))


def divergence(groups: DataFrame, values: list[str], into: str = "divergence") -> DataFrame:
    """The length of each group's vector of z-scores among the groups; a spread near 0 or of one group counts as 1."""
    everything = Window.partitionBy()

    def z(v: str) -> Column:
        spread = F.coalesce(F.stddev_samp(v).over(everything), F.lit(1.0))
        return (F.col(v) - F.avg(v).over(everything)) / F.when(spread < 1e-8, 1.0).otherwise(spread)

    total = F.lit(0.0)
    for v in values:
        total = total + z(v) * z(v)
    return groups.withColumn(into, F.round(F.sqrt(total), 6))


def missing_rates(rows: DataFrame, by, columns: list[str]) -> DataFrame:
    """The share of rows in which a column is null or blank."""
    blank = lambda c: F.col(c).isNull() | (F.trim(F.col(c).cast("string")) == "")
    return rows.groupBy(*names(by)).agg(F.count("*").alias("n"), *[F.round(F.count_if(blank(c)) / F.count("*"), 6).alias(f"{c}_missing") for c in columns])
