"""First rows of groups, caps, quotas and stratified samples, by a stable order instead of the order of input."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandmill.functions.hashing import rank_key
from strandmill.sources.shared import written

#: Up to so many rows a group, Spark itself cuts each task's groups before the shuffle.
CUT_BEFORE_SHUFFLE = 1000


def names(keys) -> list[str]:
    return [keys] if isinstance(keys, str) else list(keys)


def first_n(rows: DataFrame, keys, order: list[Column], n: int, rank: str = "keep_rank", salts: int = 32) -> DataFrame:
    """The first ``n`` rows of each group by ``order``, with their rank from 1.

    A row beyond the first n of its part of a group is beyond the first n of the group. Small n are cut in every task
    before the shuffle; for larger ones the groups are dealt to ``salts`` parts first, so that a hot group is cut in
    many tasks.
    """
    keys = names(keys)
    if n > CUT_BEFORE_SHUFFLE:
        part = F.pmod(F.xxhash64(*order), F.lit(salts))
        rows = rows.withColumn("_part", part)
        rows = rows.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys, "_part").orderBy(*order))).where(F.col("_rank") <= n).drop("_part", "_rank")
    return rows.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(rank) <= n)


def cap(rows: DataFrame, keys, order: list[Column], most: int) -> DataFrame:
    """At most ``most`` rows a group; zero or less leaves all."""
    return rows if most <= 0 else first_n(rows, keys, order, most, "_kept").drop("_kept")


def cap_with_minimum(rows: DataFrame, keys, order: list[Column], most: int, minimum: int) -> DataFrame:
    """At most ``most`` rows a group, but never fewer than ``minimum`` of those there are."""
    return cap(rows, keys, order, max(most, minimum))


def group_sizes(rows: DataFrame, keys, into: str = "n") -> DataFrame:
    return rows.groupBy(*names(keys)).agg(F.count("*").alias(into))


def left_join_split(rows: DataFrame, side: DataFrame, key: str, counts: DataFrame | None = None, least: int = 500, parts: int = 500) -> DataFrame:
    """``rows`` left-joined with ``side``, which has a row for a key at most, without a task for a hot key.

    Keys of more than a ``parts``-th of all rows, so fewer than ``parts`` of them, meet their row of ``side`` where they
    lie; rows with a null key take no part in the join; only the others are shuffled to their key. ``counts(key, _n)``
    are the rows of each key, where they are known.
    """
    known = rows.where(F.col(key).isNotNull())
    counts = group_sizes(known, key, "_n") if counts is None else counts
    hot = written(counts.where(F.col("_n") > max(least, rows.count() // parts)).select(key), "hot-keys")
    added = [f for f in side.schema.fields if f.name != key]
    columns = [*rows.columns, *[f.name for f in added]]
    there = known.join(F.broadcast(side.join(F.broadcast(hot), key, "left_semi")), key, "left").join(F.broadcast(hot), key, "left_semi").select(*columns)
    rest = known.join(F.broadcast(hot), key, "left_anti").join(side.join(F.broadcast(hot), key, "left_anti"), key, "left").select(*columns)
    lone = rows.where(F.col(key).isNull()).select(*rows.columns, *[F.lit(None).cast(f.dataType).alias(f.name) for f in added])
    return there.union(rest).union(lone)


def quotas(sizes: DataFrame, by, stratum: str, limit: int) -> DataFrame:
    """Seats of each stratum, by largest remainders: ``(by..., stratum, n, quota)`` of rows ``(by..., stratum, n)``.

    A stratum gets the whole part of its share, never more than it has; seats that are left go to the largest
    remainders, then by name, to strata that have rows left. No limit, zero or less, means no seats. The windows run
    over strata, not rows.
    """
    by = names(by)
    whole = Window.partitionBy(*by)
    total = F.sum("n").over(whole)
    exact = F.lit(limit) * F.col("n") / total
    based = sizes.withColumns({"_all": total, "_base": F.least(F.col("n"), F.floor(exact)), "_rest": exact - F.floor(exact)})
    seats = F.least(F.lit(limit), F.col("_all")) - F.sum("_base").over(whole)
    place = F.row_number().over(whole.orderBy((F.col("_base") >= F.col("n")).cast("int"), F.desc("_rest"), stratum))
    first = based.withColumns({"_seats": seats, "_place": place}).withColumn("_got", F.col("_base") + ((F.col("_place") <= F.col("_seats")) & (F.col("_base") < F.col("n"))).cast("long"))
    # what a round could not seat fills strata by name
    left = F.greatest(F.lit(0), F.least(F.lit(limit), F.col("_all")) - F.sum("_got").over(whole))
    room = F.col("n") - F.col("_got")
    before = F.coalesce(F.sum(room).over(whole.orderBy(stratum).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    filled = first.withColumn("quota", F.col("_got") + F.greatest(F.lit(0), F.least(room, left - before)))
    return filled.select(*by, stratum, "n", F.when(F.lit(limit) > 0, F.col("quota")).otherwise(0).cast("long").alias("quota"))


def stratified_sample(rows: DataFrame, by, stratum: str, order: list[Column], limit: int) -> DataFrame:
    """``limit`` rows of each group, shared among its strata by :func:`quotas`, the first by ``order``."""
    by = names(by)
    seats = quotas(group_sizes(rows, [*by, stratum]), by, stratum, limit).drop("n")
    picked = first_n(rows, [*by, stratum], order, max(1, limit), "_place")
    return picked.join(seats, [*by, stratum]).where(F.col("_place") <= F.col("quota")).drop("_place", "quota")


def argmax(rows: DataFrame, keys, order: list[Column]) -> DataFrame:
    return first_n(rows, keys, order, 1, "_place").drop("_place")


def best_by(rows: DataFrame, keys, value: list[str], ordinal: str, payload: list[str]) -> DataFrame:
    """One row a group: that of the largest ``value``, the first of equals by ``ordinal``; aggregated before it moves."""
    key = F.struct(*[F.col(c).alias(f"v{i}") for i, c in enumerate(value)], (-F.col(ordinal)).alias("o"))
    return rows.groupBy(*names(keys)).agg(F.max_by(F.struct(*payload), key).alias("_best")).select(*names(keys), "_best.*")


def prefix_limit(rows: DataFrame, order: list[Column], passes: Column, most: int, by=()) -> DataFrame:
    """The first ``most`` rows that pass, in order, of each group: an early stop that does not depend on tasks."""
    return first_n(rows.where(passes), list(by), order, most, "_place").drop("_place") if by else rows.where(passes).orderBy(*order).limit(most)


def stride(rows: DataFrame, group: str, place: str, every: int, salt: str) -> DataFrame:
    """Every ``every``-th row of a group, starting at a phase that the group's digest gives."""
    phase = F.conv(F.substring(F.sha2(F.concat(F.lit(salt + ":"), F.col(group).cast("string")), 256), 1, 8), 16, 10).cast("long") % every
    return rows.where(F.pmod(F.col(place) - phase, F.lit(every)) == 0)


def running(rows: DataFrame, by, order: list[Column], weight: Column, into: str) -> DataFrame:
    """``rows`` with the sum of ``weight`` over the earlier rows of their group in ``order``, however large the group is.

    Rows are sorted over ranges of (group, order) and summed per range; only the ranges' sums are added up in order.
    The ranges are written before both results read them, as another run might cut them elsewhere.
    """
    by = names(by)
    ranged = written(rows.withColumn("_weight", weight).repartitionByRange(*by, *order).sortWithinPartitions(*by, *order).withColumns({
        "_range": F.spark_partition_id(), "_at": F.monotonically_increasing_id()}), "ranges")
    earlier = Window.unboundedPreceding, -1
    inside = ranged.withColumn("_in", F.coalesce(F.sum("_weight").over(Window.partitionBy(*by, "_range").orderBy("_at").rowsBetween(*earlier)), F.lit(0)))
    before = Window.partitionBy(*by).orderBy("_range").rowsBetween(*earlier)
    starts = ranged.groupBy(*by, "_range").agg(F.sum("_weight").alias("_n")).select(
        *[F.col(c).alias(f"_by{i}") for i, c in enumerate(by)], F.col("_range").alias("_of"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    same = F.col("_range") == F.col("_of")
    for i, c in enumerate(by):
        same &= F.col(c).eqNullSafe(F.col(f"_by{i}"))
    return inside.join(starts, same).select(*rows.columns, (F.col("_start") + F.col("_in")).cast("long").alias(into))


def placed(rows: DataFrame, by, order: list[Column], into: str = "place") -> DataFrame:
    """``rows`` with their place, from 0, within their group in ``order``, however large the group is."""
    return running(rows, by, order, F.lit(1), into)


def histories(rows: DataFrame, by: str, order: list[Column], key: str, value: str, size: int = 256) -> tuple[DataFrame, DataFrame]:
    """Histories of groups in a form that grows with the rows: ``(by, key, place, segment)`` of each row, and
    ``(by, segment, items)``, the values in order, ``size`` to a segment."""
    links = written(placed(rows, by, order, "place").select(by, key, "place", F.floor(F.col("place") / size).alias("segment"), F.col(value).alias("_value")), "histories")
    segments = links.groupBy(by, "segment").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "_value"))), lambda x: x["_value"]).alias("items"))
    return links.drop("_value"), segments


def whole_histories(links: DataFrame, segments: DataFrame, by: str, key: str) -> DataFrame:
    """``(by, key, history)``: all values of the group up to the row, its own among them. What it returns grows with the
    square of a group, so it is for groups like games; :func:`histories` holds the same for any group."""
    asked = links.withColumn("_segment", F.explode(F.sequence(F.lit(0).cast("long"), F.col("segment").cast("long"))))
    parts = asked.join(segments.select(by, F.col("segment").cast("long").alias("_segment"), "items"), [by, "_segment"])  # by segment, so one group is many tasks
    gathered = parts.groupBy(by, key, "place", "segment").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("_segment", "items"))), lambda x: x["items"])).alias("_all"))
    return gathered.select(by, key, F.slice("_all", F.lit(1), (F.col("place") + 1).cast("int")).alias("history"))


def rotation(rows: DataFrame, order: list[Column], key: str, by: int, n: int) -> DataFrame:
    """``(key, partner)``: rows in ``order``, each with the row ``by`` places on, around the end."""
    at = placed(rows, (), order, "_place").select(key, "_place")
    to = at.select(F.col(key).alias("partner"), "_place")
    return at.select(key, F.pmod(F.col("_place") + F.lit(by), F.lit(max(1, n))).alias("_place")).join(to, "_place").select(key, "partner")


def derangement(rows: DataFrame, label: str, order: list[Column], key: str) -> DataFrame:
    """``(key, partner)``: rows by label, turned by the largest label's size, so that no one has its own label.

    Fails if a label holds over half of the rows.
    """
    sizes = group_sizes(rows, label).agg(F.sum("n").alias("all"), F.max("n").alias("most")).first()
    if sizes["all"] and 2 * sizes["most"] > sizes["all"]:
        raise ValueError("a label holds over half of the rows: no derangement by rotation")
    return rotation(rows, [F.col(label), *order], key, sizes["most"] or 0, sizes["all"] or 0)


def permutation(rows: DataFrame, key: str, salt: str) -> DataFrame:
    """``(key, partner)``: every row once as a partner, by the order of a salted digest."""
    here = placed(rows.select(key), (), [F.col(key)], "_place")
    there = placed(rows.select(F.col(key).alias("partner")), (), [rank_key(salt, "partner"), F.col("partner")], "_place")
    return here.join(there, "_place").select(key, "partner")


def undominated(x: np.ndarray, others: np.ndarray | None = None) -> np.ndarray:
    """Which rows of ``x`` (more is better) no row of ``others``, or of ``x`` itself, dominates."""
    if others is not None:
        return np.array([not ((others >= r).all(1) & (others > r).any(1)).any() for r in x], bool)
    keep, best, n = np.zeros(len(x), bool), np.empty_like(x), 0
    for i in np.lexsort(-x.T[::-1]):  # whatever dominates a row comes before it
        if not ((best[:n] >= x[i]).all(1) & (best[:n] > x[i]).any(1)).any():
            keep[i], best[n], n = True, x[i], n + 1
    return keep


def sortable(values: np.ndarray) -> np.ndarray:
    """Doubles as integers of the same order, as SQL has it: zeros of both signs are equal, NaN is equal to itself and the largest."""
    bits = np.where(np.isnan(values), np.nan, values + 0.0).view(np.int64)
    return bits ^ ((bits >> 63) & np.iinfo(np.int64).max)


def skyline(rows: DataFrame, key: str, low: list[str], high: list[str], block_rows: int = 8192) -> DataFrame:
    """Rows that no other row dominates: at most in ``low``, at least in ``high``, and better in one.

    The rows are written first, as sums of doubles may come out otherwise when they are worked out again. Each task thins
    its rows, as what they dominate is dominated. The rest is written; blocks of it meet all other blocks, so a table that
    is nearly all skyline costs bounded tasks. A row with a null is compared with none and stays; a key may have many rows.
    """
    columns = low + high
    signs = np.array([-1] * len(low) + [1] * len(high))

    def held_as(table, names: list[str]) -> np.ndarray:
        return sortable(np.stack([table[c].to_numpy(zero_copy_only=False).astype(float) for c in names], 1)) * signs

    def thin(batches):  # in Arrow, as pandas takes NaN for null
        held = None
        for batch in batches:
            held = pa.Table.from_batches([*(held.to_batches() if held else []), batch])
            held = held.filter(pa.array(undominated(held_as(held, columns))))
        if held:
            yield from held.to_batches()

    few = written(rows.select(key, *columns), "rows")
    missing = F.exists(F.array(*[F.isnull(c) for c in columns]), lambda x: x)
    known = few.where(~missing)
    thinned = written(known.mapInArrow(thin, few.schema), "skyline")
    blocks = max(1, -(-thinned.count() // block_rows))
    numbered = thinned.withColumn("_b", F.pmod(F.xxhash64(*columns), F.lit(blocks)).cast("int"))
    every = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("_o")
    here, there = numbered.select(*columns, "_b", every), numbered.select(*[F.col(c).alias(f"o_{i}") for i, c in enumerate(columns)], F.col("_b").alias("_o"), every.alias("_b"))

    def beaten(own, other):
        kept = undominated(held_as(own, columns), undominated_rows(other))
        return own.select(columns).filter(pa.array(~kept))

    def undominated_rows(other) -> np.ndarray:
        x = held_as(other, [f"o_{i}" for i in range(len(columns))])
        return x[undominated(x)]

    lost = here.groupBy("_b", "_o").cogroup(there.groupBy("_b", "_o")).applyInArrow(beaten, few.select(*columns).schema).distinct()
    return thinned.join(lost, columns, "left_anti").select(*few.columns).union(few.where(missing))
