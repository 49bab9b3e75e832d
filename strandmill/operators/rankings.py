"""Many rankings of one scan: each task keeps the best rows of every order, one shuffle brings those together."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandmill.operators.ranking import names

#: Rows that a task holds for all rankings and groups; beyond it they are handed on and thinned once more behind the shuffle.
HELD = 200_000


@dataclass(frozen=True)
class Ranking:
    """The first ``k`` rows of each group by numeric ``order`` (descending where marked), then by the tie column."""

    name: str
    order: tuple[tuple[Column, bool], ...]
    k: int = 10
    where: Column | None = None


def top_many(rows: DataFrame, rankings: list[Ranking], tie: str, by=(), payload: tuple[str, ...] = ()) -> DataFrame:
    """``(ranking, by..., place, tie, payload...)``: all rankings of all groups, places from 1.

    Rows are read once. A task keeps at most k rows of a ranking and group, so its part of the shuffle is bounded by
    the number of groups, not of rows, and a hot group is cut in every task. A null in an order comes last, rows that
    tie in everything keep either order. An empty table has no ranks.
    """
    by, width = names(by), max(len(r.order) for r in rankings)

    def key(r: Ranking) -> Column:
        parts = [F.when(c.isNull(), float("inf")).otherwise((-c if down else c).cast("double")) for c, down in r.order]
        return F.struct(F.lit(r.name).alias("ranking"), F.lit(r.k).alias("_k"), *[(parts[i] if i < len(parts) else F.lit(0.0)).alias(f"_o{i}") for i in range(width)])

    listed = F.array_compact(F.array(*[F.when(F.coalesce(r.where, F.lit(False)) if r.where is not None else F.lit(True), key(r)) for r in rankings]))
    kept = list(dict.fromkeys([*by, tie, *payload]))
    every = rows.select(*kept, F.explode(listed).alias("_r")).select("_r.*", *kept)
    order, group = [f"_o{i}" for i in range(width)], ["ranking", *by]

    def thin(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for batch in batches:
            held = batch if held is None else pd.concat([held, batch], ignore_index=True)
            held = held.sort_values([*order, tie], kind="stable")
            held = held[held.groupby(group, dropna=False, sort=False).cumcount() < held["_k"]]
            if len(held) > HELD:
                yield held
                held = None
        if held is not None:
            yield held

    best = every.mapInPandas(thin, every.schema)
    place = F.row_number().over(Window.partitionBy(*group).orderBy(*order, tie))
    return best.withColumn("place", place.cast("long")).where(F.col("place") <= F.col("_k")).select("ranking", *by, "place", *[c for c in kept if c not in by])
