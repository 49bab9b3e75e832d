"""Joins that enrich rows, align sidecars to a base table through a cascade of keys, and compare splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandmill.operators.ranking import best_by, left_join_split, names


def enrich(rows: DataFrame, details: DataFrame, key: str, value: list[str], ordinal: str, payload: list[str], keep_unmatched: bool = True) -> DataFrame:
    """``rows`` with the best detail row of their key: largest ``value``, the first of equals. One row stays one row."""
    return rows.join(best_by(details, key, value, ordinal, payload), key, "left" if keep_unmatched else "inner")


def candidates(base: DataFrame, keys: list[str], split: str, payload: list[str], tag: str) -> DataFrame:
    """How many base rows a key has, in how many splits, and the row itself where it is the only one."""
    known = base.where(F.col(keys[0]).isNotNull())
    return known.groupBy(*keys).agg(
        F.count("*").alias(f"{tag}_n"), F.count_distinct(F.nullif(split, F.lit(""))).alias(f"{tag}_splits"), F.min(F.struct(*payload)).alias(f"{tag}_row"))


def align(rows: DataFrame, base: DataFrame, exact: str, loose: str, extra: str | None, split: str, payload: list[str]) -> DataFrame:
    """``rows`` with ``matched_*``, ``alignment_type``, ``confidence`` and ``note``.

    One base row with the exact key matches. Of several, the one that also agrees in ``extra`` does if it is alone;
    else the row stays unmatched, within a split or across splits. Only without any exact row is the loose key tried
    the same way, with less confidence. Every base table is aggregated by its key before the join, and a key that very many
    rows share, such as that of empty texts, is joined where its rows lie.
    """
    found = left_join_split(rows, candidates(base, [exact], split, payload, "e"), exact)
    found = left_join_split(found, candidates(base, [loose], split, payload, "l"), loose)
    if extra:
        found = found.join(candidates(base, [exact, extra], split, payload, "ex"), [exact, extra], "left").join(candidates(base, [loose, extra], split, payload, "lx"), [loose, extra], "left")
    else:
        found = found.withColumns({c: F.lit(None) for c in ("ex_n", "lx_n", "ex_row", "lx_row")})
    n = lambda c: F.coalesce(F.col(c), F.lit(0))
    case = (F.when(n("e_n") == 1, "exact").when((n("e_n") > 1) & (n("ex_n") == 1), "exact_extra").when(n("e_n") > 1, "ambiguous")
            .when(n("l_n") == 1, "loose").when((n("l_n") > 1) & (n("lx_n") == 1), "loose_extra").when(n("l_n") > 1, "ambiguous_loose").otherwise("none"))
    found = found.withColumn("_case", case)
    note = (F.when(F.col("_case") == "ambiguous", F.when(F.col("e_splits") > 1, "cross_split_ambiguity").otherwise("ambiguous_within_split"))
            .when(F.col("_case") == "ambiguous_loose", F.when(F.col("l_splits") > 1, "cross_split_ambiguity").otherwise("ambiguous_within_split"))
            .when(F.col("_case") == "none", "no_base_match"))
    pick = lambda c: F.when(F.col("_case") == "exact", F.col(f"e_row.{c}")).when(F.col("_case") == "loose", F.col(f"l_row.{c}"))
    if extra:
        plain = pick
        pick = lambda c: plain(c).when(F.col("_case") == "exact_extra", F.col(f"ex_row.{c}")).when(F.col("_case") == "loose_extra", F.col(f"lx_row.{c}"))
    confidence = F.when(F.col("_case").isin("exact", "exact_extra"), 1.0).when(F.col("_case") == "loose_extra", 0.85).when(F.col("_case") == "loose", 0.75).otherwise(0.0)
    kind = F.when(F.col("_case").isin("ambiguous", "ambiguous_loose", "none"), "unmatched").otherwise(F.col("_case"))
    return found.select(*rows.columns, *[pick(c).alias(f"matched_{c}") for c in payload], kind.alias("alignment_type"), confidence.alias("confidence"), note.alias("note"))


def leakage(rows: DataFrame, key: str, split: str) -> DataFrame:
    """``(pair, shared)``: keys that occur in both splits of each pair."""
    has = rows.where(F.col(key).isNotNull()).groupBy(key).agg(*[F.bool_or(F.col(split) == s).alias(s) for s in ("train", "val", "test")])
    pairs = [("train", "val"), ("train", "test"), ("val", "test")]
    counted = has.agg(*[F.count_if(F.col(a) & F.col(b)).alias(f"{a}_{b}") for a, b in pairs])
    return counted.select(F.explode(F.array(*[F.struct(F.lit(f"{a}_{b}").alias("pair"), F.col(f"{a}_{b}").alias("shared")) for a, b in pairs])).alias("x")).select("x.*")


def split_diff(before: DataFrame, after: DataFrame, key: str, split: str) -> DataFrame:
    """One row: keys whose split stayed, changed, went or came."""
    a, b = before.select(key, F.col(split).alias("a"), F.lit(True).alias("was")), after.select(key, F.col(split).alias("b"), F.lit(True).alias("is"))
    both = F.col("was").isNotNull() & F.col("is").isNotNull()
    return a.join(b, key, "full").agg(
        F.count_if(both & F.col("a").eqNullSafe(F.col("b"))).alias("unchanged"), F.count_if(both & ~F.col("a").eqNullSafe(F.col("b"))).alias("changed"),
        F.count_if(F.col("is").isNull()).alias("only_before"), F.count_if(F.col("was").isNull()).alias("only_after"))


def split_hygiene(rows: DataFrame, group: str, split: str) -> DataFrame:
    """Groups that stand in several splits, or in none: what must be empty before training."""
    return rows.groupBy(group).agg(F.count_distinct(split).alias("splits"), F.count_if(F.col(split).isNull()).alias("unassigned")).where("splits <> 1 or unassigned > 0")


def common_keys(variants: list[DataFrame], key: str) -> DataFrame:
    """Keys of every variant."""
    tagged = None
    for i, v in enumerate(variants):
        one = v.select(key).distinct().withColumn("_v", F.lit(i))
        tagged = one if tagged is None else tagged.union(one)
    return tagged.groupBy(key).agg(F.count("*").alias("_n")).where(F.col("_n") == len(variants)).select(key)


def restrict_test(rows: DataFrame, keys: DataFrame, key: str, split: str) -> DataFrame:
    """Test rows of the given keys only; train and val stay as they are."""
    return rows.where(F.col(split) != "test").union(rows.where(F.col(split) == "test").join(keys, key, "left_semi").select(*rows.columns))


def in_regime(field: Column, split: str, value: str) -> Column:
    """Whether a row is in the regime that holds ``value`` out: as a test row of it, or a train or val row of another."""
    own = F.coalesce(field, F.lit("unknown")) == F.lit(value)
    return F.when(F.col(split) == "test", own).otherwise(~own)


def holdout_sizes(rows: DataFrame, field: Column, split: str, eligible: DataFrame, value: str = "value") -> DataFrame:
    """``(regime, split, n)`` of every regime: of test the value's own rows, of the rest all but the value's own.

    Rows are counted once by value and split; a regime's sizes are differences of counts, so no row is copied.
    """
    counts = rows.groupBy(F.coalesce(field, F.lit("unknown")).alias("_value"), F.col(split).alias("split")).agg(F.count("*").alias("_own"))
    totals = counts.groupBy("split").agg(F.sum("_own").alias("_all"))  # a row a split
    regimes = eligible.select(F.col(value).alias("_value")).distinct().withColumn("split", F.explode(F.array(*map(F.lit, ("train", "val", "test")))))
    sized = regimes.join(counts, ["_value", "split"], "left").join(F.broadcast(totals), "split").withColumn("_own", F.coalesce("_own", F.lit(0)))
    return sized.select(F.col("_value").alias("regime"), "split", F.when(F.col("split") == "test", F.col("_own")).otherwise(F.col("_all") - F.col("_own")).alias("n"))
