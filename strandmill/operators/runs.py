"""Summaries of runs joined and merged, epochs chosen, and deltas pooled over regimes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandmill.functions import scoring
from strandmill.operators.ranking import names
from strandmill.operators.retrieval import sign_statistics


def with_metrics(runs: DataFrame, others: DataFrame, keys: list[str], metrics: list[str], missing: float = 0.0) -> DataFrame:
    """Every run with the metrics that another summary has of it, ``missing`` where it has none."""
    found = runs.join(others.select(*keys, *metrics), keys, "left")
    return found.withColumns({m: F.coalesce(F.col(m), F.lit(missing)) for m in metrics})


def merged_subsets(runs: DataFrame, others: DataFrame, keys: list[str]) -> DataFrame:
    """Runs of either summary, with ``in_first`` and ``in_second``."""
    found = runs.withColumn("_a", F.lit(True)).join(others.withColumn("_b", F.lit(True)), keys, "full")
    return found.withColumns({"in_first": F.col("_a").isNotNull(), "in_second": F.col("_b").isNotNull()}).drop("_a", "_b")


def long_metrics(runs: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    """A row per run and metric."""
    return runs.unpivot(keys, metrics, "metric", "value")


def best_epochs(epochs: DataFrame, run, epoch: str, loss: str, grounding: list[str]) -> DataFrame:
    """The epoch of the least loss and that of the highest mean of grounding metrics, the earliest of equals.

    A run with an epoch that lacks a metric fails: choosing among the rest would hide it.
    """
    run = names(run)
    score = sum((F.col(c) for c in grounding[1:]), F.col(grounding[0])) / len(grounding)
    lacking = F.greatest(*[F.col(c).isNull() for c in (loss, *grounding)])
    checked = epochs.select(*run, epoch, F.when(lacking, F.raise_error(F.lit("an epoch lacks a metric"))).otherwise(F.col(loss)).cast("double").alias("_loss"), score.alias("_score"))
    found = checked.groupBy(*run).agg(
        F.min(F.struct("_loss", epoch)).alias("_policy"), F.max(F.struct("_score", (-F.col(epoch)).alias("e"))).alias("_grounding"))
    return found.select(
        *run, F.col(f"_policy.{epoch}").alias("policy_epoch"), (-F.col("_grounding.e")).alias("grounding_epoch"), F.round("_policy._loss", 6).alias("policy_metric"),
        F.round("_grounding._score", 6).alias("grounding_metric"), (F.col(f"_policy.{epoch}") == -F.col("_grounding.e")).alias("same_epoch"))


def pooled_comparison(deltas: DataFrame, regime: str, delta: str, by=()) -> DataFrame:
    """Deltas pooled over regimes: wins, losses, ties, the mean, the sign test's z, how many regimes lean either way,
    whether all lean as the pool does, and who wins."""
    by = names(by)
    pool = sign_statistics(deltas, delta, by)
    means = deltas.groupBy(*by, regime).agg(F.round(F.avg(delta), 6).alias("_mean"))
    regimes = means.groupBy(*by).agg(
        F.count("*").alias("regimes"), F.count_if(F.col("_mean") > 0).alias("regimes_up"), F.count_if(F.col("_mean") < 0).alias("regimes_down"))
    found = pool.join(regimes, by) if by else pool.crossJoin(regimes)  # one row each
    lean = F.signum("mean_delta")
    return found.withColumns({
        "consistent": F.when(lean > 0, F.col("regimes_up") == F.col("regimes")).when(lean < 0, F.col("regimes_down") == F.col("regimes")).otherwise(False),
        "winner": F.when(lean > 0, "first").when(lean < 0, "second").otherwise("tie")})


def regime_buckets(regimes: DataFrame, rows: str, groups: dict[str, Column]) -> DataFrame:
    """Regimes with the class of their pool's size and the named groups they are in; groups may overlap."""
    held = F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(name)) for name, c in groups.items()]))
    return regimes.withColumns({"pool": scoring.pool_class(F.col(rows)), "buckets": held})


def family_signals(aggregates: DataFrame, family: str, baseline: str, ap: str, f1: str) -> DataFrame:
    """Per family the best probe's gains over the best baseline, by average precision, and how strong they are."""
    best = lambda which: F.max(F.when(which, F.struct(F.col(ap).alias("ap"), F.col(f1).alias("f1"))))
    found = aggregates.groupBy(family).agg(best(~F.col(baseline)).alias("_p"), best(F.col(baseline)).alias("_b"))
    gains = found.select(family, *[F.round(F.coalesce(F.col(f"_p.{m}") - F.col(f"_b.{m}"), F.lit(0.0)), 6).alias(f"{m}_gain") for m in ("ap", "f1")])
    return gains.withColumn("signal", scoring.signal_state(F.col("ap_gain"), F.col("f1_gain")))


def overall_state(signals: DataFrame) -> DataFrame:
    """One row: what the weakest family allows."""
    n = F.count("*")
    return signals.agg(
        F.when((n > 0) & (F.count_if(F.col("signal") == "strong") == n), "READY_FOR_TINY_FROZEN_ALIGNMENT")
        .when((n > 0) & (F.count_if(F.col("signal") == "none") == 0), "STILL_EVAL_ONLY_BUT_STABLE").otherwise("DATA_EXPANSION_FIRST").alias("state"))
