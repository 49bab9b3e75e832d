"""Reports that gate a corpus: keyword support, duplicates by bucket, sidecar quality, splits, checks of what was written."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandmill.functions import scoring, text as t
from strandmill.operators.dedup import digest
from strandmill.operators.ranking import names
from strandmill.operators.sidecars import drop_reasons
from strandmill.operators.stats import rounded


def keyword_support(rows: DataFrame, text: str, key: str, candidates=scoring.CANDIDATE_LABELS, least: int = 50) -> DataFrame:
    """For each candidate label its rows, a snippet of the row with the smallest key, and whether to take it up.

    One pass: a row adds to every label by its booleans, and only the smallest hit of a task moves.
    """
    low = F.lower(t.text_of(text))
    labels = [(name, patterns, risk) for name, (patterns, risk) in candidates.items()]
    hit = lambda patterns: F.greatest(F.lit(False), *[low.contains(p) for p in patterns])
    first = lambda patterns: F.coalesce(*[F.when(low.contains(p), t.snippet(text, p)) for p in patterns])
    counted = rows.agg(*[x for i, (_, patterns, _) in enumerate(labels) for x in (
        F.count_if(hit(patterns)).alias(f"n{i}"), F.min(F.when(hit(patterns), F.struct(F.col(key), first(patterns).alias("s")))).alias(f"e{i}"))])
    each = F.array(*[F.struct(
        F.lit(name).alias("label"), F.lit(risk).alias("risk"), F.col(f"n{i}").alias("support"), F.col(f"e{i}.s").alias("example"),
        ((F.col(f"n{i}") >= least) & F.lit(risk != "high")).alias("recommended")) for i, (name, _, risk) in enumerate(labels)])
    return counted.select(F.explode(each).alias("x")).select("x.*")


def duplicates_by_bucket(scored: DataFrame, text: str, bucket: str) -> DataFrame:
    """How repeated the texts of each bucket are: rows, the mean size of their clusters, and the share in clusters of
    several. An empty text is a cluster of its own. Rows are counted by (text, bucket) before clusters are summed."""
    keyed = scored.select(digest(t.template(text)).alias("_key"), bucket).groupBy("_key", bucket).agg(F.count("*").alias("_c"))
    joined = keyed.withColumn("_size", F.sum("_c").over(Window.partitionBy("_key")))  # a key has a row for each bucket: texts are scored once
    size = F.when(F.col("_key").isNull(), 1).otherwise(F.col("_size"))
    return joined.groupBy(bucket).agg(
        F.sum("_c").alias("n"), F.round(F.sum(size * F.col("_c")) / F.sum("_c"), 6).alias("mean_cluster"),
        F.round(F.sum(F.when(size > 1, F.col("_c")).otherwise(0)) / F.sum("_c"), 6).alias("repeated_share"))


def split_strategy(rows: DataFrame, group: str, least: int = 2, prefer_groups: bool = True) -> DataFrame:
    """One row: which key to split by. Groups, if some repeat, so that none stands on both sides; else single rows."""
    sizes = rows.where(F.col(group).isNotNull()).groupBy(group).agg(F.count("*").alias("_n"))
    found = sizes.agg(F.count_if(F.col("_n") >= least).alias("repeated_groups"), F.coalesce(F.max("_n"), F.lit(0)).alias("largest"), F.coalesce(F.sum("_n"), F.lit(0)).alias("grouped_rows"))
    why = F.when(F.col("grouped_rows") == 0, "no_group_keys").when(F.lit(not prefer_groups), "groups_not_wanted").otherwise("no_repeated_groups")
    by_group = F.lit(prefer_groups) & (F.col("repeated_groups") > 0)
    return found.withColumns({"split_key": F.when(by_group, F.lit(group)).otherwise("row"), "fallback_reason": F.when(~by_group, why)})


def comment_report(rows: DataFrame, game: str, text: str, identity: list[str], by=()) -> DataFrame:
    """Rows, distinct games, rows a game, mean length, and the share of rows that repeat another's identity and text."""
    by = names(by)
    keyed = rows.select(*by, game, *[F.col(c) for c in identity if c not in (game, *by)], digest(t.normalize(text, "raw")).alias("_key"), F.length(t.text_of(text)).alias("_length"))
    counts = keyed.groupBy(*by, game, *[c for c in identity if c not in (game, *by)], "_key").agg(F.count("*").alias("_c"), F.sum("_length").alias("_l"))
    return counts.groupBy(*by).agg(
        F.sum("_c").alias("n"), F.count_distinct(game).alias("games"), F.round(F.sum("_c") / F.count_distinct(game), 6).alias("rows_per_game"),
        F.round(F.sum("_l") / F.sum("_c"), 6).alias("mean_length"), F.round(F.sum(F.col("_c") - 1) / F.sum("_c"), 6).alias("repeated_share"))


def match_report(aligned: DataFrame, split: str, note: str = "note", kind: str = "alignment_type") -> DataFrame:
    """Per split the rows, those matched, those ambiguous, and the rates; splits without rows are missing."""
    matched = F.col(kind) != "unmatched"
    return aligned.groupBy(split).agg(
        F.count("*").alias("n"), F.count_if(matched).alias("matched"), F.count_if(F.col(note).contains("ambigu")).alias("ambiguous"),
        F.round(F.count_if(matched) / F.count("*"), 6).alias("match_rate"))


def readiness_report(report: DataFrame, split: str, matched: str, rationale: str, leaked: Column) -> DataFrame:
    """One row: matched rows and rationales of each split, and the readiness they make."""
    at = lambda c, s: F.coalesce(F.sum(F.when(F.col(split) == s, F.col(c))), F.lit(0))
    splits = ("train", "val", "test")
    one = report.agg(*[at(matched, s).alias(f"{s}_matched") for s in splits], *[at(rationale, s).alias(f"{s}_rationales") for s in splits])
    status = scoring.readiness({s: F.col(f"{s}_matched") for s in splits}, {s: F.col(f"{s}_rationales") for s in splits[1:]}, leaked)
    return one.withColumn("status", status)


def label_coverage(labelled: DataFrame, labels: str, split: str, rare: int = 20) -> DataFrame:
    """Each label's rows by split, and whether it is rare."""
    return labelled.select(F.explode(labels).alias("label"), split).groupBy("label").agg(
        F.count("*").alias("n"), *[F.count_if(F.col(split) == s).alias(s) for s in ("train", "val", "test")], (F.count("*") < rare).alias("rare"))


def validation_reasons(rows: DataFrame, rules: list[tuple[str, Column]], by=()) -> DataFrame:
    """How many rows break a rule first, by rule; rows that break none are ``ok``."""
    reason = F.coalesce(drop_reasons(*rules), F.lit("ok")).alias("reason")
    return rows.select(*names(by), reason).groupBy(*names(by), "reason").agg(F.count("*").alias("n"))


def repeated_identities(rows: DataFrame, key: str) -> DataFrame:
    """One row: rows and those after the first of their key. Keys are counted before they are compared."""
    return rows.groupBy(key).agg(F.count("*").alias("_c")).agg(F.coalesce(F.sum("_c"), F.lit(0)).alias("n"), F.coalesce(F.sum(F.col("_c") - 1), F.lit(0)).alias("repeats"))


def verified(expected: DataFrame, found: DataFrame, keys: list[str], value: str, suspicious: Column | None = None) -> DataFrame:
    """One row: artifacts that are missing, that differ from what was recomputed, that look wrong, and the gate."""
    both = expected.select(*keys, F.col(value).alias("_want")).join(found.select(*keys, F.col(value).alias("_have"), F.lit(True).alias("_there")), keys, "left")
    odd = F.lit(False) if suspicious is None else suspicious
    counted = both.agg(
        F.count("*").alias("artifacts"), F.count_if(F.col("_there").isNull()).alias("missing"),
        F.count_if(F.col("_there") & ~F.col("_want").eqNullSafe(F.col("_have"))).alias("mismatched"), F.count_if(odd).alias("suspicious"))
    return counted.withColumn("gate", scoring.verification_gate(F.col("missing"), F.col("mismatched"), F.col("suspicious")))


def sanity_gate(metrics: DataFrame, regime: str, times: float = 100.0, spread: float = 0.01) -> DataFrame:
    """One row over the regimes of ``n, recall_at_1, mrr``: are all far above chance, do they agree, and the verdict."""
    above = F.min(F.when(F.col("recall_at_1") > times / F.col("n"), 1).otherwise(0)) == 1
    width = F.round(F.max("mrr") - F.min("mrr"), 6)
    found = metrics.agg(F.count_distinct(regime).alias("regimes"), F.coalesce(above, F.lit(False)).alias("above_chance"), width.alias("mrr_range"), F.coalesce(width <= spread, F.lit(False)).alias("stable"))
    return found.withColumn("verdict", F.when(F.col("above_chance") & F.col("stable"), "sane").when(F.col("above_chance"), "unstable").otherwise("not_above_chance"))


def rank_quality(ranked: DataFrame, rank: str, likelihood: str, subsets: dict[str, Column]) -> DataFrame:
    """Top-1, top-3 and top-5 rates and the mean loss, over all rows and over each subset; all in one pass."""
    def of(name: str, held: Column) -> Column:
        rate = lambda k: rounded(F.avg(F.when(held, (F.col(rank) <= k).cast("int")))).alias(f"top_{k}")
        return F.struct(F.lit(name).alias("subset"), F.count_if(held).alias("n"), rate(1), rate(3), rate(5), rounded(F.avg(F.when(held, F.col(likelihood)))).alias("loss")).alias(name)

    every = {"all": F.lit(True), **subsets}
    one = ranked.agg(*[of(name, F.coalesce(held, F.lit(False))) for name, held in every.items()])
    return one.select(F.explode(F.array(*every)).alias("x")).select("x.*")


def failures(ranked: DataFrame, rank: str) -> DataFrame:
    """Rows whose own key is not first."""
    return ranked.where(F.col(rank) > 1)


def summed_drop_reasons(settings: DataFrame, column: str = "settings") -> DataFrame:
    """``(reason, n)``: the drop reasons of all manifests added up; manifests without a report count for nothing."""
    found = settings.select(F.explode(F.from_json(column, "report struct<drop_reasons:map<string,bigint>>")["report"]["drop_reasons"]).alias("reason", "n"))
    return found.groupBy("reason").agg(F.sum("n").alias("n"))
