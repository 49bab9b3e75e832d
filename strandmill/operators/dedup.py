"""Exact duplicates under views of a text: summaries, top strings, keep-first rules and member lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandmill.functions import text as t
from strandmill.functions.hashing import rank_key
from strandmill.operators.ranking import first_n, names
from strandmill.sources.shared import written


def digest(column: Column) -> Column:
    """What is shuffled instead of a text: 128 bits of its SHA-256; null for an empty text, which has no copies."""
    return F.nullif(F.substring(F.sha2(column, 256), 1, 32), F.substring(F.sha2(F.lit(""), 256), 1, 32))


def clusters(rows: DataFrame, key: str, by=()) -> DataFrame:
    return rows.where(F.col(key).isNotNull()).groupBy(*names(by), key).agg(F.count("*").alias("size"))


def duplicate_summary(rows: DataFrame, key: str, by=()) -> DataFrame:
    """Rows, clusters of two or more, rows beyond the first of their cluster and their share, of each group.

    Clusters are those within a group. Rows without a key count among the rows only. Sizes are partially aggregated,
    so a cluster of a third of all rows is one count per task.
    """
    by = names(by)
    sized = rows.groupBy(*by, key).agg(F.count("*").alias("size"))
    many = F.col(key).isNotNull() & (F.col("size") > 1)
    extra = F.sum(F.when(many, F.col("size") - 1).otherwise(0))
    return sized.groupBy(*by).agg(
        F.sum("size").alias("total_rows"), F.count_if(many).alias("clusters"), extra.alias("duplicate_rows"),
        F.round(F.coalesce(extra / F.sum("size"), F.lit(0.0)), 6).alias("duplicate_share"), F.max(F.when(many, F.col("size")).otherwise(0)).alias("largest"))


def duplicate_views(rows: DataFrame, column: str, modes=t.MODES) -> DataFrame:
    """The summary under each normalisation, from one scan."""
    views = F.array(*[F.struct(F.lit(m).alias("mode"), digest(t.normalize(column, m)).alias("key")) for m in modes])
    return duplicate_summary(rows.select(F.explode(views).alias("v")).select("v.*"), "key", "mode")


def cross_identity(rows: DataFrame, key: str, identity: str) -> DataFrame:
    """Clusters whose rows stand at more than one identity: how many, and how many rows they hold."""
    pairs = rows.where(F.col(key).isNotNull()).groupBy(key, identity).agg(F.count("*").alias("n"))
    wide = pairs.groupBy(key).agg(F.count("*").alias("places"), F.sum("n").alias("n")).where("places > 1")
    return wide.agg(F.count("*").alias("clusters"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"))


def top_repeated(rows: DataFrame, text: str, source: str, k: int = 20, sources: int = 1000) -> DataFrame:
    """The ``k`` texts that repeat most, with the sources they come from as ``source:count`` in order.

    Texts are counted by digest; only the texts of the ``k`` largest counts, and those that tie with the last of them,
    are fetched. A text of more than ``sources`` sources is an error: that column holds no sources.
    """
    light = rows.select(digest(F.col(text)).alias("_key"), F.coalesce(F.col(source).cast("string"), F.lit("unknown")).alias("_source"), text)
    per_source = written(light.where("_key is not null").groupBy("_key", "_source").agg(F.count("*").alias("n")), "repeated")
    totals = per_source.groupBy("_key").agg(F.sum("n").alias("repeats"), F.count("*").alias("_sources")).where("repeats > 1")
    last = totals.orderBy(F.desc("repeats")).limit(k).agg(F.min("repeats")).first()[0] or 0
    top = totals.where(F.col("repeats") >= last)
    checked = top.withColumn("_ok", F.assert_true(F.col("_sources") <= sources, F.lit(f"a text of over {sources} sources"))).drop("_ok", "_sources")
    listed = per_source.join(checked.select("_key"), "_key").groupBy("_key").agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "_source", "n"))), ",").alias("sources"))
    texts = light.join(checked.select("_key"), "_key", "left_semi").groupBy("_key").agg(F.first(text).alias(text))
    return checked.join(listed, "_key").join(texts, "_key").orderBy(F.desc("repeats"), text).limit(k).select(text, "repeats", "sources")


def dedup(rows: DataFrame, key: Column, within: list[str], identity: str, keep: int, salt: str) -> DataFrame:
    """``rows`` that stay, with ``cluster_id``, ``cluster_size`` and ``keep_rank``: the first ``keep`` of each cluster by digest.

    A row with a null key is a cluster of its own.
    """
    own = F.coalesce(key, F.concat(F.lit("own:"), F.col(identity).cast("string")))
    keyed = rows.withColumn("cluster_id", F.concat(F.lit("dedup_"), F.substring(F.sha2(F.concat_ws(":", F.lit(salt), *[F.col(c).cast("string") for c in within], own), 256), 1, 16)))
    sizes = keyed.groupBy("cluster_id").agg(F.count("*").alias("cluster_size"))
    return first_n(keyed, "cluster_id", [rank_key(salt, identity), F.col(identity)], keep).join(sizes, "cluster_id")


def member_lists(kept: DataFrame, identity: str, salt: str) -> DataFrame:
    """One row a cluster: size, rows kept, and the kept identities in order. Lists hold at most ``keep`` rows."""
    return kept.groupBy("cluster_id").agg(
        F.max("cluster_size").alias("cluster_size"), F.count("*").alias("kept_size"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("keep_rank", F.col(identity).alias("id")))), lambda x: x["id"].cast("string")), ",").alias("members"))
