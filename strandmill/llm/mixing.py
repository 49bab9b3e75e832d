"""Mixing sources to target weights: hash-threshold histograms, refined in the boundary bucket only, without sorting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandmill.llm.common import materialize

WEIGHTS = (3, 1, 2)
#: Bits of the 32-bit hash by level: a first histogram, then one inside the boundary bucket, then one inside that.
LEVELS = (12, 12, 8)


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def hash32(key: Column) -> Column:
    """The first 32 bits of the key's MD5."""
    return F.conv(F.substring(F.md5(key.cast("string").cast("binary")), 1, 8), 16, 10).cast("long")


def source_targets(rows: DataFrame, weights=WEIGHTS, share: float = 1.5, limit: float = 2.0) -> DataFrame:
    """A row per source: ``k``, ``source_size``, ``target``.

    Targets are least(limit * size, level * weight), with the one level at which they add up to the share of all
    sizes. Taking sources in the order of limit * size / weight, each has a level at which the rest would share what
    the earlier ones, held at their limits, leave; the largest of these levels is the one. Three windows run over all
    sources in one task: good for some millions of sources, whatever the number of documents.
    """
    sums = rows.groupBy("k", "source").agg(F.sum("size").alias("source_size"))
    places = Window.orderBy(F.col("source").asc_nulls_last())
    weighed = sums.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.row_number().over(places) - 1, F.lit(len(weights))) + 1).cast("int")))
    rising = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    left = F.lit(share) * F.sum("source_size").over(everything) - F.lit(limit) * (F.sum("source_size").over(rising) - F.col("source_size"))
    among = F.sum("weight").over(everything) - (F.sum("weight").over(rising) - F.col("weight"))
    level = F.max("level").over(everything)
    return weighed.withColumn("level", left / among).select("k", "source_size", F.least(F.lit(limit) * F.col("source_size"), level * F.col("weight")).alias("target"))


def thresholds(rows: DataFrame, targets: DataFrame) -> DataFrame:
    """``targets`` with ``whole`` (times all of a source is taken) and ``below``: smaller hashes are taken once more.

    Each level sums sizes by source and hash bucket within the last boundary bucket, and the running sums over the
    buckets (never over documents) say in which the rest of the budget ends. The last boundary, one hash value, is
    taken if that comes nearer to the target.
    """
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    state = targets.withColumn("whole", whole).withColumns({
        "rest": F.col("target") - F.col("whole") * F.col("source_size"), "prefix": F.lit(0).cast("long"), "before": F.lit(0).cast("long"), "mass": F.lit(0).cast("long")})
    used = 0
    for bits in LEVELS:
        shift = 32 - used - bits
        inside = rows.join(state.select("k", "prefix"), "k").where(F.shiftright("h", 32 - used) == F.col("prefix")) if used else rows
        sums = inside.groupBy("k", F.shiftright("h", shift).alias("bucket")).agg(F.sum("size").alias("size"))
        running = F.sum("size").over(Window.partitionBy("k").orderBy("bucket"))
        cut = (sums.join(state.select("k", "rest", "before"), "k").withColumn("upto", F.col("before") + running).where("upto > rest")
               .groupBy("k").agg(F.min_by(F.struct("bucket", (F.col("upto") - F.col("size")).alias("start"), "size"), "bucket").alias("cut")))
        state = materialize(state.drop("prefix", "before", "mass").join(cut, "k", "left").select(
            "k", "source_size", "target", "whole", "rest", F.coalesce("cut.bucket", F.lit(0)).alias("prefix"),
            F.coalesce("cut.start", F.lit(0)).alias("before"), F.coalesce("cut.size", F.lit(0)).alias("mass")), "mix-level")
        used += bits
    take = F.col("before") + F.col("mass") - F.col("rest") < F.col("rest") - F.col("before")
    return state.select("k", "source_size", "target", "whole", (F.col("prefix") + take.cast("long")).alias("below"))


def with_hash(docs: DataFrame, key: str, source: str, text: str) -> DataFrame:
    """``docs`` with ``_k``, the source as a key that holds null too, and ``_h``, the hash of the row's key, or of its
    text where there is no key."""
    name = F.col(source).cast("string")
    return docs.withColumns({"_k": F.when(name.isNull(), "n").otherwise(F.concat(F.lit("s"), name)), "_h": hash32(F.coalesce(F.col(key).cast("string"), F.concat(F.lit("text "), F.md5(F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary")))))})


def source_limits(rows: DataFrame, weights, share: float, broadcast_rows: int = 100_000) -> DataFrame:
    """Targets and thresholds of ``rows(k, source, size, h)``: a row per source, broadcast while there are few."""
    limits = materialize(thresholds(rows, materialize(source_targets(rows, weights, share), "mix-targets")).withColumnRenamed("k", "_k"), "mix-limits")
    return F.broadcast(limits) if limits.count() <= broadcast_rows else limits


def copies(limit: float = 2.0) -> Column:
    """How often a row is taken; a source at its limit takes none once more, were it without words."""
    return F.least(F.col("whole") + (F.col("_h") < F.col("below")).cast("long"), F.lit(int(limit)))


def light(docs: DataFrame, key: str, text: str, source: str) -> DataFrame:
    rows = with_hash(docs.select(F.col(key).alias("key"), F.col(source).cast("string").alias("source"), F.col(text).cast("string").alias("text")), "key", "source", "text")
    return materialize(rows.select("key", "source", word_count(F.col("text")).alias("size"), F.col("_k").alias("k"), F.col("_h").alias("h")), "mix-rows")


def mix(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", weights=WEIGHTS, share: float = 1.5) -> DataFrame:
    """``(key, size, source_size, target, copies, taken)``: how often each document goes into the mix.

    Sources are ordered by code point, null last and one of them; their targets follow :func:`source_targets`.
    Documents are taken by the hash of their key, so reruns agree and a larger budget takes a superset. Rows of one
    key and source go together; a null text has size 0, rows without a key go by their texts, and an empty table gives an
    empty one. Sums are aggregated before they are shuffled, so a hot source costs no more than another.
    """
    rows = light(docs, key, text, source)
    limits = source_limits(rows, weights, share)
    return rows.withColumnsRenamed({"k": "_k", "h": "_h"}).join(limits, "_k").select(
        F.col("key").alias(key), "size", "source_size", "target", copies().alias("copies"), (F.col("size") * copies()).alias("taken"))


def mixed_copies(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", weights=WEIGHTS, share: float = 1.5) -> DataFrame:
    """The mix itself: rows of ``docs`` as often as they are taken. Texts are not shuffled; columns of any name pass."""
    limits = source_limits(light(docs, key, text, source), weights, share).select("_k", "whole", "below")
    took = with_hash(docs.withColumnsRenamed({c: f"_{i}" for i, c in enumerate(docs.columns)}), *(f"_{docs.columns.index(c)}" for c in (key, source, text))).join(limits, "_k")
    return took.select("*", F.explode(F.array_repeat(F.lit(0), copies().cast("int")))).select(*[F.col(f"_{i}").alias(c) for i, c in enumerate(docs.columns)])


def op7_mix_sources(spark, sf_dir):
    from strandmill.llm.common import table

    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def oracle_sql() -> str:
    return r"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
             ('0x' || substr(md5(coalesce(doc_id::VARCHAR, 'null')), 1, 8))::BIGINT AS h FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, [3, 1, 2][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS weight FROM s),
r AS (SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - 2.0::DOUBLE * (sum(source_size) OVER o - source_size)) / (sum(weight) OVER () - (sum(weight) OVER o - weight)) AS level
      FROM w WINDOW o AS (ORDER BY source_size / weight, source NULLS LAST)),
t AS (SELECT source, source_size, least(2.0::DOUBLE * source_size, max(level) OVER () * weight) AS target FROM r),
f AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS whole FROM t),
g AS (SELECT *, target - whole * source_size AS rest FROM f),
c AS (SELECT d.*, source_size, target, whole, rest, (sum(size) OVER (PARTITION BY d.source ORDER BY h))::BIGINT AS upto, (sum(size) OVER (PARTITION BY d.source, h))::BIGINT AS mass
      FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, size, source_size, target,
       size * (whole + CASE WHEN upto <= rest THEN 1 WHEN upto - mass <= rest AND upto - rest < rest - (upto - mass) THEN 1 ELSE 0 END)::BIGINT AS taken FROM c"""
