"""Importance resampling towards a target: n-grams from a table of word places, hashed to buckets whose gains are joined.

A text is taken apart into rows (document, place, word). Runs of more words come from ``lead`` over a document's places,
one column an order. Buckets of the runs are counted over all documents and over the target, a bucket's gain is the log
of its two shares, and a document's weight is the mean gain of its runs. A Gumbel draw by key makes the largest scores a
sample without replacement.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandmill.llm.common import materialize, table
from strandmill.operators.ranking import placed

#: Fixed values of the contract.
ORDERS, BUCKETS, SEED, MIN_WORDS, PERCENT = 1, 10_000, "2024:", 20, 10
#: Gains of up to so many buckets (16 bytes each) are sent to every task; more are shuffled.
BROADCAST_BUCKETS = 1_000_000

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
NO_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """Runs of digits, lower-cased ASCII letters and characters beyond ASCII; none for a null text."""
    return F.filter(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), NO_WORD), lambda w: w != "")


def word_places(rows: DataFrame, text: Column, keep: list[str]) -> DataFrame:
    """``keep``, ``pos`` and ``word``: a row for every word of a text, one without word for a text that has none."""
    return rows.select(*keep, F.posexplode_outer(words(text)).alias("pos", "word"))


def buckets_of(places: DataFrame, orders: int, buckets: int, keep: list[str]) -> DataFrame:
    """``keep``, ``bucket`` and ``first``: a row for every run of 1 to ``orders`` words, ``first`` true for single words.

    Following words come from a window over the places of a row (``keep[0]``); one order needs none, and no shuffle. A
    document without words keeps one row with null bucket.
    """
    runs, along = [F.col("word")], Window.partitionBy(keep[0]).orderBy("pos")
    for k in range(1, orders):
        runs.append(F.concat(runs[-1], F.lit(" "), F.lead("word", k).over(along)))  # null where the document ends
    hashed = [F.pmod(F.crc32(run.cast("binary")), F.lit(buckets)).cast("int") for run in runs]
    if orders == 1:
        return places.select(*keep, hashed[0].alias("bucket"), F.lit(True).alias("first"))
    listed = places.select(*keep, F.array(*[F.struct(h.alias("bucket"), F.lit(i == 0).alias("first")) for i, h in enumerate(hashed)]).alias("all"))
    return listed.select(*keep, F.inline(F.filter("all", lambda x: x["first"] | x["bucket"].isNotNull())))


def gains(docs: DataFrame, target: DataFrame, text: str = "text", target_text: str = "text", orders: int = ORDERS, buckets: int = BUCKETS) -> DataFrame:
    """``bucket, gain``: floor(1000 ln((t+1)(S+B) / ((s+1)(T+B)))) of each bucket that a run of any text falls into.

    Counts are of all texts; a task adds up its own before anything is shuffled, at most one row a bucket and side.
    """
    def counted(rows: DataFrame, column: str, side: str) -> DataFrame:
        there = rows.select(F.monotonically_increasing_id().alias("row"), F.col(column).cast("string").alias("text"))
        found = buckets_of(word_places(there, F.col("text"), ["row"]), orders, buckets, ["row"]).where("bucket is not null")
        return found.groupBy("bucket").agg(F.count("*").alias("n")).select("bucket", *[(F.col("n") if s == side else F.lit(0)).cast("long").alias(s) for s in ("s", "t")])

    both = counted(docs, text, "s").union(counted(target, target_text, "t")).groupBy("bucket").agg(F.sum("s").alias("s"), F.sum("t").alias("t"))
    known = materialize(both, "buckets")
    all_s, all_t = known.agg(F.coalesce(F.sum("s"), F.lit(0)), F.coalesce(F.sum("t"), F.lit(0))).first()
    s, t = F.col("s").cast("double"), F.col("t").cast("double")
    ratio = (t + 1) * F.lit(float(all_s + buckets)) / ((s + 1) * F.lit(float(all_t + buckets)))
    return known.select("bucket", F.floor(1000 * F.log(ratio)).alias("gain"))


def weigh(docs: DataFrame, gain: DataFrame, key: str = "doc_id", text: str = "text", orders: int = ORDERS, buckets: int = BUCKETS, seed: str = SEED) -> DataFrame:
    """``key, n_words, n_features, weight, score`` of each row of ``docs``.

    weight is the floored mean of the runs' gains, 0 without runs; score adds a Gumbel draw by key.
    """
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    found = buckets_of(word_places(rows, F.col("text"), ["row", "key"]), orders, buckets, ["row", "key"])
    joined = found.join(F.broadcast(gain) if buckets <= BROADCAST_BUCKETS else gain, "bucket", "left")
    summed = joined.groupBy("row", "key").agg(
        F.count_if(F.col("first") & F.col("bucket").isNotNull()).alias("n_words"), F.count("bucket").alias("n_features"), F.coalesce(F.sum("gain"), F.lit(0)).alias("gains"))
    n = F.col("n_features")
    mean = F.when(n == 0, F.lit(0)).otherwise(F.expr("(gains - pmod(gains, n_features)) div n_features"))
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(seed), F.coalesce(F.col("key").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("long")
    gumbel = F.floor(-1000 * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0))))
    return summed.select(F.col("key").alias(key), "n_words", "n_features", mean.cast("long").alias("weight"), (mean + gumbel).cast("long").alias("score"))


def resample(docs: DataFrame, target: DataFrame, key: str = "doc_id", text: str = "text", target_text: str = "text", orders: int = ORDERS, buckets: int = BUCKETS,
             seed: str = SEED, min_words: int = MIN_WORDS, percent: int = PERCENT) -> DataFrame:
    """``key, n_features, weight, score, rank``: a ``percent`` of the documents with ``min_words`` words, drawn towards ``target``.

    The draws are ranked from 1 by score, then key (null first), then weight and features; the others have a null rank.
    Rows of one key are rows as any other with one Gumbel draw; a null key draws as an empty one. A null text has no words.
    Empty tables count as no features. Scores are written once, and ranked over sorted ranges, never in one task.
    """
    scored = materialize(weigh(docs, gains(docs, target, text, target_text, orders, buckets), key, text, orders, buckets, seed), "scores")
    able = F.col("n_words") >= min_words
    drawn = percent * scored.where(able).count() // 100
    order = [F.desc("score"), F.col(key), F.desc("weight"), F.desc("n_features")]
    ranked = placed(scored.where(able), (), order, "rank").withColumn("rank", F.col("rank") + 1)
    every = ranked.union(scored.where(~able).withColumn("rank", F.lit(None).cast("long")))
    return every.select(key, "n_features", "weight", "score", F.when(F.col("rank") <= drawn, F.col("rank")).alias("rank"))


def op12_importance_resampling(spark, sf_dir):
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def oracle_sql() -> str:
    """The contract in SQL; CRC-32 of distinct words is a fold of their bytes over a table of 256 remainders."""
    pattern = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

    def found(name: str, columns: str) -> str:
        return f"SELECT {columns} unnest(regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{pattern}')) AS word FROM {name}"

    return f"""
WITH crc_table AS (
  SELECT list(list_reduce(range(8), lambda c, i: CASE WHEN c % 2 = 1 THEN xor(3988292384, c // 2) ELSE c // 2 END, b) ORDER BY b) AS remainders
  FROM (SELECT unnest(range(256)) AS b)
), in_docs AS ({found("documents", "doc_id,")}), in_target AS ({found("benchmark", "")}
), distinct_words AS (
  SELECT word, hex(encode(word)) AS h FROM (SELECT word FROM in_docs UNION SELECT word FROM in_target)
), hashed AS (
  SELECT word, xor(list_reduce(list_transform(range(1, length(h) // 2 + 1), lambda i: ('0x' || substr(h, 2 * i - 1, 2))::BIGINT),
                               lambda c, x: xor(c // 256, remainders[xor(c % 256, x) + 1]), 4294967295), 4294967295) % {BUCKETS} AS bucket
  FROM distinct_words, crc_table
), s AS (SELECT bucket, count(*) AS s FROM in_docs JOIN hashed USING (word) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS t FROM in_target JOIN hashed USING (word) GROUP BY bucket),
totals AS (SELECT (SELECT count(*) FROM in_docs)::DOUBLE AS all_s, (SELECT count(*) FROM in_target)::DOUBLE AS all_t),
gains AS (
  SELECT bucket, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * (all_s + {BUCKETS}) / ((s + 1)::DOUBLE * (all_t + {BUCKETS})))) AS gain
  FROM s LEFT JOIN t USING (bucket), totals
), sums AS (
  SELECT doc_id, count(*) AS n_features, floor(sum(gain) / count(*)) AS mean FROM in_docs JOIN hashed USING (word) JOIN gains USING (bucket) GROUP BY doc_id
), scored AS (
  SELECT doc_id, coalesce(n_features, 0)::BIGINT AS n_features, coalesce(mean, 0)::BIGINT AS weight,
         (coalesce(mean, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('{SEED}' || doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296))))::BIGINT AS score
  FROM documents LEFT JOIN sums USING (doc_id)
), ranked AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS r FROM scored WHERE n_features >= {MIN_WORDS})
SELECT doc_id, n_features, weight, score,
       CASE WHEN r <= (SELECT {PERCENT} * count(*) // 100 FROM ranked) THEN r END AS rank
FROM scored LEFT JOIN ranked USING (doc_id)"""
