"""Queries of table versions, null controls, audits before and after cleaning, and regimes as bitmaps."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandmill.functions.hashing import split_of
from strandmill.operators import audits, controls, ranking, regimes, versions
from strandmill.plans.cases import CASES, cases, variants_sql
from strandmill.plans.curation import SPLIT, flags_sql
from strandmill.plans.evaluation import HALVES, halves
from strandmill.plans.registry import Registry, table

REGISTRY = Registry()
query = REGISTRY.query

SECOND = """SELECT o_orderkey, CASE WHEN o_orderkey % 97 = 3 THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice, CASE WHEN o_orderkey % 194 = 3 THEN NULL ELSE o_orderstatus END AS o_orderstatus, 1 AS written_at FROM orders WHERE o_orderkey % 211 <> 5
UNION ALL SELECT o_orderkey, o_totalprice * 2, o_orderstatus, 2 FROM orders WHERE o_orderkey % 301 = 7 UNION ALL SELECT -1 - o_orderkey, o_totalprice, o_orderstatus, 1 FROM orders WHERE o_orderkey % 401 = 9"""


def order_versions(spark, sf_dir):
    """Orders, and a version of them with a few rows changed, removed, added, and written twice."""
    table(spark, sf_dir, "orders").createOrReplaceTempView("version_orders")
    first = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus", F.lit(1).alias("written_at"))
    return first, spark.sql(SECOND.replace("FROM orders", "FROM version_orders"))


CHANGES = f"""b AS ({SECOND}), l AS (SELECT o_orderkey, o_totalprice, o_orderstatus FROM b QUALIFY row_number() OVER (PARTITION BY o_orderkey ORDER BY written_at DESC) = 1),
j AS (SELECT coalesce(a.o_orderkey, l.o_orderkey) AS o_orderkey, a.o_orderkey IS NULL AS added, l.o_orderkey IS NULL AS removed, a.o_totalprice IS DISTINCT FROM l.o_totalprice AS p, a.o_orderstatus IS DISTINCT FROM l.o_orderstatus AS s FROM orders a FULL JOIN l ON a.o_orderkey = l.o_orderkey),
c AS (SELECT o_orderkey, CASE WHEN added THEN 'added' WHEN removed THEN 'removed' ELSE 'changed' END AS status, CASE WHEN added OR removed THEN '' ELSE concat_ws(',', CASE WHEN p THEN 'o_totalprice' END, CASE WHEN s THEN 'o_orderstatus' END) END AS changed FROM j WHERE added OR removed OR p OR s)"""


def order_changes(spark, sf_dir):
    first, second = order_versions(spark, sf_dir)
    return versions.changes(first, second, "o_orderkey", ["o_totalprice", "o_orderstatus"], "written_at")


@query(f"WITH {CHANGES} SELECT * FROM c")
def version_changes(spark, sf_dir):
    """What changed between two versions; only key ranges whose fingerprints differ are joined."""
    return order_changes(spark, sf_dir).withColumn("changed", F.array_join("changed", ","))


@query(f"WITH {CHANGES} SELECT status, count(*) AS n, array_to_string(list_sort(list(o_orderkey))[1:50], ',') AS ids FROM c GROUP BY 1")
def version_report(spark, sf_dir):
    """How many keys changed, and the first fifty of each kind."""
    return versions.change_report(order_changes(spark, sf_dir), "o_orderkey").withColumn("ids", F.array_join(F.transform("ids", lambda x: x.cast("string")), ","))


@query("SELECT unnest(['same', 'shuffled', 'second']) AS version, unnest([true, true, false]) AS verified")
def version_lock(spark, sf_dir):
    """A table held against its lock: as it was, in another order, and changed."""
    first, second = order_versions(spark, sf_dir)
    columns = ["o_orderkey", "o_totalprice", "o_orderstatus"]
    lock = versions.table_lock(first, columns).select(F.col("n").alias("locked_n"), F.col("fingerprint").alias("locked"))
    parts = None
    for name, rows in (("same", first), ("shuffled", first.repartition(7, "o_totalprice")), ("second", second)):
        one = versions.table_lock(rows, columns).join(F.broadcast(lock)).select(F.lit(name).alias("version"), ((F.col("n") == F.col("locked_n")) & (F.col("fingerprint") == F.col("locked"))).alias("verified"))
        parts = one if parts is None else parts.union(one)
    return parts


def null_values(spark, sf_dir, n: int = 50):
    rows = halves(spark, sf_dir).select("id", "label", "a", "b")
    shuffled = controls.assignments(rows, "id", [F.col("id")], n, 17)
    return rows, controls.statistic(rows, "id", "a", "b", shuffled)


@query(f"WITH {HALVES} SELECT round(avg(list_dot_product(a, b)), 6) AS value, count(*) AS n FROM h")
def real_statistic(spark, sf_dir):
    """The statistic that controls are held against: how much the halves of vectors agree."""
    return controls.statistic(halves(spark, sf_dir), "id", "a", "b").select(F.round("value", 6).alias("value"), "n")


@query()
def null_controls(spark, sf_dir):
    """The real statistic against fifty permutations, and against one that gives no row a partner of its own label."""
    rows, nulls = null_values(spark, sf_dir)
    found = controls.falsification(controls.statistic(rows, "id", "a", "b"), nulls)
    deranged = ranking.derangement(rows.select("id", "label"), "label", [F.col("id")], "id").withColumn("control", F.lit(1))
    other = controls.statistic(rows, "id", "a", "b", deranged).select(F.col("value").alias("deranged"))
    rounded = [c if c in ("controls", "reached") else F.round(c, 6).alias(c) for c in (*found.columns, "deranged")]
    return found.join(F.broadcast(other)).select(*rounded)  # one row each


FLAGGED = flags_sql(CASES, "id", "split, source")


def scopes_sql() -> str:
    return f"""WITH {FLAGGED}, outcomes AS ({variants_sql().replace("SELECT variant, outcome, count(*) AS n FROM (", "", 1).rsplit(") GROUP BY 1, 2", 1)[0].replace(" AS outcome", " AS outcome, id")}),
kept_rows AS (SELECT 'before' AS variant, id FROM f UNION ALL SELECT variant, id FROM outcomes WHERE outcome = 'kept'), kept_lengths AS (SELECT variant, f.split, coalesce(f.source, 'unknown') AS source, length(plain_text) AS size, template_count > 1 AS repeated, categories <> '' AS flagged FROM kept_rows JOIN f USING (id)),
scoped AS (SELECT variant, 'all' AS scope, 'all' AS value, size, repeated, flagged FROM kept_lengths UNION ALL SELECT variant, 'split', split, size, repeated, flagged FROM kept_lengths UNION ALL SELECT variant, 'source', source, size, repeated, flagged FROM kept_lengths)
SELECT variant, scope, value, count(*) AS n, count(*) FILTER (repeated) AS repeated, count(*) FILTER (flagged) AS flagged, round(avg(size), 6) AS mean, max(size) AS max,
  list_sort(list(size))[round_even((count(*) - 1) * 0.5, 0)::BIGINT + 1] AS p50, list_sort(list(size))[round_even((count(*) - 1) * 0.9, 0)::BIGINT + 1] AS p90 FROM scoped GROUP BY 1, 2, 3"""


@query(scopes_sql())
def cleaning_audit(spark, sf_dir):
    """Rows, repeats, flags and lengths before and after each way of cleaning: of all, by split and by source, from one table of flags."""
    return audits.before_and_after(cases(spark, sf_dir), "text", "id", "split", "source", order=[F.col("id")]).drop("size")


FIELDS = "d AS (SELECT doc_id, {split} AS split, coalesce(nullif(source, ''), 'unknown') AS source, coalesce(lang, 'unknown') AS lang FROM documents)".format(split=SPLIT)
REGIMES = f"""{FIELDS}, v AS (SELECT 'lang' AS field, lang AS value, doc_id, split FROM d UNION ALL SELECT 'source', source, doc_id, split FROM d),
e AS (SELECT field, value FROM v GROUP BY 1, 2 HAVING count(*) >= 20 AND count(*) FILTER (split = 'test') >= 1),
m AS (SELECT field || ':' || value AS regime, d.split, d.doc_id FROM e, d WHERE (d.split = 'test') = (CASE field WHEN 'lang' THEN d.lang ELSE d.source END = value))"""


def regime_bits(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", split_of("doc_id").alias("split"), F.coalesce(F.nullif("source", F.lit("")), F.lit("unknown")).alias("source"), F.coalesce("lang", F.lit("unknown")).alias("lang"))
    return regimes.with_bits(rows, ["lang", "source"], "split", 20, 1)


@query(f"WITH {REGIMES} SELECT regime, split, count(*) AS n FROM m GROUP BY 1, 2")
def regime_sizes(spark, sf_dir):
    """Sizes of all holdout regimes, counted from one set of bits a row."""
    rows, known = regime_bits(spark, sf_dir)
    return regimes.sizes(rows, known, "split")


@query(f"WITH {REGIMES} SELECT regime, split, doc_id FROM m WHERE regime = (SELECT min(regime) FROM m)")
def regime_rows(spark, sf_dir):
    """The rows of one regime, by a test of their bits."""
    rows, known = regime_bits(spark, sf_dir)
    first = known.agg(F.min("regime")).first()[0]
    return regimes.rows_of(rows, known, first, "split").select("regime", "split", "doc_id")
