"""Queries of text retrieval: family texts, aligned targets, ranks of snippets among whole documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandmill.functions import text as t
from strandmill.operators import retrieval, stats, text_retrieval
from strandmill.plans.curation import SPLIT, T, documents
from strandmill.plans.evaluation import METRICS
from strandmill.plans.registry import Registry, table

REGISTRY = Registry()
query = REGISTRY.query

#: A row of each family, made of the tables: conversations give texts or messages, parts give tags, orders give remarks.
#: The same text is SQL of both engines.
FAMILY_PARTS = {
    "aux": """SELECT concat('aux:', conv_id) AS id, 'aux_board_anchored' AS family, '' AS strategy, '' AS tactic, CASE WHEN conv_id % 3 = 0 THEN concat('  ', max(CASE WHEN turn = 0 THEN text END), ' ') ELSE ' ' END AS text,
  max(CASE WHEN turn = 0 THEN text END) AS m0, max(CASE WHEN turn = 1 THEN concat(' ', text) END) AS m1, '' AS comment, '' AS tag0, '' AS tag1, false AS promotion, false AS castling FROM conversations GROUP BY conv_id""",
    "puzzle": """SELECT concat('puzzle:', p_partkey), 'puzzle', '', '', '', NULL, NULL, '', concat('mateIn', p_size), concat(p_brand, '_', p_type), p_size % 2 = 0, p_size % 5 = 0 FROM part""",
    "mate": """SELECT concat('mate:', o_orderkey), 'mate', CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE concat(' ', o_orderpriority) END, CASE WHEN o_orderkey % 5 = 0 THEN ' ' ELSE o_orderstatus END, '', NULL, NULL, '', '', '', false, false FROM orders""",
    "annotated": """SELECT concat('doc:', doc_id), 'annotated_sidecar', '', '', '', NULL, NULL, text, '', '', false, false FROM documents""",
}
FAMILY_ROWS = " UNION ALL ".join(FAMILY_PARTS.values())


def family_rows(spark, sf_dir):
    for name in ("conversations", "part", "orders", "documents"):
        table(spark, sf_dir, name).createOrReplaceTempView(f"family_{name}")
    text = FAMILY_ROWS
    for name in ("conversations", "part", "orders", "documents"):
        text = text.replace(f"FROM {name}", f"FROM family_{name}")
    return spark.sql(text)


def stripped(x: str) -> str:
    return f"({T.normalize(x, 'raw')})"


TAG = r"lower(replace(regexp_replace({0}, '([a-z])([A-Z])', '\1 \2', 'g'), '_', ' '))"


@query(f"""WITH r AS ({FAMILY_ROWS}), d AS (SELECT family, CASE family
  WHEN 'mate' THEN concat_ws(' ', nullif({stripped('strategy')}, ''), nullif({stripped('tactic')}, ''))
  WHEN 'aux_board_anchored' THEN coalesce(nullif({stripped('text')}, ''), concat_ws(chr(10), nullif({stripped('m0')}, ''), nullif({stripped('m1')}, '')))
  WHEN 'annotated_sidecar' THEN {stripped('comment')}
  ELSE concat_ws(' ', {TAG.format('tag0')}, {TAG.format('tag1')}, CASE WHEN promotion THEN 'promotion flag' END, CASE WHEN castling THEN 'castling flag' END) END AS document, id FROM r)
SELECT id, family, md5(document) AS document_md5 FROM d""")
def family_documents(spark, sf_dir):
    """The text of each row by its family."""
    document = text_retrieval.family_document(
        F.col("family"), F.col("strategy"), F.col("tactic"), F.col("text"), F.array("m0", "m1"), F.col("comment"), F.array("tag0", "tag1"), {"promotion": F.col("promotion"), "castling": F.col("castling")})
    return family_rows(spark, sf_dir).select("id", "family", F.md5(document).alias("document_md5"))


@query("""WITH last AS (SELECT user_id, max_by(event_type, event_id) AS event_type, max_by(value, event_id) AS value FROM events GROUP BY 1)
SELECT c_custkey, c_mktsegment, event_type, round(value, 6) AS value FROM customer JOIN last ON c_custkey = user_id""")
def aligned_targets(spark, sf_dir):
    """Customers as targets, their last event as the corpus row."""
    corpus = table(spark, sf_dir, "events").select(F.col("user_id").alias("c_custkey"), "event_id", "event_type", "value")
    targets = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    return text_retrieval.align_targets(corpus, targets, "c_custkey", "event_id").withColumn("value", F.round("value", 6))


SNIPPET = "substr(coalesce(text, ''), CAST(floor(length(coalesce(text, '')) / 3) + 1 AS INT), CAST(floor(length(coalesce(text, '')) / 3) AS INT))"
TEXT_RANKS = f"""w AS (SELECT doc_id, {SPLIT} AS split, source, {T.topic_tokens("coalesce(text, '')")} AS k, {T.topic_tokens(SNIPPET)} AS q FROM documents),
tr AS (SELECT k FROM w WHERE split = 'train'), f AS (SELECT token, count(*) AS df FROM (SELECT unnest(list_distinct(k)) AS token FROM tr) GROUP BY 1),
v AS (SELECT token, 1 + ln((1.0 + (SELECT count(*) FROM tr)) / (1 + df)) AS idf FROM f WHERE df >= 2 ORDER BY df DESC, token LIMIT 4096),
kn AS (SELECT doc_id, token, count(*) AS n FROM (SELECT doc_id, unnest(k) AS token FROM w) GROUP BY 1, 2), qn AS (SELECT doc_id, token, count(*) AS n FROM (SELECT doc_id, unnest(q) AS token FROM w) GROUP BY 1, 2),
kx AS (SELECT doc_id, token, n / sum(n) OVER (PARTITION BY doc_id) * idf AS x FROM kn JOIN v USING (token)), qx AS (SELECT doc_id, token, n / sum(n) OVER (PARTITION BY doc_id) * idf AS x FROM qn JOIN v USING (token)),
kw AS (SELECT doc_id, token, x / greatest(sqrt(sum(x * x) OVER (PARTITION BY doc_id)), 1e-8) AS x FROM kx), qw AS (SELECT doc_id, token, x / greatest(sqrt(sum(x * x) OVER (PARTITION BY doc_id)), 1e-8) AS x FROM qx),
p AS (SELECT qw.doc_id AS q, kw.doc_id AS k, round(sum(qw.x * kw.x), 9) AS s FROM qw JOIN kw USING (token) GROUP BY 1, 2),
g AS (SELECT doc_id, coalesce(s, 0) AS t FROM w LEFT JOIN p ON p.q = doc_id AND p.k = doc_id),
r AS (SELECT g.doc_id AS id, 1 + count(*) FILTER (s > t) AS rank, count(*) FILTER (s > t) + CASE WHEN t <= 1e-6 THEN (SELECT count(*) FROM w) - count(*) FILTER (s > t + 1e-6 + 1e-6 * t) ELSE count(*) FILTER (abs(s - t) <= 1e-6 + 1e-6 * t) END AS strict_rank
  FROM g LEFT JOIN p ON p.q = g.doc_id GROUP BY g.doc_id, t)"""


def snippet_ranks(spark, sf_dir):
    """Where a document is found by the middle third of its text, among all documents; words are learned from the training split."""
    rows = documents(spark, sf_dir).withColumn("snippet", F.expr(SNIPPET))
    return text_retrieval.text_ranks(rows, "doc_id", "snippet", "text", rows.where("split = 'train'"), "text")


def by_id(rows):
    """Rows in ranges of ids, in order: a mean of reciprocals that lies halfway must not hang on how ranks were dealt to tasks."""
    return rows.repartitionByRange("id").sortWithinPartitions("id")


@query(f"WITH {TEXT_RANKS} SELECT id, rank, strict_rank FROM r")
def text_retrieval_ranks(spark, sf_dir):
    return snippet_ranks(spark, sf_dir).select("id", "rank", "strict_rank")


@query(f"""WITH {TEXT_RANKS} SELECT coalesce(split, 'all') AS split, {METRICS}, round(avg(1.0 / strict_rank), 6) AS strict_mrr
FROM (SELECT split, rank, strict_rank FROM r JOIN w ON id = doc_id) GROUP BY GROUPING SETS ((split), ())""")
def text_retrieval_metrics(spark, sf_dir):
    """Recall at 1 and 5 and mean reciprocal ranks, by split and over all, from one pass over the ranks."""
    split = documents(spark, sf_dir).select(F.col("doc_id").alias("id"), "split")
    found = by_id(snippet_ranks(spark, sf_dir).join(split, "id"))
    both = found.select(F.explode(F.array("split", F.lit("all"))).alias("split"), "rank", "strict_rank")
    strict = both.groupBy("split").agg(stats.rounded(F.avg(1.0 / F.col("strict_rank"))).alias("strict_mrr"))
    return retrieval.rank_metrics(both, by="split").join(strict, "split")


@query(f"""WITH {TEXT_RANKS}, b AS (SELECT 'source' AS kind, coalesce(nullif(source, ''), 'unknown') AS value, rank FROM r JOIN w ON id = doc_id UNION ALL SELECT 'split', split, rank FROM r JOIN w ON id = doc_id)
SELECT kind, value, {METRICS} FROM b GROUP BY 1, 2""")
def text_retrieval_breakdown(spark, sf_dir):
    """Metrics by group, for each kind of group."""
    groups = documents(spark, sf_dir).select(F.col("doc_id").alias("id"), F.explode(F.array(
        F.struct(F.lit("source").alias("kind"), stats.named("source").alias("value")), F.struct(F.lit("split").alias("kind"), F.col("split").alias("value")))).alias("g"))
    return retrieval.rank_metrics(by_id(snippet_ranks(spark, sf_dir).join(groups, "id")).select("rank", "g.*"), by=("kind", "value"))
