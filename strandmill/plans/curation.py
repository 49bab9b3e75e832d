"""Queries of curation: splits, views, duplicates, boilerplate, informativeness, caps, quotas and audits of documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandmill.functions import scoring, text as t
from strandmill.functions.hashing import Sql as H
from strandmill.functions.hashing import rank_key, split_of
from strandmill.operators import audits, dedup, ranking, stats
from strandmill.plans.registry import Registry, table
from strandmill.sources.shared import written

REGISTRY = Registry()
query = REGISTRY.query
T = t.Sql
SPLIT = H.split_of("doc_id")
LIGHT = T.normalize("text", "punct_light")


def documents(spark, sf_dir):
    """Documents with their split."""
    return table(spark, sf_dir, "documents").withColumn("split", split_of("doc_id"))


@query(f"SELECT doc_id, {SPLIT} AS split FROM documents")
def split_assign(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", "split")


@query(f"SELECT {SPLIT} AS split, count(*) AS n FROM documents GROUP BY 1")
def split_counts(spark, sf_dir):
    return documents(spark, sf_dir).groupBy("split").agg(F.count("*").alias("n"))


@query(f"SELECT doc_id, {', '.join(f'md5({T.normalize('text', m)}) AS {m}' for m in t.MODES)} FROM documents")
def norm_views(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", *[F.md5(t.normalize("text", m)).alias(m) for m in t.MODES])


@query("SELECT coalesce(nullif(source, ''), 'unknown') AS source, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM documents GROUP BY 1")
def source_shares(spark, sf_dir):
    return stats.shares(stats.count_by(documents(spark, sf_dir), "source"))


def summary_sql(select: str, by: str = "") -> str:
    """SQL of the duplicate summary of rows ``(by, key)`` that ``select`` gives; an empty key has no copies."""
    b = f"{by}, " if by else ""
    return f"""
WITH k AS ({select}), s AS (SELECT {b}key, count(*) AS size FROM k GROUP BY ALL)
SELECT {b}sum(size)::BIGINT AS total_rows, count(*) FILTER (key <> '' AND size > 1) AS clusters,
  coalesce(sum(size - 1) FILTER (key <> ''), 0)::BIGINT AS duplicate_rows, round(coalesce(sum(size - 1) FILTER (key <> ''), 0) / sum(size), 6) AS duplicate_share,
  coalesce(max(size) FILTER (key <> '' AND size > 1), 0)::BIGINT AS largest FROM s {f'GROUP BY {by}' if by else ''}"""


@query(summary_sql(f"SELECT {T.normalize('text', 'raw')} AS key FROM documents"))
def dup_audit_exact(spark, sf_dir):
    return dedup.duplicate_summary(documents(spark, sf_dir).select(dedup.digest(t.normalize("text", "raw")).alias("key")), "key")


@query(summary_sql(f"SELECT source, {LIGHT} AS key FROM documents", "source"))
def dup_audit_by_source(spark, sf_dir):
    return dedup.duplicate_summary(documents(spark, sf_dir).select("source", dedup.digest(t.normalize("text", "punct_light")).alias("key")), "key", "source")


@query(summary_sql(f"SELECT {SPLIT} AS split, {LIGHT} AS key FROM documents", "split"))
def dup_audit_by_split(spark, sf_dir):
    return dedup.duplicate_summary(documents(spark, sf_dir).select("split", dedup.digest(t.normalize("text", "punct_light")).alias("key")), "key", "split")


@query(summary_sql(" UNION ALL ".join(f"SELECT '{m}' AS mode, {T.normalize('text', m)} AS key FROM documents" for m in t.MODES), "mode"))
def dup_views(spark, sf_dir):
    return dedup.duplicate_views(documents(spark, sf_dir), "text")


@query(f"""
WITH p AS (SELECT {LIGHT} AS key, source, count(*) AS n FROM documents GROUP BY 1, 2),
w AS (SELECT key, sum(n) AS n FROM p WHERE key <> '' GROUP BY key HAVING count(*) > 1)
SELECT count(*) AS clusters, coalesce(sum(n), 0)::BIGINT AS n_rows FROM w""")
def cross_position_dups(spark, sf_dir):
    rows = documents(spark, sf_dir).select("source", dedup.digest(t.normalize("text", "punct_light")).alias("key"))
    return dedup.cross_identity(rows, "key", "source")


@query(f"""
WITH s AS (SELECT {LIGHT} AS template, coalesce(source, 'unknown') AS source, count(*) AS n FROM documents GROUP BY 1, 2)
SELECT template, sum(n)::BIGINT AS repeats, string_agg(source || ':' || n, ',' ORDER BY source || ':' || n) AS sources FROM s
WHERE template <> '' GROUP BY template HAVING sum(n) > 1 ORDER BY repeats DESC, template LIMIT 20""")
def top_repeated(spark, sf_dir):
    rows = documents(spark, sf_dir).select(t.normalize("text", "punct_light").alias("template"), "source")
    return dedup.top_repeated(rows, "template", "source")


def dedup_sql(keep: int, select: str) -> str:
    return f"""
WITH k AS (SELECT doc_id, {SPLIT} AS split, coalesce(source, '') AS source, {LIGHT} AS light FROM documents),
o AS (SELECT *, CASE WHEN light = '' THEN 'own:' || doc_id ELSE substr(sha256(light), 1, 32) END AS own FROM k),
c AS (SELECT *, 'dedup_' || substr(sha256('dedup:' || split || ':' || source || ':' || own), 1, 16) AS cluster_id FROM o),
r AS (SELECT *, count(*) OVER (PARTITION BY cluster_id) AS cluster_size, row_number() OVER (PARTITION BY cluster_id ORDER BY {H.rank_key('dedup', 'doc_id')}, doc_id) AS keep_rank FROM c),
f AS (SELECT * FROM r WHERE keep_rank <= {keep}) {select}"""


def kept_documents(spark, sf_dir, keep):
    rows = documents(spark, sf_dir).select("doc_id", "split", F.coalesce("source", F.lit("")).alias("source"), dedup.digest(t.normalize("text", "punct_light")).alias("key"))
    return dedup.dedup(rows, F.col("key"), ["split", "source"], "doc_id", keep, "dedup")


@query(dedup_sql(1, "SELECT doc_id, cluster_id, cluster_size, keep_rank FROM f"))
def dedup_keep1(spark, sf_dir):
    return kept_documents(spark, sf_dir, 1).select("doc_id", "cluster_id", "cluster_size", "keep_rank")


@query(dedup_sql(3, "SELECT doc_id, cluster_id, cluster_size, keep_rank FROM f"))
def dedup_cap3(spark, sf_dir):
    return kept_documents(spark, sf_dir, 3).select("doc_id", "cluster_id", "cluster_size", "keep_rank")


@query(dedup_sql(3, "SELECT cluster_id, max(cluster_size) AS cluster_size, count(*) AS kept_size, string_agg(doc_id, ',' ORDER BY keep_rank) AS members FROM f GROUP BY cluster_id"))
def dedup_clusters(spark, sf_dir):
    return dedup.member_lists(kept_documents(spark, sf_dir, 3), "doc_id", "dedup")


def flags_sql(source: str, key: str, columns: str, text: str = "text") -> str:
    """CTE ``f`` with the boilerplate flags of a table."""
    raw, plain, mark = T.strip(f"coalesce({text}, '')"), T.strip_markup(text), t.MARKUP
    return f"""
r AS (SELECT {key}, {columns}, {raw} AS raw, {plain} AS plain_text, {T.template(text)} AS template FROM {source}),
g AS (SELECT *, (CASE WHEN template = '' THEN 0 ELSE count(*) OVER (PARTITION BY template) END)::BIGINT AS template_count, {T.tokens('plain_text')} AS tk,
  list_transform(regexp_extract_all(raw, '{mark}', 1), lambda x: lower(x)) AS tg,
  CASE WHEN length(raw) > 0 THEN (length(raw) - length(regexp_replace(raw, '{mark}', '', 'g'))) / length(raw) ELSE 0 END AS ms FROM r),
h AS (SELECT *, len(tk) AS n, {T.diversity('tk')} AS dv, {T.normalize('plain_text', 'punct_light')} <> '' AND template_count >= 20 AS rep FROM g),
f AS (SELECT *, concat_ws(',',
  CASE WHEN raw <> '' AND len(tg) > 0 AND plain_text = '' THEN 'markup_only' END,
  CASE WHEN len(tg) > 0 AND (plain_text = '' OR ms >= 0.35 OR (n <= 2 AND list_has_any(tg, ['eval', 'clk', 'emt']))) THEN 'pgn_markup_heavy' END,
  CASE WHEN regexp_matches(plain_text, '{scoring.RESULT}') THEN 'result_comment' END,
  CASE WHEN regexp_matches(plain_text, '{scoring.SYMBOLS_ONLY}') THEN 'symbol_only' END,
  CASE WHEN regexp_matches(plain_text, '{scoring.ENGINE_TEMPLATE}') THEN 'engine_template' END,
  CASE WHEN rep AND (length(plain_text) <= 24 OR n <= 4) THEN 'short_repeated_template' END,
  CASE WHEN rep AND n > 0 AND n <= 6 AND dv <= 0.5 THEN 'low_lexical_diversity_repeated' END) AS categories FROM h)"""


@query(f"WITH {flags_sql('documents', 'doc_id', 'lang')} SELECT doc_id, template_count, n AS token_count, round(dv, 6) AS lexical_diversity, categories FROM f")
def boilerplate_flags(spark, sf_dir):
    flagged = audits.boilerplate_flags(documents(spark, sf_dir), "text", ["doc_id"])
    return flagged.select("doc_id", "template_count", F.col("token_count").cast("long").alias("token_count"), F.round("lexical_diversity", 6).alias("lexical_diversity"), F.array_join("categories", ",").alias("categories"))


AUDIT = """SELECT {by}, category, count(*) AS n, round(count(*) / any_value(total), 6) AS share FROM (
  SELECT *, unnest(string_split(categories, ',')) AS category FROM (SELECT *, count(*) OVER (PARTITION BY {by}) AS total FROM f)) WHERE category <> '' GROUP BY {by}, category"""


@query(f"WITH {flags_sql('documents', 'doc_id', 'lang')} {AUDIT.format(by='lang')}")
def boilerplate_audit(spark, sf_dir):
    return audits.category_audit(audits.boilerplate_flags(documents(spark, sf_dir), "text", ["lang"]), "lang")


@query(f"WITH {flags_sql('conversations', 'conv_id', 'role')} {AUDIT.format(by='role')}")
def chat_boilerplate_audit(spark, sf_dir):
    return audits.category_audit(audits.boilerplate_flags(table(spark, sf_dir, "conversations"), "text", ["role"]), "role")


def scores_sql(source: str = "documents", columns: str = "doc_id, lang, source, text") -> str:
    """CTE ``s`` with features, score and bucket."""
    raw = T.strip("coalesce(text, '')")
    some = lambda words: f"len(list_filter(tk, lambda x: x IN ({', '.join(repr(w) for w in words)})))"
    score, penalty = scoring.score_sql()
    return f"""
w AS (SELECT {columns}, {raw} AS tx FROM {source}), k AS (SELECT *, {T.tokens('tx')} AS tk FROM w),
m AS (SELECT * EXCLUDE (tk), length(tx) AS char_length, len(tk) AS token_count, {T.diversity('tk')} AS lexical_diversity,
  CASE WHEN len(tk) > 0 THEN len(list_filter(tk, lambda x: regexp_matches(x, '[a-z]'))) / len(tk) ELSE 0 END AS alpha_token_ratio,
  CASE WHEN len(tk) > 0 THEN len(list_filter(tk, lambda x: regexp_matches(x, '^[0-9]+$'))) / len(tk) ELSE 0 END AS numeric,
  CASE WHEN length(tx) > 0 THEN (length(tx) - length(regexp_replace(tx, '{t.MARKUP}', '', 'g'))) / length(tx) ELSE 0 END AS markup_ratio,
  CASE WHEN length(tx) > 0 THEN length(regexp_replace(tx, '[\\p{{L}}\\p{{N}}{t.SPACE_RE2[1:-1]}]', '', 'g')) / length(tx) ELSE 0 END AS symbol_ratio,
  {some(scoring.DOMAIN_WORDS)} AS domain_hits, {some(scoring.EXPLANATORY_WORDS)} AS explanatory_hits,
  {some(scoring.ANCHOR_WORDS)} + len(regexp_extract_all(tx, '{scoring.SQUARE}')) AS anchor_hits FROM k),
q AS (SELECT *, regexp_matches(tx, '{scoring.RESULT}') OR numeric >= 0.5 OR markup_ratio >= 0.5 AS mostly_numeric_or_result FROM m),
s AS (SELECT *, CASE WHEN score >= 0.62 THEN 'high' WHEN score >= 0.45 THEN 'medium' ELSE 'low' END AS bucket
  FROM (SELECT *, round(greatest(0e0, least(1e0, {score} - {penalty})), 9) AS score FROM q))"""


def scored(rows):
    """Informativeness, the score rounded so that bounds do not hang on the order of sums."""
    return scoring.informativeness(rows, "text").withColumn("score", F.round("score", 9)).withColumn("bucket", scoring.bucket(F.col("score")))


@query(f"WITH {scores_sql()} SELECT doc_id, domain_hits, explanatory_hits, anchor_hits, round(symbol_ratio, 6) AS symbol_ratio, round(score, 6) AS score, bucket FROM s")
def informativeness(spark, sf_dir):
    return scored(documents(spark, sf_dir).select("doc_id", "text")).select(
        "doc_id", *[F.col(c).cast("long").alias(c) for c in ("domain_hits", "explanatory_hits", "anchor_hits")], F.round("symbol_ratio", 6).alias("symbol_ratio"), F.round("score", 6).alias("score"), "bucket")


@query(f"WITH {scores_sql()} SELECT source, bucket, count(*) AS n FROM s GROUP BY 1, 2")
def bucket_counts(spark, sf_dir):
    return scored(documents(spark, sf_dir).select("source", "text")).groupBy("source", "bucket").agg(F.count("*").alias("n"))


def ranks_sql(source: str, by: str, value: str, percentiles) -> str:
    at = lambda p: f"l[round_even((len(l) - 1) * {p}, 0)::BIGINT + 1]"
    return (f"SELECT {by}, len(l)::BIGINT AS n, round(list_sum(l) / len(l), 6) AS mean, l[len(l)] AS max, {', '.join(f'{at(p)} AS {stats.label_of(p)}' for p in percentiles)} "
            f"FROM (SELECT {by}, list_sort(list({value}) FILTER ({value} IS NOT NULL)) AS l FROM {source} GROUP BY {by}) WHERE len(l) > 0")


@query(f"WITH {scores_sql()} {ranks_sql('s', 'lang', 'score', (0.1, 0.5, 0.9))}")
def score_distribution(spark, sf_dir):
    return stats.distribution(scored(documents(spark, sf_dir).select("lang", "text")), "lang", "score", (0.1, 0.5, 0.9))


@query(ranks_sql("(SELECT source, length(coalesce(text, '')) AS n_chars FROM documents)", "source", "n_chars", (0.5, 0.9, 0.99)))
def length_distribution(spark, sf_dir):
    rows = documents(spark, sf_dir).select("source", F.length(t.text_of("text")).cast("long").alias("n_chars"))
    return stats.distribution(rows, "source", "n_chars", (0.5, 0.9, 0.99))


@query(ranks_sql("lineitem", "l_returnflag, l_linestatus", "l_extendedprice", (0.25, 0.5, 0.75)))
def price_distribution(spark, sf_dir):
    return stats.distribution(table(spark, sf_dir, "lineitem"), ["l_returnflag", "l_linestatus"], "l_extendedprice", (0.25, 0.5, 0.75))


@query(f"""WITH {scores_sql(columns=f'doc_id, source, text, {SPLIT} AS split')},
t AS (SELECT split, source, greatest(45e-2, l[round_even((len(l) - 1) * 0.6, 0)::BIGINT + 1]) AS threshold FROM (SELECT split, source, list_sort(list(score)) AS l FROM s GROUP BY 1, 2))
SELECT doc_id, round(threshold, 6) AS threshold, score >= 0.62 AS keep_high, score >= 0.45 AS keep_medium, score >= threshold AS keep_quantile, score >= 0.45 OR (score >= 0.3 AND regexp_matches(text, '[0-9]')) AS keep_special
FROM s JOIN t USING (split, source)""")
def quantile_threshold_filter(spark, sf_dir):
    rows = scored(documents(spark, sf_dir).select("doc_id", "source", "split", "text"))
    rows = written(rows.select("doc_id", "source", "split", "score", F.col("text").rlike("[0-9]").alias("special")), "scores")  # texts are scored once
    kept = audits.informative_variants(rows, ["split", "source"], F.col("special"))
    return kept.select("doc_id", F.round("threshold", 6).alias("threshold"), "keep_high", "keep_medium", "keep_quantile", "keep_special")


CLEAN = f"""WITH {flags_sql('documents', 'doc_id', f"lang, {SPLIT} AS split")},
d AS (SELECT *, CASE WHEN categories <> '' THEN 'boilerplate:' || string_split(categories, ',')[1] WHEN plain_text = '' THEN 'empty_after_cleanup' END AS reason, {T.normalize('plain_text', 'punct_light')} AS light FROM f),
p AS (SELECT *, row_number() OVER (PARTITION BY split, CASE WHEN light = '' THEN 'own:' || doc_id ELSE light END ORDER BY {H.rank_key('clean', 'doc_id')}, doc_id) AS place FROM d WHERE reason IS NULL)"""


@query(f"{CLEAN} SELECT doc_id, split, md5(plain_text) AS plain_md5 FROM p WHERE place <= 3")
def template_cap(spark, sf_dir):
    kept, _ = audits.clean(audits.boilerplate_flags(documents(spark, sf_dir), "text", ["doc_id", "split"]), "doc_id", ["split"])
    return kept.select("doc_id", "split", "plain_md5")


@query(f"{CLEAN} SELECT doc_id, 'template_cap' AS drop_reason FROM p WHERE place > 3 UNION ALL SELECT doc_id, reason FROM d WHERE reason IS NOT NULL")
def drop_ledger(spark, sf_dir):
    return audits.clean(audits.boilerplate_flags(documents(spark, sf_dir), "text", ["doc_id", "split"]), "doc_id", ["split"])[1]


def cap_sql(most: int) -> str:
    return f"SELECT doc_id, split, source FROM (SELECT doc_id, {SPLIT} AS split, source, row_number() OVER (PARTITION BY {SPLIT}, source ORDER BY {H.rank_key('cap', 'doc_id')}, doc_id) AS place FROM documents) WHERE place <= {most}"


@query(cap_sql(15))
def family_cap(spark, sf_dir):
    return ranking.cap(documents(spark, sf_dir).select("doc_id", "split", "source"), ["split", "source"], [rank_key("cap", "doc_id"), F.col("doc_id")], 15)


@query(cap_sql(4))
def family_cap_min_presence(spark, sf_dir):
    return ranking.cap_with_minimum(documents(spark, sf_dir).select("doc_id", "split", "source"), ["split", "source"], [rank_key("cap", "doc_id"), F.col("doc_id")], 2, 4)


@query(f"""SELECT l_suppkey, l_orderkey, l_linenumber FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY {H.rank_key('cap', 'l_orderkey', 'l_linenumber')}, l_orderkey, l_linenumber) AS place FROM lineitem) WHERE place <= 20""")
def supplier_cap(spark, sf_dir):
    order = [rank_key("cap", "l_orderkey", "l_linenumber"), F.col("l_orderkey"), F.col("l_linenumber")]
    return ranking.cap(table(spark, sf_dir, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber"), "l_suppkey", order, 20)


def quota_sql(select: str, by: str, stratum: str, limit: int) -> str:
    """CTE ``q`` with the seats of each stratum of ``select``."""
    return f"""
z AS ({select}), y AS (SELECT *, sum(n) OVER (PARTITION BY {by}) AS total FROM z),
x AS (SELECT *, least(n, floor({limit} * n / total)) AS base, {limit} * n / total - floor({limit} * n / total) AS rest FROM y),
v AS (SELECT *, least({limit}, total) - sum(base) OVER (PARTITION BY {by}) AS seats, row_number() OVER (PARTITION BY {by} ORDER BY (base >= n)::INT, rest DESC, {stratum}) AS place FROM x),
u AS (SELECT *, base + (place <= seats AND base < n)::INT AS got FROM v),
e AS (SELECT *, greatest(0, least({limit}, total) - sum(got) OVER (PARTITION BY {by})) AS left_over,
  coalesce(sum(n - got) OVER (PARTITION BY {by} ORDER BY {stratum} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM u),
q AS (SELECT {by}, {stratum}, n, (got + greatest(0, least(n - got, left_over - before)))::BIGINT AS quota FROM e)"""


STRATA = f"SELECT {SPLIT} AS split, lang, count(*) AS n FROM documents GROUP BY 1, 2"


@query(f"WITH {quota_sql(STRATA, 'split', 'lang', 60)} SELECT split, lang, n, quota FROM q")
def stratified_quota(spark, sf_dir):
    return ranking.quotas(ranking.group_sizes(documents(spark, sf_dir), ["split", "lang"]), "split", "lang", 60)


@query(f"""WITH {quota_sql(STRATA, 'split', 'lang', 60)},
o AS (SELECT doc_id, {SPLIT} AS split, lang, row_number() OVER (PARTITION BY {SPLIT}, lang ORDER BY {H.rank_key('sample', 'doc_id')}, doc_id) AS place FROM documents)
SELECT doc_id, split, lang FROM o JOIN q USING (split, lang) WHERE place <= quota""")
def stratified_sample(spark, sf_dir):
    rows = documents(spark, sf_dir).select("doc_id", "split", "lang")
    return ranking.stratified_sample(rows, "split", "lang", [rank_key("sample", "doc_id"), F.col("doc_id")], 60).select("doc_id", "split", "lang")


@query(f"""WITH {quota_sql("SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY 1, 2", 'o_orderstatus', 'o_orderpriority', 101)},
o AS (SELECT o_orderkey, o_orderstatus, o_orderpriority, row_number() OVER (PARTITION BY o_orderstatus, o_orderpriority ORDER BY {H.rank_key('sample', 'o_orderkey')}, o_orderkey) AS place FROM orders)
SELECT o_orderkey, o_orderstatus, o_orderpriority FROM o JOIN q USING (o_orderstatus, o_orderpriority) WHERE place <= quota""")
def order_sample(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    return ranking.stratified_sample(rows, "o_orderstatus", "o_orderpriority", [rank_key("sample", "o_orderkey"), F.col("o_orderkey")], 101).select("o_orderkey", "o_orderstatus", "o_orderpriority")


@query(f"""WITH d AS (SELECT coalesce(nullif(source, ''), 'unknown') AS family, {SPLIT} AS split, {LIGHT} AS key, length(coalesce(text, '')) AS l FROM documents),
a AS (SELECT family, count(*) AS n, count(*) FILTER (split = 'train') AS train, count(*) FILTER (split = 'val') AS val, count(*) FILTER (split = 'test') AS test, list_sort(list(l)) AS ls FROM d GROUP BY 1),
c AS (SELECT family, sum(CASE WHEN key <> '' THEN c - 1 ELSE 0 END) / sum(c) AS dup FROM (SELECT family, key, count(*) AS c FROM d GROUP BY 1, 2) GROUP BY 1)
SELECT family, n, train, val, test, round(n / sum(n) OVER (), 6) AS share, round(dup, 6) AS duplicate_share, round(list_sum(ls) / len(ls), 6) AS mean_length,
  ls[round_even((len(ls) - 1) * 0.5, 0)::BIGINT + 1]::INT AS median_length, ls[len(ls)]::INT AS max_length FROM a JOIN c USING (family)""")
def family_audit(spark, sf_dir):
    return audits.family_audit(documents(spark, sf_dir), "source", "text", "split")


STYLE = ("char_length", "token_count", "lexical_diversity", "markup_rate", "duplicate_rate", "numeric_rate")


def style_sql(source: str, key: str, family: str) -> str:
    """The audit of a table; flags and scores are those of the other queries' SQL."""
    spread = lambda c: f"(CASE WHEN coalesce(stddev_samp({c}) OVER (), 1) < 1e-8 THEN 1 ELSE coalesce(stddev_samp({c}) OVER (), 1) END)"
    return f"""WITH {flags_sql(source, key, family)}, {scores_sql(source, f'{key}, text')},
j AS (SELECT coalesce(nullif(f.{family}, ''), 'unknown') AS family, s.char_length, s.token_count, s.lexical_diversity, f.ms AS markup_rate, s.score, template_count,
  regexp_matches(categories, 'markup_only|pgn_markup_heavy') AS heavy, mostly_numeric_or_result OR symbol_ratio >= 0.25 AS num FROM f JOIN s USING ({key})),
a AS (SELECT family, count(*) AS n, {', '.join(f'round(avg({c}), 6) AS {c}' for c in ('char_length', 'token_count', 'lexical_diversity', 'markup_rate', 'score'))},
  round(avg(heavy::INT), 6) AS markup_heavy_rate, round(avg(num::INT), 6) AS numeric_rate, round(avg((template_count > 1)::INT), 6) AS duplicate_rate FROM j GROUP BY 1)
SELECT *, CASE WHEN markup_heavy_rate >= 0.2 OR numeric_rate >= 0.2 THEN 'markup_heavy' WHEN duplicate_rate >= 0.25 THEN 'repetitive'
  WHEN score >= 0.68 AND markup_heavy_rate < 0.1 THEN 'human_leaning' ELSE 'mixed_style' END AS style, round(sqrt({' + '.join(f'(({c} - avg({c}) OVER ()) / {spread(c)}) ** 2' for c in STYLE)}), 4) AS divergence FROM a"""


@query(style_sql("documents", "doc_id", "source"))
def style_audit(spark, sf_dir):
    return audits.style_audit(documents(spark, sf_dir), "source", "text").withColumn("divergence", F.round("divergence", 4))


def hits_sql(column: str) -> str:
    def case(name, patterns):
        tests = " OR ".join(f"contains(low, {chr(39)}{p}{chr(39)})" for p in patterns)
        return f"CASE WHEN {tests} THEN '{name}' END"

    return f"SELECT doc_id, lang, concat_ws(',', {', '.join(case(k, v) for k, v in scoring.KEYWORD_LABELS.items())}) AS labels FROM (SELECT doc_id, lang, lower(coalesce({column}, '')) AS low FROM documents)"


@query(f"SELECT doc_id, labels FROM ({hits_sql('text')})")
def keyword_labels(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", F.array_join(scoring.keyword_labels("text"), ",").alias("labels"))


@query(f"SELECT lang, label, count(*) AS n FROM (SELECT lang, unnest(string_split(labels, ',')) AS label FROM ({hits_sql('text')})) WHERE label <> '' GROUP BY 1, 2")
def label_freq(spark, sf_dir):
    rows = documents(spark, sf_dir).select("lang", scoring.keyword_labels("text").alias("labels"))
    return audits.label_frequency(rows, "labels", "lang")


@query(f"""WITH h AS ({hits_sql('text')}), l AS (SELECT doc_id, unnest(string_split(labels, ',')) AS label, generate_subscripts(string_split(labels, ','), 1) AS i FROM h),
c AS (SELECT label FROM l GROUP BY 1 HAVING count(*) >= 20), k AS (SELECT doc_id, string_agg(label, ',' ORDER BY i) AS labels FROM l JOIN c USING (label) WHERE label <> '' GROUP BY 1)
SELECT h.doc_id, coalesce(k.labels, '') AS labels FROM h LEFT JOIN k USING (doc_id)""")
def rare_labels(spark, sf_dir):
    rows = documents(spark, sf_dir).select("doc_id", scoring.keyword_labels("text").alias("labels"))
    return audits.without_rare(rows, "labels", 20, list(scoring.KEYWORD_LABELS)).select("doc_id", F.array_join("labels", ",").alias("labels"))
