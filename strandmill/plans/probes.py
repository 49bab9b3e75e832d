"""Queries of rankings, probe rows and targets, vocabularies, routing, choices, orders and member lists."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandmill.functions import scoring, text as t
from strandmill.functions.hashing import Sql as H
from strandmill.operators import dedup, rankings, reports, stats, targets
from strandmill.plans.cases import LABELS, REMARKED, dealt_sql, remarks
from strandmill.plans.curation import LIGHT, documents, scored, scores_sql
from strandmill.plans.registry import Registry, table
from strandmill.sources import readers, sinks
from strandmill.sources.shared import fresh, written

REGISTRY = Registry()
query = REGISTRY.query


def placed_sql(name: str, order: str, by: str = "", k: int = 10, where: str = "true") -> str:
    """A ranking over the table ``s``."""
    part = f"PARTITION BY {by} " if by else ""
    return f"SELECT '{name}' AS ranking, {by or "'all'"} AS source, row_number() OVER ({part}ORDER BY {order}, doc_id) AS place, doc_id FROM s WHERE {where} QUALIFY place <= {k}"


SCORED = scores_sql(columns="doc_id, coalesce(nullif(source, ''), 'unknown') AS source, length(text) AS size")


@query(f"""WITH {SCORED} {placed_sql('longest', '-size')} UNION ALL {placed_sql('shortest', 'size NULLS LAST', k=7)} UNION ALL {placed_sql('dullest', 'round(score, 6), -size', k=20)} UNION ALL {placed_sql('brightest', '-round(score, 6), size', where='score >= 0.62')}""")
def top_documents(spark, sf_dir):
    """Four rankings of all documents from one scan."""
    s, n = F.round("score", 6), F.col("size")
    found = rankings.top_many(sized(spark, sf_dir), [
        rankings.Ranking("longest", ((n, True),)), rankings.Ranking("shortest", ((n, False),), 7), rankings.Ranking("dullest", ((s, False), (n, True)), 20),
        rankings.Ranking("brightest", ((s, True), (n, False)), where=F.col("score") >= 0.62)], "doc_id")
    return found.select("ranking", F.lit("all").alias("source"), "place", "doc_id")


def sized(spark, sf_dir):
    return scored(documents(spark, sf_dir).select("doc_id", stats.named("source").alias("source"), "text")).select("doc_id", "source", F.length("text").alias("size"), "score")


@query(f"WITH {SCORED} {placed_sql('examples', '-round(score, 6)', 'source', 5)} UNION ALL {placed_sql('low', 'round(score, 6)', 'source', 3)}")
def source_examples(spark, sf_dir):
    """The best five and the lowest three documents of each source."""
    s = F.round("score", 6)
    return rankings.top_many(sized(spark, sf_dir), [rankings.Ranking("examples", ((s, True),), 5), rankings.Ranking("low", ((s, False),), 3)], "doc_id", "source")


FAMILIES = f"""{scores_sql(columns=f"doc_id, coalesce(nullif(source, ''), 'unknown') AS source, {LIGHT} AS light")}, d AS (SELECT source, light, count(*) AS c FROM s GROUP BY 1, 2),
f AS (SELECT source, sum(c)::BIGINT AS n, round(sum(CASE WHEN light <> '' THEN c - 1 ELSE 0 END) / sum(c), 6) AS duplicate_share FROM d GROUP BY 1),
g AS (SELECT f.*, m FROM f JOIN (SELECT source, round(avg(score), 6) AS m FROM s GROUP BY 1) USING (source))"""


@query(f"""WITH {FAMILIES} SELECT * FROM (SELECT 'largest' AS ranking, row_number() OVER (ORDER BY -n, source) AS place, source, n, duplicate_share, m AS mean_score FROM g
UNION ALL SELECT 'repetitive', row_number() OVER (ORDER BY -duplicate_share, -n, source), source, n, duplicate_share, m FROM g UNION ALL SELECT 'informative', row_number() OVER (ORDER BY -m, -n, source), source, n, duplicate_share, m FROM g) WHERE place <= 10""")
def source_rankings(spark, sf_dir):
    """The largest, the most repetitive and the most informative sources; texts are scored once."""
    rows = scored(documents(spark, sf_dir).select(stats.named("source").alias("source"), "text", dedup.digest(t.normalize("text", "punct_light")).alias("key")))
    pairs = rows.select("source", "key", "score").groupBy("source", "key").agg(F.count("*").alias("c"), F.sum("score").alias("s"))
    families = pairs.groupBy("source").agg(F.sum("c").alias("n"), F.round(F.sum(F.when(F.col("key").isNotNull(), F.col("c") - 1).otherwise(0)) / F.sum("c"), 6).alias("duplicate_share"), F.round(F.sum("s") / F.sum("c"), 6).alias("mean_score"))
    n, d, m = F.col("n"), F.col("duplicate_share"), F.col("mean_score")
    return rankings.top_many(families, [rankings.Ranking("largest", ((n, True),)), rankings.Ranking("repetitive", ((d, True), (n, True))), rankings.Ranking("informative", ((m, True), (n, True)))], "source", payload=("n", "duplicate_share", "mean_score"))


@query(f"SELECT doc_id, row_number() OVER (ORDER BY {H.rank_key('sidecar:final', 'doc_id')}, doc_id) - 1 AS ord FROM documents")
def final_order(spark, sf_dir):
    """Documents in the order that a written table keeps."""
    return targets.final_order(documents(spark, sf_dir).select("doc_id"), "sidecar", "doc_id")


CLUSTERS = f"k AS (SELECT doc_id, md5({LIGHT}) AS cluster FROM documents WHERE {LIGHT} <> ''), p AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY {H.rank_key('members', 'doc_id')}, doc_id) - 1 AS place FROM k)"


@query(f"WITH {CLUSTERS} SELECT cluster, place // 4 AS segment, string_agg(doc_id::VARCHAR, ',' ORDER BY place) AS members, count(*) AS size FROM p GROUP BY 1, 2")
def cluster_members(spark, sf_dir):
    """All members of all clusters, four to a list."""
    rows = documents(spark, sf_dir).select("doc_id", F.when(t.normalize("text", "punct_light") != "", F.md5(t.normalize("text", "punct_light"))).alias("cluster")).where("cluster is not null")
    lists = targets.cluster_members(rows, "cluster", "doc_id", "members", 4)[1]
    return lists.select("cluster", "segment", F.array_join(F.transform("items", lambda x: x.cast("string")), ",").alias("members"), F.size("items").cast("long").alias("size"))


def order_rows(spark, sf_dir):
    """Orders as rows of two families; some have no game, no themes or no history."""
    key = F.col("o_orderkey")
    fen = F.concat(F.lit("8/8/8/8/8/8/8/K1k5 w - - 0 "), key.cast("string"))
    return table(spark, sf_dir, "orders").select(
        key.alias("source_row_id"), F.when(key % 3 == 0, F.concat(F.lit("g"), F.col("o_custkey").cast("string"))).alias("game_id"), fen.alias("fen"), F.lit("e2e4").alias("target_move_uci"), F.lit("e2e4, d2d4").alias("candidate_moves"),
        F.col("o_orderstatus").alias("strategy_text"), F.col("o_orderpriority").alias("tactic_text"), F.when(key % 5 != 0, "fork mateIn2").otherwise("").alias("theme_tags"), F.when(key % 10 != 0, "endgame").alias("concept_tags"),
        F.when(key % 4 == 0, F.array(F.lit("before"), fen)).when(key % 4 == 1, F.array().cast("array<string>")).alias("history_fens"))


def probes_sql(family: str, by_game: bool) -> str:
    group = "CASE WHEN o_orderkey % 3 = 0 THEN 'g' || o_custkey ELSE o_orderkey::VARCHAR END" if by_game else "o_orderkey::VARCHAR"
    mate = family == "mate"
    return f"""SELECT 'probe_' || substr(sha256('{family}:' || o_orderkey), 1, 16) AS probe_id, '{'mate' if mate else 'lichess_puzzle'}' AS source, {H.split_of(group)} AS split, {group} AS split_group_id, '8/8/8/8/8/8/8/K1k5 w - -' AS fen_4field,
  {'NULL' if mate else "'e2e4'"} AS target_move_uci, {"'e2e4,d2d4'" if mate else 'NULL'} AS candidate_moves, {'o_orderpriority' if mate else 'NULL'} AS tactic_text,
  {'NULL' if mate else "CASE WHEN o_orderkey % 5 <> 0 THEN 'fork,mateIn2' WHEN o_orderkey % 10 <> 0 THEN 'endgame' ELSE '' END"} AS theme_tags, CASE WHEN o_orderkey % 4 = 0 THEN 2 ELSE 1 END AS history FROM orders"""


@query(f"{probes_sql('mate', True)} UNION ALL {probes_sql('puzzle', False)}")
def probe_corpora(spark, sf_dir):
    """Two families in the shape of probes: one is split by game, one by row."""
    rows = order_rows(spark, sf_dir)
    both = targets.probe_rows(rows, "mate", True).unionByName(targets.probe_rows(rows, "puzzle", False))
    return both.select("probe_id", "source", "split", "split_group_id", "fen_4field", "target_move_uci", F.array_join("candidate_moves", ",").alias("candidate_moves"), "tactic_text", F.array_join("theme_tags", ",").alias("theme_tags"), F.size("history_fens").alias("history"))


@query(f"WITH p AS ({probes_sql('mate', True)} UNION ALL {probes_sql('puzzle', False)}) SELECT source, split, count(*) AS n, count(DISTINCT split_group_id) AS groups, count(*) - count(DISTINCT probe_id) AS repeats, round(avg(history), 6) AS mean_history FROM p GROUP BY 1, 2")
def probe_report(spark, sf_dir):
    """Rows, groups and repeated ids of probes by source and split."""
    rows = order_rows(spark, sf_dir)
    both = targets.probe_rows(rows, "mate", True).unionByName(targets.probe_rows(rows, "puzzle", False))
    return both.groupBy("source", "split").agg(F.count("*").alias("n"), F.count_distinct("split_group_id").alias("groups"), (F.count("*") - F.count_distinct("probe_id")).alias("repeats"), F.round(F.avg(F.size("history_fens")), 6).alias("mean_history"))


FLAGS = "p_size % 2 = 0 AS promotion, p_size % 5 = 0 AS castling, p_size % 7 = 0 AS check_evasion"


def puzzle_parts(spark, sf_dir):
    size = F.col("p_size")
    rows = table(spark, sf_dir, "part").select("p_partkey", "p_brand", F.split("p_name", " ").alias("tags"), size)
    return targets.puzzle_targets(rows, "tags", {"promotion": size % 2 == 0, "castling": size % 5 == 0, "check_evasion": size % 7 == 0})


@query(f"SELECT p_partkey, replace(p_name, ' ', ',') AS labels, promotion, castling, check_evasion FROM (SELECT *, {FLAGS} FROM part)")
def puzzle_targets(spark, sf_dir):
    return puzzle_parts(spark, sf_dir).select("p_partkey", F.array_join("target_labels", ",").alias("labels"), *[F.col(f"{f}_flag").alias(f) for f in ("promotion", "castling", "check_evasion")])


@query(f"SELECT p_brand, count(*) AS n, count(*) FILTER (promotion) AS promotion_flag, count(*) FILTER (castling) AS castling_flag, count(*) FILTER (check_evasion) AS check_evasion_flag FROM (SELECT *, {FLAGS} FROM part) GROUP BY 1")
def special_rule_counts(spark, sf_dir):
    return targets.flag_counts(puzzle_parts(spark, sf_dir), "p_brand", ["promotion_flag", "castling_flag", "check_evasion_flag"])


@query("SELECT label, row_number() OVER (ORDER BY label) - 1 AS place FROM (SELECT DISTINCT unnest(string_split(p_name, ' ')) AS label FROM part)")
def label_vocabulary(spark, sf_dir):
    return targets.label_vocabulary(puzzle_parts(spark, sf_dir), "target_labels")


CONCEPTS = ["anvil", "bolt", "gear", "small", "widget"]


@query(f"SELECT p_partkey, array_to_string(list_transform([{', '.join(repr(c) for c in CONCEPTS)}], lambda w: (p_partkey % 9 <> 0 AND list_contains(string_split(p_name, ' '), w))::INT), ',') AS concepts, p_partkey % 9 <> 0 AS has_concept_labels, CASE WHEN p_partkey % 4 <> 0 THEN round(p_size / 1000.0, 6) ELSE 0 END AS value, p_partkey % 4 <> 0 AS has_engine_eval FROM part")
def concept_targets(spark, sf_dir):
    """Concept vectors and values, with masks where nobody labelled or evaluated a row."""
    key = F.col("p_partkey")
    rows = table(spark, sf_dir, "part").select("p_partkey", F.when(key % 9 != 0, F.split("p_name", " ")).alias("tags"), F.when(key % 4 != 0, F.col("p_size")).alias("cp"))
    made = targets.concept_targets(rows, "tags", CONCEPTS, "cp")
    return made.select("p_partkey", F.array_join(F.transform("concepts", lambda x: x.cast("string")), ",").alias("concepts"), "has_concept_labels", F.round("value", 6).alias("value"), "has_engine_eval")


@query("SELECT p_partkey, replace(lower(trim(p_name)), ' ', '_') AS token, trim(regexp_replace(lower(p_type), '[^a-z0-9]+', '_', 'g'), '_') AS regime FROM part")
def token_slugs(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", targets.token_of("p_name").alias("token"), targets.regime_slug("p_type").alias("regime"))


@query("SELECT label, round(p, 6) AS prevalence, round(ln(greatest(1e-4, least(0.9999, p)) / (1 - greatest(1e-4, least(0.9999, p)))), 6) AS score FROM (SELECT unnest(['quality', 'toxic', 'never']) AS label, unnest([avg(quality), avg(toxic), avg(0)]) AS p FROM labels)")
def prevalence_baseline(spark, sf_dir):
    found = targets.prevalence_baseline(table(spark, sf_dir, "labels").select("quality", "toxic", F.lit(0).alias("never")), ["quality", "toxic", "never"])
    return found.select("label", F.round("prevalence", 6).alias("prevalence"), F.round("score", 6).alias("score"))


ROUTES = """r AS (SELECT CASE WHEN o_orderkey % 2 = 0 THEN 'mate' ELSE 'puzzle' END AS source, CASE o_orderstatus WHEN 'F' THEN 'train' WHEN 'O' THEN 'val' END AS split,
  CASE WHEN o_orderkey % 3 = 0 THEN 'exact_fen_target_move' ELSE 'fen_4field' END AS kind, CASE WHEN o_orderkey % 5 = 0 THEN 'ambiguous' ELSE 'no_supervised_match' END AS reason FROM orders),
o AS (SELECT *, CASE WHEN split IS NULL THEN 'unmatched' WHEN source = 'mate' OR split <> 'train' THEN 'matched_' || split ELSE 'ignored_' || split END AS outcome FROM r)"""


@query(f"""WITH {ROUTES} SELECT source, counter, count(*) AS n FROM (SELECT source, unnest(list_filter([
  'rows_seen', CASE WHEN outcome LIKE 'matched%' THEN 'matched_rows' END, CASE WHEN outcome LIKE 'ignored%' THEN 'ignored_rows' END, CASE WHEN outcome LIKE 'ignored%' THEN 'ignored_due_to_output_policy' END, CASE WHEN split IS NULL THEN 'unmatched_rows' ELSE outcome END,
  CASE WHEN outcome LIKE 'matched%' THEN 'alignment_' || kind END, CASE WHEN outcome LIKE 'matched%' AND kind LIKE '%target_move' THEN 'move_conditioned_matches' END, CASE WHEN split IS NULL THEN 'unmatched_reason_' || reason END], lambda x: x IS NOT NULL)) AS counter FROM o) GROUP BY 1, 2""")
def alignment_routes(spark, sf_dir):
    """Where aligned rows go: puzzles may not go to the training split."""
    key, status = F.col("o_orderkey"), F.col("o_orderstatus")
    rows = table(spark, sf_dir, "orders").select(
        F.when(key % 2 == 0, "mate").otherwise("puzzle").alias("source"), F.when(status == "F", "train").when(status == "O", "val").alias("split"),
        F.when(key % 3 == 0, "exact_fen_target_move").otherwise("fen_4field").alias("alignment_type"), F.when(key % 5 == 0, "ambiguous").otherwise("no_supervised_match").alias("reason"))
    return targets.routing_counts(targets.routed(rows, {"mate": ("train", "val", "test"), "puzzle": ("val", "test")}))


@query("SELECT vec_id, label, len(embedding)::BIGINT AS width, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE)), 4) AS total FROM embeddings JOIN documents ON vec_id = doc_id")
def gathered_vectors(spark, sf_dir):
    """Rows with their vectors; that every row has one is checked."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding")
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("vec_id")).join(vectors.select("vec_id"), "vec_id", "left_semi")
    return targets.gathered(rows, vectors, "vec_id").select("vec_id", "label", F.size("embedding").cast("long").alias("width"), F.round(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double")), 4).alias("total"))


RESULTS = "r AS (SELECT o_orderstatus AS variant, o_orderpriority AS regime, 'b' || o_custkey % 7 AS backbone, floor(round(avg(o_totalprice), 0) / 5000) AS mrr, count(*) AS test_rows FROM orders GROUP BY 1, 2, 3)"


@query(f"WITH {RESULTS} SELECT variant, regime, backbone, mrr, test_rows FROM r QUALIFY row_number() OVER (PARTITION BY variant, regime ORDER BY mrr DESC, test_rows, backbone DESC) = 1")
def best_choices(spark, sf_dir):
    """The best backbone of each variant and regime."""
    rows = table(spark, sf_dir, "orders").groupBy(F.col("o_orderstatus").alias("variant"), F.col("o_orderpriority").alias("regime"), F.concat(F.lit("b"), (F.col("o_custkey") % 7).cast("string")).alias("backbone")).agg(
        F.floor(F.round(F.avg("o_totalprice"), 0) / 5000).cast("double").alias("mrr"), F.count("*").alias("test_rows"))
    return targets.best_choices(rows, ["variant", "regime"], "mrr", "test_rows", "backbone")


@query("""WITH a AS (SELECT o_orderkey, o_totalprice FROM orders), b AS (SELECT o_orderkey, CASE WHEN o_orderkey % 100 = 0 THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice FROM orders WHERE o_orderkey % 50 <> 1)
SELECT metric, before, after, after - before AS delta FROM (SELECT 'rows' AS metric, (SELECT count(*) FROM a)::DOUBLE AS before, (SELECT count(*) FROM b)::DOUBLE AS after UNION ALL SELECT 'keys', (SELECT sum(o_orderkey) FROM a)::DOUBLE, (SELECT sum(o_orderkey) FROM b)::DOUBLE)""")
def version_deltas(spark, sf_dir):
    """Two versions of a table side by side."""
    a = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    b = a.where("o_orderkey % 50 <> 1").withColumn("o_totalprice", F.when(F.col("o_orderkey") % 100 == 0, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice")))
    return targets.version_deltas(a, b, {"rows": F.count("*"), "keys": F.sum("o_orderkey")})


@query("SELECT category, regime, n, row_number() OVER (ORDER BY category, regime) - 1 AS place FROM (SELECT c_mktsegment AS category, 'nation_' || c_nationkey AS regime, count(*) AS n FROM customer GROUP BY 1, 2) WHERE category IN ('BUILDING', 'MACHINERY')")
def selected_regimes(spark, sf_dir):
    counts = table(spark, sf_dir, "customer").groupBy(F.col("c_mktsegment").alias("category"), F.concat(F.lit("nation_"), F.col("c_nationkey").cast("string")).alias("regime")).agg(F.count("*").alias("n"))
    return targets.selected_regimes(counts, ["BUILDING", "MACHINERY"])


SIMILAR = "s AS (SELECT l_suppkey % 60 AS q, l_partkey % 60 AS k, sum(l_quantity) AS score FROM lineitem GROUP BY 1, 2)"


def direction_sql(a: str, b: str, prefix: str) -> str:
    return f"""SELECT round(avg((rank = 1)::INT), 6) AS {prefix}_recall_at_1, round(avg((rank <= least(5, n))::INT), 6) AS {prefix}_recall_at_5, round(avg(1.0 / rank), 6) AS {prefix}_mrr
FROM (SELECT {a}, {b}, row_number() OVER (PARTITION BY {a} ORDER BY score DESC, {b}) AS rank, count(*) OVER (PARTITION BY {a}) AS n FROM s) WHERE {a} = {b}"""


@query(f"WITH {SIMILAR}, x AS ({direction_sql('q', 'k', 'board_to_text')}), y AS ({direction_sql('k', 'q', 'text_to_board')}) SELECT * FROM x, y")
def directional_metrics(spark, sf_dir):
    """Ranks by place in both directions, of quantities between suppliers and parts."""
    scores = written(table(spark, sf_dir, "lineitem").groupBy((F.col("l_suppkey") % 60).alias("q"), (F.col("l_partkey") % 60).alias("k")).agg(F.sum("l_quantity").alias("score")), "scores")
    one, other = targets.directional_metrics(scores, "q", "k", "score", "board_to_text"), targets.directional_metrics(scores, "k", "q", "score", "text_to_board")
    return one.join(F.broadcast(other))  # one row each


EXTRA = {"fork": ("hanging",), "plan": ("nothing here", "king")}
PLANNED = ["", "x", "", "", "", "x", "", "", "", "x", "", "", ""]


@query(f"""WITH l AS (SELECT {dealt_sql('id', LABELS)} AS labels, {dealt_sql('id', PLANNED)} AS planned FROM {REMARKED}), b AS (SELECT label, count(*) AS n FROM (SELECT unnest(string_split(labels, ',')) AS label FROM l) WHERE label <> '' GROUP BY 1)
SELECT label, n AS before, n AS after, 0 AS added FROM b UNION ALL SELECT 'plan', 0, count(*), count(*) FROM l WHERE planned = 'x'""")
def target_recount(spark, sf_dir):
    """Labels with a second map of keywords merged in."""
    return targets.recount(remarks(spark, sf_dir), "text", scoring.KEYWORD_LABELS, EXTRA)


@query("""WITH r AS (SELECT p_brand, p_name, p_partkey % 3 <> 0 AS told, p_size % 2 = 0 AS promotion_flag FROM part), t AS (SELECT p_brand, unnest(list_filter(list_concat(string_split(p_name, ' '), [CASE WHEN promotion_flag THEN 'promotion_flag' END]), lambda x: x IS NOT NULL)) AS token FROM r),
c AS (SELECT p_brand, token, count(*) AS n FROM t GROUP BY 1, 2)
SELECT p_brand, total_rows, raw_text_rows, label_vocabulary, token_vocabulary FROM (SELECT p_brand, count(*) AS total_rows, count(*) FILTER (told) AS raw_text_rows FROM r GROUP BY 1) JOIN
 (SELECT p_brand, count(*) FILTER (token <> 'promotion_flag') AS label_vocabulary, count(*) FILTER (n >= 5) AS token_vocabulary FROM c GROUP BY 1) USING (p_brand)""")
def text_realism(spark, sf_dir):
    """How much of the rows' text is their own, and how many labels occur often enough, by family."""
    rows = puzzle_parts(spark, sf_dir).withColumns({"strategy": F.when(F.col("p_partkey") % 3 == 1, "told"), "tactic": F.when(F.col("p_partkey") % 3 == 2, "told").otherwise("")})
    return targets.text_realism(rows, "p_brand", ["strategy", "tactic"], "target_labels", ["promotion_flag"], 5)


@query("SELECT reason, sum(n)::BIGINT AS n FROM (SELECT o_orderpriority AS reason, count(*) AS n FROM orders GROUP BY o_orderstatus, o_orderpriority) GROUP BY 1")
def drop_reason_rollup(spark, sf_dir):
    """Drop reasons added up over the manifests of three tables."""
    root = fresh(spark, "manifests")
    counts = table(spark, sf_dir, "orders").groupBy("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n")).collect()  # fifteen rows
    for status in sorted({r["o_orderstatus"] for r in counts}):
        sinks.write_yaml(spark, {"report": {"rows": 1, "drop_reasons": {r["o_orderpriority"]: r["n"] for r in counts if r["o_orderstatus"] == status}}}, f"{root}/{status}.yaml")
    return reports.summed_drop_reasons(readers.read_settings(spark, f"{root}/*.yaml"))
