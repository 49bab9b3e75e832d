"""Queries of composed sidecar tables over the test tables and small written-out ones."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandmill.functions import scoring
from strandmill.functions.hashing import Sql as H
from strandmill.functions.hashing import split_of
from strandmill.operators import builders
from strandmill.plans.cases import dealt_out, dealt_sql
from strandmill.plans.curation import SPLIT, T, documents
from strandmill.plans.evaluation import RANKS, ranked
from strandmill.plans.registry import Registry, table
from strandmill.sources import readers, sinks
from strandmill.sources.shared import fresh

REGISTRY = Registry()
query = REGISTRY.query



@query("""WITH last AS (SELECT user_id, max(event_id) AS e FROM events GROUP BY 1)
SELECT o_orderkey AS id, e::BIGINT AS engine_depth, CASE WHEN e % 3 <> 0 THEN e % 500 END::BIGINT AS engine_cp, CASE WHEN e % 3 = 0 THEN e % 7 END::BIGINT AS engine_mate, CASE WHEN e % 4 = 0 THEN 'b2b3' ELSE 'e2e' || (e % 8 + 1) END AS engine_best
FROM orders LEFT JOIN last ON o_custkey = user_id AND o_orderkey % 5 < 3""")
def enriched_positions(spark, sf_dir):
    """A position of each order without its clocks meets the deepest evaluation among the events of its customer, flat or nested."""
    fen = F.when(F.col("o_orderkey") % 5 == 3, "broken").when(F.col("o_orderkey") % 5 < 3, F.concat(F.lit("p"), F.col("o_custkey").cast("string"), F.lit(" w - - "), F.col("o_orderkey").cast("string"), F.lit(" 1")))
    base = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), fen.alias("fen"))
    e = F.col("event_id").cast("int")
    cp, mate, nested = F.when(e % 3 != 0, e % 500), F.when(e % 3 == 0, e % 7), e % 4 == 0
    line = lambda cp, mate, line: F.array(F.struct(cp.cast("int").alias("cp"), mate.cast("int").alias("mate"), F.lit(line).alias("line")))
    evals = F.array(F.struct(F.lit(-2).alias("depth"), line(F.lit(5), F.lit(None), "a2a3").alias("pvs")), F.struct(e.alias("depth"), line(cp, mate, "b2b3 b7b6").alias("pvs")))
    evaluations = table(spark, sf_dir, "events").select(
        F.concat(F.lit("p"), F.col("user_id").cast("string"), F.lit(" w - - 0 1")).alias("fen"), F.when(~nested, e).alias("depth"), F.when(~nested, cp).alias("cp"), F.when(~nested, mate).alias("mate"),
        F.when(~nested, F.concat(F.lit("e2e"), (e % 8 + 1).cast("string"), F.lit(" e7e5"))).alias("pv"), F.when(nested, evals).alias("evals"))
    return builders.enriched(base, evaluations).select("id", *[F.col(f"engine_{c}").cast("long").alias(f"engine_{c}") for c in ("depth", "cp", "mate")], "engine_best")


FAMILY = "CASE WHEN lang = 'en' THEN 'waterhorse_annotated_pgn' ELSE 'mate_' || lang END"
CAPS, LEAST = {"train": 40, "val": 5, "test": 0}, {"train": 10, "val": 8, "test": 3}
UNION = f"""u AS (SELECT doc_id AS id, {SPLIT} AS split, {FAMILY} AS source, coalesce(source, 'unknown') AS family, text, 'annotated_pgn_comment' AS semantics FROM documents
  UNION ALL SELECT 1000000000 + conv_id * 1000 + turn, {H.split_of('conv_id')}, 'chat', role, text, 'pairwise_explanation' FROM conversations),
m AS (SELECT *, row_number() OVER (PARTITION BY split, coalesce(nullif(family, ''), 'unknown') ORDER BY {{key}}, id) AS place FROM u)"""


def annotated(spark, sf_dir):
    source = F.when(F.col("lang") == "en", "waterhorse_annotated_pgn").otherwise(F.concat(F.lit("mate_"), "lang"))
    return documents(spark, sf_dir).select(F.col("doc_id").cast("long").alias("id"), "split", source.alias("source"), F.coalesce("source", F.lit("unknown")).alias("source_family"), "text")


def prompts(spark, sf_dir):
    number = (F.lit(1_000_000_000) + F.col("conv_id") * 1000 + F.col("turn")).cast("long")
    return table(spark, sf_dir, "conversations").select(number.alias("id"), F.col("conv_id").alias("game"), F.lit("chat").alias("source"), F.col("role").alias("source_family"), "text")


@query(f"WITH {UNION.format(key=H.rank_key('multi', 'id'))} SELECT id, split, source, family AS source_family, semantics FROM m WHERE split = 'test' OR place <= CASE split WHEN 'train' THEN 40 ELSE 8 END")
def multisource_sidecar(spark, sf_dir):
    """Two sources in one shape, capped by split and family, with a minimum above the cap of one split."""
    return builders.multisource(annotated(spark, sf_dir), prompts(spark, sf_dir), CAPS, LEAST, "multi").drop("text")


@query(f"""WITH {UNION.format(key=H.rank_key('multi', 'id'))}, k AS (SELECT coalesce(nullif(family, ''), 'unknown') AS f, count(*) AS c FROM m WHERE split = 'test' OR place <= CASE split WHEN 'train' THEN 40 ELSE 8 END GROUP BY 1)
SELECT sum(c)::BIGINT AS n, count(*) AS families, round(max(c) / sum(c), 6) AS largest_share, max(c) / sum(c) >= 0.5 AS single_family_dominant FROM k""")
def multisource_report(spark, sf_dir):
    return builders.family_report(builders.multisource(annotated(spark, sf_dir), prompts(spark, sf_dir), CAPS, LEAST, "multi"))


TYPE = "CASE WHEN source = 'waterhorse_annotated_pgn' THEN 'waterhorse_only' WHEN source LIKE 'mate~_%' ESCAPE '~' THEN 'mate_only' ELSE 'other' END"


def balanced_sql() -> str:
    parts = []
    for name, group, caps in (("family_balanced", "family", (30, 5, 5)), ("source_type_balanced", TYPE, (100, 12, 12)), ("family_balanced_plus_style_normalized", "family", (30, 5, 5))):
        parts.append(f"""SELECT '{name}' AS variant, split, id, family FROM (SELECT *, row_number() OVER (PARTITION BY split, {group} ORDER BY {H.rank_key(f'balance:{name}', 'id')}, id) AS place FROM u)
WHERE place <= CASE split WHEN 'train' THEN {caps[0]} WHEN 'val' THEN {caps[1]} ELSE {caps[2]} END""")
    return " UNION ALL ".join(parts)


@query(f"WITH {UNION.format(key='id')} SELECT variant, split, id FROM ({balanced_sql()})")
def balanced_sidecar(spark, sf_dir):
    """The rows of the three variants of a balanced table."""
    rows = annotated(spark, sf_dir).unionByName(prompts(spark, sf_dir).withColumn("split", split_of("game")).drop("game"))
    made = builders.balanced(rows, {"train": 30, "val": 5, "test": 5}, {"train": 100, "val": 12, "test": 12}, "balance")
    parts = [v.select(F.lit(name).alias("variant"), "split", "id") for name, v in made.items()]
    return parts[0].union(parts[1]).union(parts[2])


@query(f"""WITH d AS (SELECT {FAMILY} AS source, coalesce(nullif(source, ''), 'unknown') AS family FROM documents), p AS (SELECT 'source' AS field, source AS value FROM d UNION ALL SELECT 'source_family', family FROM d)
SELECT field, value, count(*) AS n, round(count(*) / (SELECT count(*) FROM d), 6) AS share FROM p GROUP BY 1, 2""")
def regime_metadata(spark, sf_dir):
    return builders.regime_metadata(annotated(spark, sf_dir), ["source", "source_family"])


@query(f"WITH d AS (SELECT {SPLIT} AS split, {FAMILY} AS source FROM documents), k AS (SELECT split, {TYPE} AS kind FROM d) SELECT kind, split, count(*) AS n FROM (SELECT * FROM k UNION ALL SELECT split, 'mixed' FROM k) GROUP BY 1, 2")
def source_type_ablation(spark, sf_dir):
    rows, parts = annotated(spark, sf_dir).select("split", "source"), None
    for kind in ("mixed", "waterhorse_only", "mate_only", "other"):
        one = builders.of_source_type(rows, "source", kind).groupBy("split").agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), "split", "n")
        parts = one if parts is None else parts.union(one)
    return parts


#: Variants of the documents: all, those of even ids and the rest of one language, and those of most sources.
KEEPS = {"all": "true", "even": "id % 2 = 0 OR source = 'waterhorse_annotated_pgn'", "most": "id % 5 <> 0"}
HOLD = scoring.Thresholds(20, 10, 1, 1)


def shared_sql() -> str:
    cte = f"""u AS (SELECT doc_id AS id, {SPLIT} AS split, {FAMILY} AS source, coalesce(nullif(source, ''), 'unknown') AS family FROM documents),
w AS ({' UNION ALL '.join(f"SELECT '{n}' AS variant, * FROM u WHERE {c}" for n, c in KEEPS.items())}),
k AS (SELECT variant, id, split, 'mixed_baseline' AS category, NULL AS field, NULL AS value FROM w UNION ALL SELECT variant, id, split, 'source', 'source', source FROM w UNION ALL SELECT variant, id, split, 'family', 'source_family', family FROM w),
c AS (SELECT category, field, value FROM (SELECT variant, category, field, value FROM k GROUP BY ALL HAVING field IS NULL OR (count(*) >= 20 AND count(*) FILTER (split = 'train') >= 10 AND count(*) FILTER (split = 'val') >= 1 AND count(*) FILTER (split = 'test') >= 1)) GROUP BY ALL HAVING count(*) = 3),
t AS (SELECT category, field, value, id FROM (SELECT DISTINCT category, field, value, id, variant FROM k WHERE split = 'test') GROUP BY ALL HAVING count(*) = 3),
s AS (SELECT c.*, t.id FROM c LEFT JOIN t ON c.category = t.category AND c.field IS NOT DISTINCT FROM t.field AND c.value IS NOT DISTINCT FROM t.value),
r AS (SELECT category, field, value, count(id) AS shared_test_rows FROM s GROUP BY ALL)"""
    return cte


def holdouts(spark, sf_dir):
    rows = annotated(spark, sf_dir)
    return builders.shared_holdouts({n: rows.where(c) for n, c in KEEPS.items()}, {"source": "source", "family": "source_family"}, HOLD, 5)


@query(f"WITH {shared_sql()} SELECT *, CASE WHEN shared_test_rows < 5 THEN 'shared_test_rows<5' END AS reason FROM r")
def shared_holdout(spark, sf_dir):
    """Regimes that are eligible in every variant, with the test rows that all of them share."""
    return holdouts(spark, sf_dir)[0]


@query(f"WITH {shared_sql()} SELECT s.category, s.field, s.value, s.id FROM s JOIN r ON r.category = s.category AND r.field IS NOT DISTINCT FROM s.field AND r.value IS NOT DISTINCT FROM s.value WHERE shared_test_rows >= 5")
def shared_holdout_ids(spark, sf_dir):
    return holdouts(spark, sf_dir)[1]


def chat_line(text):
    """A JSON line of one of eight shapes around a text, by the row's number."""
    one = lambda **fields: F.struct(*[F.lit(v).alias(k) if isinstance(v, str) else v.alias(k) for k, v in fields.items()])
    shapes = [
        F.to_json(one(messages=F.array(one(role="human", content=F.concat(F.lit(" "), text, F.lit(" "))), one(role="gpt", content="Hello")))),
        F.to_json(one(conversations=F.array(one(**{"from": "User"}, value=text), one(**{"from": "model"}, value="")))),
        F.to_json(one(dialogue=F.array(one(author="bot", text=text)), messages=F.array().cast("array<string>"))),
        F.to_json(one(messages=F.array(one(role="user", content="  ")), note=text)),
        F.to_json(one(instruction=text, output="done")), F.to_json(one(title="", body=text)), F.to_json(one(other=text)), F.concat(F.lit("broken "), text),
    ]
    kind = F.col("id") % 8
    return F.coalesce(*[F.when(kind == i, s) for i, s in enumerate(shapes)])


SAID = T.normalize("text", "raw")


@query(f"""WITH c AS (SELECT conv_id * 100 + turn AS id, coalesce(text, '') AS text FROM conversations)
SELECT id, CASE WHEN id % 8 < 3 THEN 'conversation' WHEN id % 8 = 3 THEN 'no_messages' WHEN id % 8 < 6 THEN 'text' ELSE 'no_text' END AS kind,
  md5(CASE id % 8 WHEN 0 THEN 'user: ' || {SAID} || '|assistant: Hello' WHEN 1 THEN 'user: ' || {SAID} WHEN 2 THEN 'assistant: ' || {SAID} WHEN 4 THEN text || '|done|' WHEN 5 THEN '||' || text ELSE '' END) AS shown_md5 FROM c""")
def chat_corpus(spark, sf_dir):
    """Turns as JSON lines of several shapes, told apart and brought into two."""
    rows = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 100 + F.col("turn")).alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    talks, texts, ledger = builders.chat_corpus(rows.select("id", chat_line(F.col("text")).alias("line")), "line", "id")
    shown = F.array_join(F.transform("messages", lambda m: F.concat_ws(": ", m["role"], m["content"])), "|")
    plain = F.concat_ws("|", *[F.coalesce(c, F.lit("")) for c in ("prompt", "response", "text")])
    every = talks.select("id", F.lit("conversation").alias("kind"), shown.alias("shown")).union(texts.select("id", F.lit("text"), plain)).union(ledger.select("id", "drop_reason", F.lit("")))
    return every.select("id", "kind", F.md5("shown").alias("shown_md5"))


@query("""WITH c AS (SELECT conv_id * 100 + turn AS id FROM conversations), k AS (SELECT CASE WHEN id % 8 < 3 THEN 'conversation' WHEN id % 8 IN (4, 5) THEN 'text' ELSE 'dropped' END AS schema, id FROM c)
SELECT schema, count(*) AS written, sum(id)::BIGINT AS ids, count(*) AS noted FROM k GROUP BY 1""")
def roundtrip_chat_corpus(spark, sf_dir):
    """The normalised corpus written by schema with its manifest, and read again."""
    rows = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 100 + F.col("turn")).alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    root = fresh(spark, "corpus")
    sinks.write_by_schema(dict(zip(("conversation", "text", "dropped"), builders.chat_corpus(rows.select("id", chat_line(F.col("text")).alias("line")), "line", "id"))), root)
    noted = readers.read_settings(spark, f"{root}/manifest.yaml").select(F.explode(F.from_json("settings", "rows map<string,bigint>")["rows"]).alias("schema", "noted"))
    parts = None
    for name in ("conversation", "text", "dropped"):
        one = spark.read.schema("id bigint").json(f"{root}/{name}.jsonl").select(F.lit(name).alias("schema"), "id")
        parts = one if parts is None else parts.union(one)
    return parts.groupBy("schema").agg(F.count("*").alias("written"), F.sum("id").alias("ids")).join(noted, "schema")


@query("""WITH last AS (SELECT user_id, max(event_id) AS e FROM events GROUP BY 1), j AS (SELECT o_orderkey, e FROM orders LEFT JOIN last ON o_custkey = user_id AND o_orderkey % 5 < 3)
SELECT count(*) AS rows, count(e) AS matched, count(*) - count(e) AS unmatched, count(*) FILTER (e % 3 = 0) AS mates, sum(CASE WHEN e % 3 <> 0 THEN e % 500 END)::BIGINT AS cp FROM j""")
def enriched_file(spark, sf_dir):
    """Enriched positions written as JSON lines, with the counters of their manifest held against the file."""
    root = fresh(spark, "enriched")
    sinks.write_jsonl(enriched_positions(spark, sf_dir), f"{root}/rows.jsonl")
    rows = spark.read.schema("id bigint, engine_depth bigint, engine_cp bigint, engine_mate bigint, engine_best string").json(f"{root}/rows.jsonl")
    return rows.agg(F.count("*").alias("rows"), F.count("engine_depth").alias("matched"), F.count_if(F.col("engine_depth").isNull()).alias("unmatched"), F.count("engine_mate").alias("mates"), F.sum("engine_cp").alias("cp"))


#: source, strategy, tactic, preferred move, themes, move, whether it is matched; and the answers.
RATIONALES = [
    ("mate", "A: x || B: a plan", "A: d2d4 || B: e2e4 e7e5", "MoveB:e2e4", None, "e2e4", 1, "a plan e2e4 e7e5", ""), ("mate", "A: first strategy || B: y", None, None, None, None, 1, "first strategy", ""),
    ("puzzle", None, None, None, "fork|mateIn2", None, 1, "Puzzle themes: fork, mateIn2", "fork,mateIn2"), ("puzzle", None, None, None, "", "e2e4", 1, "Move focus: e2e4", ""),
    ("mate", "whole text on mate", None, None, None, None, 1, "whole text on mate", "checkmate_pattern"), ("mate", "A: z", None, None, None, None, 0, "", ""),
    ("other", "now open", "file it, then check", None, None, None, 1, "now open file it, then check", "check"), ("puzzle", "mate", "an exchange", None, "zugzwang|exchange", None, 1, "Puzzle themes: zugzwang, exchange", "checkmate_pattern,exchange,zugzwang"),
]


@query(f"SELECT o_orderkey::VARCHAR AS sidecar_id, {dealt_sql('o_orderkey', [r[7] for r in RATIONALES])} AS rationale_short, {dealt_sql('o_orderkey', [r[8] for r in RATIONALES])} AS motifs FROM orders WHERE o_orderkey % 8 <> 5")
def rationale_sidecar(spark, sf_dir):
    """The preferred option of a prompt, the first one, themes, the move, a text without options; unmatched rows are left out.
    Motifs are a row's themes and the tags of each of its texts."""
    column = lambda i, kind="string": dealt_out("o_orderkey", [r[i] for r in RATIONALES], kind)
    themes = column(4)
    rows = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").cast("string").alias("sidecar_id"), F.when(column(6, "int") == 1, F.concat(F.lit("p"), F.col("o_orderkey").cast("string"))).alias("matched_position_id"), column(0).alias("source"),
        column(1).alias("strategy_text"), column(2).alias("tactic_text"), column(3).alias("preferred_move"), F.when(themes == "", F.array().cast("array<string>")).otherwise(F.split(themes, r"\|")).alias("theme_tags"), column(5).alias("matched_move"))
    return builders.rationales(rows).select("sidecar_id", "rationale_short", "motifs")


@query(f"""WITH q AS (SELECT {SPLIT} AS split, source AS game, CASE WHEN text IS NULL THEN 'invalid_fen' WHEN lang IS NULL THEN 'invalid_target_move_uci' END AS reason FROM documents),
l AS (SELECT count(*) FILTER (n > 1) AS leaks FROM (SELECT count(DISTINCT split) AS n FROM q WHERE game IS NOT NULL GROUP BY game)),
c AS (SELECT count(*) FILTER (reason = 'invalid_fen') AS f, count(*) FILTER (reason = 'invalid_target_move_uci') AS m, count(*) FILTER (split = 'train') AS tr, count(*) FILTER (split = 'val') AS va, count(*) FILTER (split = 'test') AS te FROM q)
SELECT unnest(['no_invalid_fen_rows', 'no_invalid_target_move_rows', 'no_history_fens_contract_violations', 'no_split_leakage_by_game_id', 'train_non_empty', 'val_non_empty', 'test_non_empty', 'val_not_tiny', 'test_not_tiny']) AS gate,
  unnest([f = 0, m = 0, true, leaks = 0, tr > 0, va > 0, te > 0, va >= 20, te >= 1000]) AS passed FROM c, l""")
def pilot_gates(spark, sf_dir):
    """The nine gates over documents, with sources as games."""
    rows = documents(spark, sf_dir).select("split", F.col("source").alias("game"), F.when(F.col("text").isNull(), "invalid_fen").when(F.col("lang").isNull(), "invalid_target_move_uci").alias("reason"))
    return builders.pilot_gates(rows, "game", "split", "reason", 20, 1000)


@query(f"""WITH {RANKS} SELECT count(*) FILTER (rank = 1) AS rank_1, count(*) FILTER (rank BETWEEN 2 AND 5) AS rank_2_to_5, count(*) FILTER (rank > 5) AS rank_over_5, count(*) FILTER (ties > 1) AS tied_queries,
  round(avg(ties - 1), 6) AS mean_tied, max(ties - 1) AS most_tied, count(*) FILTER (strict_rank > rank) AS penalties FROM r""")
def rank_histogram(spark, sf_dir):
    found = builders.rank_diagnostics(ranked(spark, sf_dir))
    return found.withColumns({c: F.when(F.col("rank_1") + F.col("rank_2_to_5") + F.col("rank_over_5") > 0, F.col(c)) for c in ("mean_tied", "most_tied")})  # as the SQL, nothing is known of no rows
