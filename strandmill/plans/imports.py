"""Queries of sources that need more than Spark's readers: archives of explained choices, rows of unknown shape, annotated games."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandmill.operators import builders, movetext, pairwise, variants
from strandmill.plans.curation import T
from strandmill.plans.registry import Registry, table
from strandmill.sources import archives, readers, sinks
from strandmill.sources.shared import fresh

REGISTRY = Registry()
query = REGISTRY.query

MEMBERS = "['data_strategy.jsonl', 'Tactic_part.jsonl', 'x_noexplain.jsonl', 'both.jsonl', '__MACOSX/both.jsonl', 'notes.txt', 'sub/strategy_2.jsonl'][(id % 7 + 1)::INT]"
TURNS = f"""c AS (SELECT conv_id * 100 + turn AS id, coalesce(text, '') AS text FROM conversations),
n AS (SELECT *, 'mate_' || (id // 100) % 5 AS archive, {MEMBERS} AS member FROM c), r AS (SELECT *, row_number() OVER (PARTITION BY archive, member ORDER BY id) - 1 AS line FROM n)"""


def prompts(spark, sf_dir):
    """Turns as prompts of explained choices: one in eleven of each kind lacks its position, a move, a choice or a text, or is blank."""
    names = ["data_strategy.jsonl", "Tactic_part.jsonl", "x_noexplain.jsonl", "both.jsonl", "__MACOSX/both.jsonl", "notes.txt", "sub/strategy_2.jsonl"]
    n = F.col("id") % 11
    text = F.coalesce("text", F.lit(""))
    asked = F.concat(
        F.when(n == 1, "no position ").otherwise(F.concat(F.lit('The FEN of the given chess board is "8/8 w - - '), F.col("id").cast("string"), F.lit('". Which? '))),
        F.lit("MoveA:e2e4 ,, "), F.when(n == 2, "").otherwise(text), F.when(n == 3, " no second").otherwise(F.concat(F.lit(" MoveB:G7G8q tactic "), text)))
    told = F.when(n == 4, "neither").when(n == 5, "MoveA:a1a1").when((n == 2) | (F.col("id") % 2 == 0), "Movea:E2E4").otherwise("I say MoveB:g7g8q.")
    line = F.when(n == 0, "  ").otherwise(F.to_json(F.struct(asked.alias("input"), F.when(n != 6, told).alias("output"))))
    rows = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 100 + F.col("turn")).alias("id"), "text")
    member = F.get(F.array(*map(F.lit, names)), F.pmod("id", F.lit(7)).cast("int"))
    return rows.select(F.concat(F.lit("mate_"), (F.floor(F.col("id") / 100) % 5).cast("string")).alias("archive"), member.alias("member"), "id", line.alias("value"))


def archived(spark, sf_dir, size: int):
    """The lines of archives that were written from the prompts; the paths are few, one for each archive."""
    root = fresh(spark, "archives")
    made = archives.write_archives(prompts(spark, sf_dir), root, "archive", "member", "id", "value").collect()
    return archives.read_members(spark, sorted(r["path"] for r in made), size)


@query(f"WITH {TURNS} SELECT archive || '.zip' AS archive, member, count(*) AS lines, max(line) AS last FROM r WHERE member NOT LIKE '%MACOSX%' GROUP BY 1, 2")
def archive_members(spark, sf_dir):
    """Lines of the members of archives, a few members a task."""
    lines = archived(spark, sf_dir, 2000)
    return lines.groupBy(F.regexp_extract("path", "([^/]*)$", 1).alias("archive"), "member").agg(F.count("*").alias("lines"), F.max("line").alias("last"))


@query(f"""WITH {TURNS}, k AS (SELECT *, CASE WHEN lower(member) LIKE '%strategy%' THEN 'strategy' WHEN lower(member) LIKE '%tactic%' THEN 'tactic' ELSE 'both' END AS source_family,
  CASE WHEN id % 11 = 2 OR id % 2 = 0 THEN 'A' ELSE 'B' END AS choice, {T.collapse('text')} AS told, split_part(member, '/', -1) || ':' || line AS source_row_id
  FROM r WHERE member LIKE '%.jsonl' AND member NOT LIKE '%MACOSX%' AND member NOT LIKE '%noexplain%' AND id % 11 NOT IN (0, 1, 2, 3, 4, 5, 6))
SELECT id, source_family, source_row_id, CASE choice WHEN 'A' THEN 'e2e4' ELSE 'g7g8q' END AS move,
  md5(CASE WHEN choice = 'A' THEN told WHEN source_family = 'tactic' THEN trim('Tactic: ' || told) ELSE trim('tactic ' || told) END) AS comment_md5,
  'sidecar_' || substr(sha256('mate:' || source_row_id || ':comment'), 1, 16) AS sidecar_id FROM k WHERE choice = 'B' OR told <> ''""")
def pairwise_sidecar(spark, sf_dir):
    """Explained choices of archives: members by name, rows whose parts are all there, the chosen move's text."""
    rows = pairwise.pairwise_rows(archived(spark, sf_dir, 2000), "mate")
    return rows.select(F.regexp_extract("fen", r"(\d+)$", 1).cast("long").alias("id"), "source_family", "source_row_id", F.col("target_move_uci").alias("move"), F.md5("comment_text").alias("comment_md5"), "sidecar_id")


@query("""SELECT 'orders_' || o_orderkey % 3 || '.zip' AS archive, ['plain.jsonl', 'a.jsonl.gz', 'b.jsonl.xz', 'c.jsonl.bz2'][(o_orderkey % 4 + 1)::INT] AS member, count(*) AS lines, sum(o_orderkey)::BIGINT AS keys FROM orders GROUP BY 1, 2""")
def roundtrip_inner_members(spark, sf_dir):
    """Members that are packed once more inside their archive, by gz, xz and bz2."""
    key = F.col("o_orderkey")
    member = F.get(F.array(*map(F.lit, ["plain.jsonl", "a.jsonl.gz", "b.jsonl.xz", "c.jsonl.bz2"])), (key % 4).cast("int"))
    rows = table(spark, sf_dir, "orders").select(F.concat(F.lit("orders_"), (key % 3).cast("string")).alias("archive"), member.alias("member"), key.alias("id"), F.to_json(F.struct(key.alias("id"))).alias("value"))
    made = archives.write_archives(rows, fresh(spark, "inner"), "archive", "member", "id", "value").collect()
    lines = archives.read_members(spark, sorted(r["path"] for r in made), 1000).select("path", "member", F.from_json("value", "id bigint")["id"].alias("id"))
    return lines.groupBy(F.regexp_extract("path", "([^/]*)$", 1).alias("archive"), "member").agg(F.count("*").alias("lines"), F.sum("id").alias("keys"))


# rows of unknown shape

BOARD = "8/8/8/8/8/8/8/K1k5"


def fields(**named):
    """A JSON object of columns and texts."""
    return F.to_json(F.struct(*[(F.lit(v) if isinstance(v, (str, int)) else v).alias(k) for k, v in named.items()]))


def shaped_lines(spark, sf_dir):
    """Documents and turns of conversations as JSON lines of ten shapes, some of them broken: ``(source, file, number, value)``."""
    text, n = F.coalesce("text", F.lit("")), F.col("doc_id").cast("string")
    strings = lambda *x: F.array(*map(F.lit, x))
    say = lambda role, content: F.struct(*([F.lit(role).alias("role")] if role else []), (F.lit(content) if isinstance(content, str) else content).alias("content"))
    kinds = [
        fields(text=text), fields(text=F.concat(F.lit('[Event "x"]\n'), text), pipeline_key=F.concat(F.lit("k"), n)),
        fields(text=F.concat(F.lit(f'[FEN "{BOARD} w - - 0 1"]\n'), text), id=n, metadata=F.struct(F.concat(F.lit("g"), (F.col("doc_id") % 5).cast("string")).alias("game_id"))),
        fields(fen=f"{BOARD} b - - 3 4", candidate_moves=strings("e2e4", "d2d4"), prompt=" ask ", response=text, id=F.col("doc_id")), fields(text="  ", fen="", id=n),
        F.concat(F.lit("[1, "), n, F.lit("]")), F.concat(F.lit("{broken "), n), fields(text=F.concat(F.lit('[FEN "bad"]\n'), n), candidate_moves="e2e4, d2d4", source_row_id=n, source="own"),
        F.concat(F.lit('{"schema": "conversation", "id": "'), n, F.lit('", "messages": ['), fields(role="user", content=text), F.lit(', {"content": " ok "}, {"role": "x", "content": " "}, "no object"]}')),
    ]
    value = F.coalesce(*[F.when(F.col("doc_id") % 9 == i, k) for i, k in enumerate(kinds)])
    docs = table(spark, sf_dir, "documents").select(F.lit("waterhorse_raw").alias("source"), F.concat(F.lit("w_"), (F.col("doc_id") % 3).cast("string"), F.lit(".jsonl")).alias("file"), F.col("doc_id").alias("number"), value.alias("value"))
    said = F.concat(F.lit('{"schema": "conversation", "game_id": '), F.col("conv_id").cast("string"), F.lit(', "messages": ['), fields(role=F.col("role"), content=text), F.lit("]}"))
    return docs.union(table(spark, sf_dir, "conversations").select(F.lit("chessgpt"), F.lit("chat.jsonl"), F.col("conv_id") * 100 + F.col("turn"), said))


RAW = T.normalize("text", "raw")
SHAPED = f"""s AS (
  SELECT 'waterhorse_raw' AS source, 'w_' || doc_id % 3 || '.jsonl' AS file, doc_id AS number, (doc_id % 9)::INT AS shape, doc_id::VARCHAR AS n, {RAW} AS said, coalesce(text, '') AS text FROM documents
  UNION ALL SELECT 'chessgpt', 'chat.jsonl', conv_id * 100 + turn, 9, conv_id::VARCHAR, role || ': ' || {RAW}, coalesce(text, '') FROM conversations),
t AS (SELECT *, nullif(CASE shape WHEN 0 THEN said WHEN 1 THEN {T.normalize("'[Event \"x\"]' || chr(10) || text", 'raw')} WHEN 2 THEN {T.normalize(f"'[FEN \"{BOARD} w - - 0 1\"]' || chr(10) || text", 'raw')}
  WHEN 3 THEN concat_ws(chr(10), 'ask', nullif(said, '')) WHEN 7 THEN '[FEN "bad"]' || chr(10) || n WHEN 8 THEN concat_ws(chr(10), 'user: ' || nullif(said, ''), 'unknown: ok') WHEN 9 THEN nullif(said, role_only) END, '') AS body
  FROM (SELECT *, CASE WHEN shape = 9 THEN split_part(said, ': ', 1) || ': ' END AS role_only FROM s)),
k AS (SELECT *, CASE WHEN shape = 3 THEN 'fen' WHEN shape = 7 THEN NULL WHEN contains(body, '[') THEN 'pgn_mainline' END AS anchor FROM t),
c AS (SELECT *, CASE WHEN body IS NULL THEN 'unusable' WHEN anchor IS NULL THEN 'text_only' ELSE 'board_anchored' END AS kind FROM k)"""
SOURCES = ["waterhorse_raw", "chessgpt", "never_fetched"]


def shaped(spark, sf_dir):
    return variants.classified(variants.parsed(shaped_lines(spark, sf_dir), "value"))


@query(f"WITH {SHAPED} SELECT source, number, kind, anchor, md5(body) AS text_md5, CASE WHEN shape IN (3, 7) THEN 2 ELSE 0 END::BIGINT AS moves FROM c")
def aux_classes(spark, sf_dir):
    """What each row of unknown shape is good for."""
    return shaped(spark, sf_dir).select("source", "number", "kind", "anchor", F.md5("text").alias("text_md5"), F.coalesce(F.size("moves"), F.lit(0)).cast("long").alias("moves"))


@query(f"""WITH {SHAPED}, g AS (SELECT *, CASE shape WHEN 1 THEN 'k' || n ELSE n END AS row_id FROM c WHERE kind <> 'unusable' AND shape <> 0)
SELECT CASE shape WHEN 7 THEN 'own' ELSE source END AS source, CASE WHEN shape IN (8, 9) THEN 'conversation' ELSE 'unknown' END AS source_schema, row_id AS source_row_id, 'aux_' || substr(sha256(source || ':' || row_id), 1, 16) AS aux_id, kind,
  md5(body) AS text_md5, CASE WHEN shape IN (8, 9) THEN 'conversation' ELSE 'natural_text' END AS text_kind, CASE WHEN anchor = 'fen' THEN '{BOARD} b - -' WHEN shape = 2 THEN '{BOARD} w - -' WHEN anchor IS NOT NULL THEN 'rnbqkbnr/pppppppp/8/8/8/8/PPPPPPPP/RNBQKBNR w KQkq -' END AS fen_4field,
  CASE WHEN kind = 'board_anchored' THEN CASE WHEN shape = 2 THEN 'g' || number % 5 WHEN shape = 1 THEN 'pgn_' || substr(sha256(substr('[Event "x"]' || chr(10) || text, 1, 2048)), 1, 16) WHEN anchor = 'pgn_mainline' THEN 'pgn_' || substr(sha256(''), 1, 16) ELSE row_id END END AS split_group_id FROM g""")
def aux_corpus(spark, sf_dir):
    """The usable rows in one shape; those without any name of their own are named by a digest of themselves and left to a test."""
    rows = variants.normalized(shaped(spark, sf_dir)).where(~F.col("source_row_id").startswith("row_"))
    return rows.select("source", "source_schema", "source_row_id", "aux_id", "kind", F.md5("text").alias("text_md5"), "text_kind", "fen_4field", "split_group_id")


@query(f"""WITH {SHAPED} SELECT source, file, count(*) AS rows, count(*) FILTER (shape = 3) AS explicit_fen_rows, count(*) FILTER (shape IN (3, 7)) AS explicit_move_list_rows, count(*) FILTER (anchor IS NOT NULL) AS recoverable_board_anchor_rows,
  count(*) FILTER (body IS NOT NULL) AS natural_text_rows, count(*) FILTER (shape >= 8 AND body IS NOT NULL) AS conversation_rows, count(*) FILTER (kind = 'board_anchored') AS board_anchored_rows, count(*) FILTER (kind = 'text_only') AS text_only_rows,
  count(*) FILTER (kind = 'unusable') AS unusable_rows FROM c GROUP BY 1, 2 UNION ALL SELECT 'never_fetched', NULL, 0, 0, 0, 0, 0, 0, 0, 0, 0""")
def aux_inventory(spark, sf_dir):
    """Counters by source and file; a source that was never fetched has zeros."""
    return variants.inventory(shaped(spark, sf_dir), SOURCES)


@query("""SELECT unnest(['k', 'split', 'late', 'nothing']) AS key, unnest([count(*), count(*), count(*) FILTER (event_id % 3 = 0), 0]) AS n, unnest(['all', 'all', 'some', 'none']) AS presence FROM events""")
def key_presence(spark, sf_dir):
    """Which keys all, some or none of the properties carry; a null under a key counts."""
    extra = F.concat(F.expr("substr(props, 1, length(props) - 1)"), F.lit(', "split": null'), F.when(F.col("event_id") % 3 == 0, ', "late": [1]}').otherwise("}"))
    return variants.key_presence(variants.parsed(table(spark, sf_dir, "events").select(extra.alias("props")), "props"), "row", ["k", "split", "late", "nothing"])


# annotated games inside JSON

EVENTS = """e AS (SELECT user_id, event_id // 64 AS part, event_id, event_type, row_number() OVER (PARTITION BY user_id, event_id // 64 ORDER BY event_id) AS i, count(*) OVER (PARTITION BY user_id, event_id // 64) AS size,
  'N' || chr((97 + event_id % 8)::INT) || (event_id % 7 + 1) AS move, sum((event_id % 4 = 0)::INT) OVER (PARTITION BY user_id, event_id // 64 ORDER BY event_id) AS opened FROM events)"""
NODES = f"""WITH {EVENTS}, m AS (
  SELECT user_id, part, i AS ply, 0 AS depth, 0 AS variation, move, CASE WHEN i = 1 AND user_id % 3 = 0 THEN 'a first note' END AS b, nullif(concat_ws(' ', CASE WHEN event_id % 5 = 0 THEN 'said ' || event_type || ' 1. e4 (no)' END, CASE WHEN event_id % 7 = 0 THEN 'rest ' || event_type END), '') AS a,
    concat_ws(',', CASE WHEN event_id % 6 = 0 THEN '1,3' END, CASE WHEN event_id % 11 = 0 THEN '5' END) AS nags FROM e
  UNION ALL SELECT user_id, part, i, 1, 2 * opened - 1, 'Ra1', NULL, 'v1', '' FROM e WHERE event_id % 4 = 0
  UNION ALL SELECT user_id, part, i, 2, 2 * opened, 'Kb2+', 'deep', NULL, '' FROM e WHERE event_id % 4 = 0
  UNION ALL SELECT user_id, part, i + 1, 1, 2 * opened - 1, 'Qc3', NULL, NULL, '2' FROM e WHERE event_id % 4 = 0)
SELECT user_id, part, ply::INT AS ply, depth, variation::INT AS variation, move, concat_ws(chr(10) || chr(10), b, a) AS comment_text, concat_ws('+', CASE WHEN b IS NOT NULL THEN 'starting_comment' END, CASE WHEN a IS NOT NULL THEN 'comment' END, CASE WHEN nags <> '' THEN 'nag' END) AS comment_source, nags
FROM m WHERE b IS NOT NULL OR a IS NOT NULL OR nags <> ''"""


def annotated_games(spark, sf_dir):
    """Games of up to 64 moves, made of a user's events: comments, annotations, nested variations, brackets that do not match."""
    e = F.col("event_id")
    move = F.concat(F.lit("N"), F.chr(F.pmod(e, F.lit(8)) + 97), (F.pmod(e, F.lit(7)) + 1).cast("string"))
    text = F.concat(
        F.lit(" "), move, F.when(e % 11 == 0, "!?").otherwise(""), F.when(e % 6 == 0, " $3 $1 $3").otherwise(""), F.when(e % 5 == 0, F.concat(F.lit(" {said "), F.col("event_type"), F.lit("\n 1. e4 (no)}"))).otherwise(""),
        F.when(e % 7 == 0, F.concat(F.lit(" ; rest "), F.col("event_type"), F.lit("\n"))).otherwise(""), F.when(e % 4 == 0, "\n( 3. Ra1 {v1} ( {deep} 3. Kb2+ ) Qc3 $2 ) ").otherwise(""))
    played = table(spark, sf_dir, "events").select("user_id", F.floor(e / 64).alias("part"), "event_id", text.alias("text")).groupBy("user_id", "part").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("event_id", "text"))), lambda x: x["text"]), " 1... ").alias("moves"))
    user = F.col("user_id").cast("string")
    head = F.concat(F.lit('[Event "E '), user, F.lit('"]\n[Site "a \\"b\\""]\n[Variant "'), F.when(F.col("user_id") % 10 == 7, "Atomic").otherwise("Standard"), F.lit('"]\n\n'), F.when(F.col("user_id") % 3 == 0, "{ a  first\nnote }").otherwise(""))
    tail = F.when(F.col("part") % 2 == 0, " ) 1-0").otherwise(" 0-1 ( Ka8")
    return played.select("user_id", "part", F.concat(head, "moves", tail).alias("text"))


@query(NODES)
def annotated_nodes(spark, sf_dir):
    """The commented moves of games, with those of nested variations."""
    nodes = movetext.annotated_nodes(annotated_games(spark, sf_dir).withColumn("key", F.struct("user_id", "part")), "key", "text")
    return nodes.select("key.user_id", "key.part", "ply", "depth", "variation", "move", "comment_text", "comment_source", F.array_join(F.transform("nags", lambda n: n.cast("string")), ",").alias("nags"))


@query(f"""WITH n AS ({NODES.replace('WITH ', 'WITH ', 1)}), g AS (SELECT user_id, event_id // 64 AS part FROM events GROUP BY 1, 2),
t AS (SELECT user_id, part, CASE WHEN part % 13 = 5 THEN 'missing_text' WHEN user_id % 10 = 7 THEN 'non_standard_variant' WHEN NOT EXISTS (SELECT 1 FROM n WHERE n.user_id = g.user_id AND n.part = g.part AND depth = 0) THEN 'no_comment_annotations' ELSE 'kept' END AS outcome FROM g)
SELECT outcome, count(*) AS games, sum(CASE WHEN outcome = 'kept' THEN (SELECT count(*) FROM n WHERE n.user_id = t.user_id AND n.part = t.part AND depth = 0) ELSE 0 END)::BIGINT AS rows FROM t GROUP BY 1""")
def annotated_sidecar(spark, sf_dir):
    """Games in JSON lines of sharded files: rows of the main line, and why games gave none."""
    root = fresh(spark, "games")
    games = annotated_games(spark, sf_dir)
    line = F.to_json(F.struct(F.concat_ws(":", "user_id", "part").alias("pipeline_key"), F.when(F.col("part") % 13 == 5, "  ").otherwise(F.col("text")).alias("text")))
    games.select(line.alias("value")).write.text(f"{root}/written")
    sinks.name_shards(spark, f"{root}/written", f"{root}/games", "games.jsonl-{:05d}")
    rows, ledger = builders.annotated_sidecar(readers.read_sharded_json(spark, root, "pipeline_key string, text string"))
    kept = rows.agg(F.lit("kept").alias("outcome"), F.count_distinct("game_id", "source_row_id").alias("games"), F.count("*").alias("rows"))
    return kept.union(ledger.groupBy("drop_reason").agg(F.count("*"), F.lit(0).cast("long"))).where("games > 0")
