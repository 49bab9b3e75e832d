"""Queries that exercise rules which no row of the test tables does, and round trips of readers and writers.

Remarks, headers and tags of a written-out list are dealt to the rows of a table by key and joined to what the row
holds, so that every rule has rows to work on and the work grows with the table. Where both engines can apply a rule,
both read the same rows; else the SQL deals out the answers that the rules of the survey ask for.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from strandmill.functions import scoring, text as t
from strandmill.operators import audits, boards, builders, dedup, sidecars
from strandmill.plans.curation import AUDIT, SPLIT, T, documents, flags_sql, style_sql
from strandmill.plans.registry import Registry, table
from strandmill.sources import readers, sinks
from strandmill.sources.shared import fresh

REGISTRY = Registry()
query = REGISTRY.query


def literal(x) -> str:
    return "NULL" if x is None else str(x).lower() if isinstance(x, bool) else str(x) if isinstance(x, (int, float)) else "'" + x.replace("'", "''") + "'"


def dealt_out(key: str, values: list, kind: str = "string") -> Column:
    """One of ``values`` by the row's key."""
    return F.get(F.array(*[F.lit(v).cast(kind) for v in values]), F.pmod(F.col(key), F.lit(len(values))).cast("int"))


def dealt_sql(key: str, values: list) -> str:
    return f"([{', '.join(map(literal, values))}][({key} % {len(values)} + 1)::INT])"


LONG = "The rook defends the pawn because the king attacks the bishop on e5 and the queen threatens mate with a fork"
#: Markup, results, symbols, engine phrases, repeated short and dull templates; the same text is SQL of both engines.
SPLICED = f"""CASE doc_id % 20
  WHEN 0 THEN '[%eval 0.3]' WHEN 1 THEN '[%clk 0:01:02] ok' WHEN 2 THEN '1-0' WHEN 3 THEN '!?' WHEN 4 THEN 'Inaccuracy. Nf3 was best.' WHEN 5 THEN 'Forced.'
  WHEN 6 THEN concat('[%eval 0.3][%clk 0:00:01] ', text) WHEN 7 THEN NULL WHEN 8 THEN '   ' WHEN 9 THEN 'Good move!'
  WHEN 10 THEN CASE WHEN doc_id % 40 = 10 THEN 'again again again again again again, onwards' ELSE 'Again, again again again again AGAIN onwards' END
  WHEN 11 THEN 'so so so so so so extraordinarily' WHEN 12 THEN concat('{LONG} number ', CAST(doc_id AS STRING)) WHEN 13 THEN concat('1 2 3 4 ', CAST(doc_id AS STRING))
  WHEN 14 THEN concat('some words of note ', CAST(doc_id AS STRING)) WHEN 15 THEN concat(text, ' {{[%eval 1.0]}} 1/2-1/2 $3') ELSE text END"""
CASES = f"(SELECT doc_id AS id, {SPLIT} AS split, CASE WHEN doc_id % 20 < 6 THEN 'engine' WHEN doc_id % 20 < 12 THEN 'repeats' WHEN doc_id % 20 = 13 THEN 'numbers' ELSE source END AS source, {SPLICED} AS text FROM documents)"


def cases(spark, sf_dir):
    """Documents with remarks in place of, or beside, their texts."""
    number = F.col("doc_id") % 20
    source = F.when(number < 6, "engine").when(number < 12, "repeats").when(number == 13, "numbers").otherwise(F.col("source"))
    return documents(spark, sf_dir).select(F.col("doc_id").alias("id"), "split", source.alias("source"), F.expr(SPLICED).alias("text"))


FLAGGED = flags_sql(CASES, "id", "split, source")


@query(f"WITH {FLAGGED} SELECT id::BIGINT AS id, template_count, categories FROM f")
def case_flags(spark, sf_dir):
    flagged = audits.boilerplate_flags(cases(spark, sf_dir), "text", ["id"])
    return flagged.select("id", "template_count", F.array_join("categories", ",").alias("categories"))


@query(f"WITH {FLAGGED} {AUDIT.format(by='source')}")
def case_category_audit(spark, sf_dir):
    return audits.category_audit(audits.boilerplate_flags(cases(spark, sf_dir), "text", ["source"]), "source")


def variants_sql() -> str:
    """Kept rows and drop reasons of the four variants of a clean table ``f``."""
    parts = []
    for name, (drops, cap) in audits.VARIANTS.items():
        wanted = ", ".join(f"'{d}'" for d in drops)
        group = {None: "id", "source": "split, source, own", "template": "split, own"}[cap]
        most = 3 if cap else 1 << 30
        parts.append(f"""SELECT '{name}' AS variant, coalesce(reason, CASE WHEN row_number() OVER (PARTITION BY reason IS NULL, {group} ORDER BY id) <= {most} THEN 'kept' ELSE 'template_cap' END) AS outcome
FROM (SELECT *, coalesce('boilerplate:' || list_filter(string_split(categories, ','), lambda x: x IN ({wanted}))[1], CASE WHEN plain_text = '' THEN 'empty_after_cleanup' END) AS reason,
  CASE WHEN {T.normalize('plain_text', 'punct_light')} = '' THEN 'own:' || id ELSE {T.normalize('plain_text', 'punct_light')} END AS own FROM f)""")
    return f"SELECT variant, outcome, count(*) AS n FROM ({' UNION ALL '.join(parts)}) GROUP BY 1, 2"


@query(f"WITH {FLAGGED} {variants_sql()}")
def case_clean_variants(spark, sf_dir):
    """Every drop reason and both caps."""
    return audits.variant_counts(audits.clean_variants(cases(spark, sf_dir), "text", "id", "split", "source"))


@query(f"WITH {flags_sql('(SELECT doc_id AS id, source, lang AS split, text FROM documents)', 'id', 'split, source')} {variants_sql()}")
def clean_variants(spark, sf_dir):
    """The four variants of a clean table of documents; languages stand in for splits."""
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "source", F.col("lang").alias("split"), "text")
    return audits.variant_counts(audits.clean_variants(rows, "text", "id", "split", "source"))


@query(style_sql(CASES, "id", "source"))
def case_style_audit(spark, sf_dir):
    """Groups of several styles."""
    return audits.style_audit(cases(spark, sf_dir), "source", "text").withColumn("divergence", F.round("divergence", 4))


@query(f"""WITH k AS (SELECT id, split, {T.normalize('text', 'punct_light')} AS light FROM {CASES}), s AS (SELECT light, count(*) AS size, least(count(*), 3) AS kept FROM k WHERE light <> '' GROUP BY 1)
SELECT size, count(*) AS clusters, sum(kept)::BIGINT AS kept FROM s GROUP BY 1""")
def case_dedup_cap(spark, sf_dir):
    """Clusters larger than the cap."""
    rows = cases(spark, sf_dir).select("id", dedup.digest(t.normalize("text", "punct_light")).alias("key")).where("key is not null")
    kept = dedup.dedup(rows, F.col("key"), [], "id", 3, "case").groupBy("cluster_id").agg(F.first("cluster_size").alias("size"), F.count("*").alias("kept"))
    return kept.groupBy("size").agg(F.count("*").alias("clusters"), F.sum("kept").alias("kept"))


REMARKS = [
    "White gives check and threatens mate!", "A fork of king and queen", "The knight is pinned", "a skewer, then a discovered attack", "discovered check wins", "King safety first: near the opposing king",
    "the passed pawn on the open file", "queen the pawn by promotion", "He captures, then comes the recapture", "nothing here", None, "Checkmate", "exchange on the open diagonal, defend well",
]
LABELS = ["check,mate_threat", "fork", "pin", "skewer,discovered_attack", "check,discovered_check", "king_safety", "passed_pawn,open_file", "promotion", "capture,recapture", "", "", "mate_threat", ""]
MOTIFS = ["checkmate_pattern,check", "", "", "", "check", "", "line_opening", "", "", "", "", "checkmate_pattern,check", "exchange,line_opening"]
THREATS = ["mate_threat,forcing_check", "king_pressure", "", "", "forcing_check", "king_pressure", "", "", "", "", "", "mate_threat,forcing_check", ""]
DEFENCES = ["", "", "", "", "", "", "", "", "", "", "", "", "defensive_response"]


def remarks(spark, sf_dir):
    """Turns of conversations with a remark and their own number."""
    rows = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 100 + F.col("turn")).alias("id"))
    return rows.select("id", F.concat(dealt_out("id", REMARKS), F.lit(" ("), F.col("id").cast("string"), F.lit(")")).alias("text"))


REMARKED = "(SELECT conv_id * 100 + turn AS id FROM conversations)"


@query(f"SELECT id, {dealt_sql('id', LABELS)} AS labels FROM {REMARKED}")
def case_keyword_labels(spark, sf_dir):
    return remarks(spark, sf_dir).select("id", F.array_join(scoring.keyword_labels("text"), ",").alias("labels"))


LABELLED = f"l AS (SELECT id, {dealt_sql('id', LABELS)} AS labels FROM {REMARKED}), bound AS (SELECT count(*) // 10 AS least FROM l), c AS (SELECT label, count(*) AS n FROM (SELECT unnest(string_split(labels, ',')) AS label FROM l) WHERE label <> '' GROUP BY 1)"


def targets(spark, sf_dir):
    """Labels that are rarer than a tenth of the rows are dropped."""
    rows = remarks(spark, sf_dir)
    return builders.probe_targets(rows, "text", scoring.KEYWORD_LABELS, rows.count() // 10)


@query(f"WITH {LABELLED} SELECT label, n, n < least AS rare FROM c, bound")
def case_label_frequency(spark, sf_dir):
    return targets(spark, sf_dir)[1]


@query(f"WITH {LABELLED}, k AS (SELECT list(label) AS often FROM c, bound WHERE n >= least) SELECT id, array_to_string(list_filter(string_split(labels, ','), lambda x: list_contains(often, x)), ',') AS labels FROM l, k")
def case_rare_labels(spark, sf_dir):
    return targets(spark, sf_dir)[0].select("id", F.array_join("target_labels", ",").alias("labels"))


@query(f"SELECT id, {dealt_sql('id', MOTIFS)} AS motifs, {dealt_sql('id', THREATS)} AS threats, {dealt_sql('id', DEFENCES)} AS defences FROM {REMARKED}")
def case_text_tags(spark, sf_dir):
    tags = lambda names: F.array_join(scoring.keyword_labels("text", names), ",")
    return remarks(spark, sf_dir).select("id", tags(scoring.MOTIFS).alias("motifs"), tags(scoring.THREATS).alias("threats"), tags(scoring.DEFENCES).alias("defences"))


THEMES = ["Under-Promotion", "mateIn2|fork", "castling", "en_passant", "", None]
THEMED = [("promotion_related", 0), ("check_related", 1), ("castling_related", 2), ("en_passant_related", 3)]


@query(f"SELECT p_partkey, {', '.join(f'p_partkey % 6 = {i} AS theme_{name}' for name, i in THEMED)} FROM part")
def case_theme_flags(spark, sf_dir):
    """Theme tags beside the words of a part's name."""
    rows = table(spark, sf_dir, "part").select("p_partkey", F.split(F.concat_ws("|", dealt_out("p_partkey", THEMES), F.replace("p_name", F.lit(" "), F.lit("|"))), r"\|").alias("tags"))
    return rows.select("p_partkey", *scoring.theme_groups(F.col("tags")))


MARKED = [("[%eval 0.3] x", "eval", 11, "x"), ("a [%CLK 1][%emt 2]", "clk,emt", 16, "a"), ("[not markup]", "", 0, "[not markup]"), ("", "", 0, "")]


@query(f"""SELECT p_partkey, {dealt_sql('p_partkey', [m[1] for m in MARKED])} AS tags, {dealt_sql('p_partkey', [m[2] for m in MARKED])}::BIGINT AS markup,
  trim({dealt_sql('p_partkey', [m[3] for m in MARKED])} || ' ' || p_name) AS plain FROM part""")
def case_markup(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select("p_partkey", F.concat(dealt_out("p_partkey", [m[0] for m in MARKED]), F.lit(" "), F.col("p_name")).alias("text"))
    return rows.select("p_partkey", F.array_join(t.markup_tags(t.text_of("text")), ",").alias("tags"), t.markup_characters(t.text_of("text")).cast("long").alias("markup"), t.strip_markup("text").alias("plain"))


#: variant, rated, event, plies, and the answers: reason, whether it is an annotated standard game.
GAMES = [("Standard", "yes", "x", 40, "kept", True), (None, None, "Rated Blitz", 40, "kept", True), (" From Position ", "1", "", 40, "kept", False), ("CHESS", "true", "", 2, "too_short_game", False),
         ("Atomic", "1", "", 40, "non_standard_variant", False), ("", "no", "casual", 40, "unrated_game", True), ("standard", "1", "", 400, "too_long_game", False)]


@query(f"""SELECT reason, annotated, count(*) AS n, sum(o_orderkey)::BIGINT AS ids FROM (SELECT o_orderkey, {dealt_sql('o_orderkey', [g[4] for g in GAMES])} AS reason, {dealt_sql('o_orderkey', [g[5] for g in GAMES])} AS annotated FROM orders) GROUP BY 1, 2""")
def case_game_rules(spark, sf_dir):
    """The plain rule of variants knows four values in any case, that of annotated games two as they are written; orders stand for games."""
    column = lambda i, kind="string": dealt_out("o_orderkey", [g[i] for g in GAMES], kind)
    rows = table(spark, sf_dir, "orders").select("o_orderkey", column(0).alias("variant"), column(1).alias("rated"), column(2).alias("event"), column(3, "int").alias("plies"))
    reason = sidecars.game_reasons(F.col("variant"), sidecars.rated_game(F.col("rated"), F.col("event")), F.col("plies"), 4, 300)
    marked = rows.select("o_orderkey", F.coalesce(reason, F.lit("kept")).alias("reason"), sidecars.standard_annotated_game(F.col("variant")).alias("annotated"))
    return marked.groupBy("reason", "annotated").agg(F.count("*").alias("n"), F.sum("o_orderkey").alias("ids"))


#: given, source, site, event, annotator, file, and the family.
FAMILIES = [
    ("My Own!", "s", None, None, None, None, "my_own"), (None, "waterhorse_annotated_pgn_1", "https://www.chess.example/1", None, None, None, "chess.example"), (None, "waterhorse_annotated_pgn", "?", "My Open 2020", None, "f.pgn", "waterhorse::my_open_2020"),
    (None, "waterhorse_annotated_pgn", None, "?", None, None, "waterhorse::unknown"), (None, "s", "https://x.org", None, None, "a/b/Games 1.jsonl", "games_1"), ("", "mate_dataset_Tactic", None, None, None, "f.zip", "mate_dataset_tactic"),
    ("", "s", None, None, None, "", "s"), (None, None, None, None, None, None, "unknown"), (None, "waterhorse_annotated_pgn", "Paris FRA", None, "notes.example.net", None, "notes.example.net"),
]
#: An address of the page stands in for the site of every tenth row.
HOST = r"regexp_replace(regexp_extract(lower(trim(url)), '^[a-z][a-z0-9+.-]*://([^/?#]*)', 1), '^www\.', '')"


@query(f"SELECT page_id, CASE WHEN page_id % 10 = 9 AND url LIKE '%://%.%' THEN {HOST} ELSE {dealt_sql('page_id', [f[6] for f in FAMILIES])} END AS family FROM pages WHERE NOT (page_id % 10 = 9 AND NOT url LIKE '%://%.%')")
def case_source_families(spark, sf_dir):
    column = lambda i: dealt_out("page_id", [f[i] for f in FAMILIES])
    given, site = F.col("page_id") % 10 == 9, F.col("url").like("%://%.%")
    pages = table(spark, sf_dir, "pages").where(~(given & ~site))
    rows = pages.select("page_id", *[column(i).alias(c) for i, c in enumerate(("given", "source", "site", "event", "annotator", "file"))], given.alias("_own"), "url")
    rows = rows.withColumns({"given": F.when(~F.col("_own"), F.col("given")), "source": F.when(F.col("_own"), "waterhorse_annotated_pgn").otherwise(F.col("source")), "site": F.when(F.col("_own"), F.col("url")).otherwise(F.col("site"))})
    return rows.select("page_id", sidecars.source_family("given", "source", "site", "event", "annotator", "file").alias("family"))


@query("SELECT pool, count(*) AS n, min(size) AS least, max(size) AS most FROM (SELECT size, CASE WHEN size < 200 THEN 'exploratory_only' WHEN size < 500 THEN 'secondary_shared' WHEN size < 1000 THEN 'primary_shared' ELSE 'strong_primary' END AS pool FROM (SELECT o_orderkey % 1201 AS size FROM orders)) GROUP BY 1")
def case_pool_classes(spark, sf_dir):
    sizes = table(spark, sf_dir, "orders").select((F.col("o_orderkey") % 1201).alias("size"))
    return sizes.groupBy(scoring.pool_class(F.col("size")).alias("pool")).agg(F.count("*").alias("n"), F.min("size").alias("least"), F.max("size").alias("most"))


SQUARES = "(SELECT o_orderkey, o_orderkey % 64 AS a, (o_custkey * 7 + o_orderkey // 64) % 64 AS b, o_orderkey % 5 AS p FROM orders)"


def squares(spark, sf_dir):
    """Two squares and a promotion of each order."""
    b = F.pmod(F.col("o_custkey") * 7 + F.floor(F.col("o_orderkey") / 64), F.lit(64))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.pmod("o_orderkey", F.lit(64)).alias("a"), b.alias("b"), F.pmod("o_orderkey", F.lit(5)).cast("int").alias("p"))


@query(f"""SELECT relation, count(*) AS n, sum(o_orderkey)::BIGINT AS ids FROM (SELECT o_orderkey, CASE WHEN dr = 0 AND dc = 0 THEN 0 WHEN dr = 0 THEN 1 WHEN dc = 0 THEN 2 WHEN dr = dc THEN 3 WHEN least(dr, dc) = 1 AND greatest(dr, dc) = 2 THEN 4 ELSE 0 END AS relation
FROM (SELECT o_orderkey, abs(a // 8 - b // 8) AS dr, abs(a % 8 - b % 8) AS dc FROM {SQUARES})) GROUP BY 1""")
def case_square_relations(spark, sf_dir):
    known = boards.square_relations(spark).select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"), "relation")
    return squares(spark, sf_dir).join(F.broadcast(known), ["a", "b"]).groupBy("relation").agg(F.count("*").alias("n"), F.sum("o_orderkey").alias("ids"))


@query("""SELECT a, b, relation, count(*) AS n FROM (SELECT a, b, CASE WHEN dr = 0 AND dc = 0 THEN 0 WHEN dr = 0 THEN 1 WHEN dc = 0 THEN 2 WHEN dr = dc THEN 3 WHEN least(dr, dc) = 1 AND greatest(dr, dc) = 2 THEN 4 ELSE 0 END AS relation
FROM (SELECT a, b, abs(a // 8 - b // 8) AS dr, abs(a % 8 - b % 8) AS dc FROM (SELECT l_orderkey % 64 AS a, l_partkey % 64 AS b FROM lineitem))) GROUP BY 1, 2, 3""")
def square_relations(spark, sf_dir):
    """How often each pair of squares occurs among order and part of the lines, with its relation."""
    pairs = table(spark, sf_dir, "lineitem").groupBy(F.pmod("l_orderkey", F.lit(64)).alias("a"), F.pmod("l_partkey", F.lit(64)).alias("b")).agg(F.count("*").alias("n"))
    known = boards.square_relations(spark).select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"), "relation")
    return pairs.join(F.broadcast(known), ["a", "b"])


@query(f"SELECT o_orderkey, chr((97 + a % 8)::INT) || (a // 8 + 1) || chr((97 + b % 8)::INT) || (b // 8 + 1) || ['', 'n', 'b', 'r', 'q'][(p + 1)::INT] AS move, a AS src, b AS dst, p AS promotion FROM {SQUARES}")
def move_codec(spark, sf_dir):
    """Moves written and read again."""
    moves = squares(spark, sf_dir).select("o_orderkey", boards.encode_move(F.col("a"), F.col("b"), F.col("p")).alias("move"))
    return moves.select("o_orderkey", "move", boards.move_parts(F.col("move")).alias("m")).select("o_orderkey", "move", *[F.col(f"m.{c}").cast("long").alias(c) for c in ("src", "dst", "promotion")])


#: segment, moves, other moves, tags, other tags, and the answers.
RULES = [(" ,, a plan  in the center", "e2e4 d2d4", "d2d4 e2e4", "b a", "c b", "a plan in the center", True, "a,b,c"), (",TacticB: e2e4", "e2e4", "d2d4", "a", None, "Tactic: e2e4", False, "a"), (None, None, None, None, None, "", True, "")]


@query(f"SELECT c_custkey, trim({dealt_sql('c_custkey', [r[5] for r in RULES])} || ' ' || lower(c_mktsegment)) AS segment, {dealt_sql('c_custkey', [r[6] for r in RULES])} AS same, {dealt_sql('c_custkey', [r[7] for r in RULES])} AS tags FROM customer")
def case_small_rules(spark, sf_dir):
    """Segments of prompts, equal move lists, united tags."""
    column = lambda i: dealt_out("c_custkey", [r[i] for r in RULES])
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.concat_ws(" ", column(0), F.lower("c_mktsegment")).alias("s"), *[F.split(column(i), " ").alias(c) for i, c in ((1, "m"), (2, "n"), (3, "x"), (4, "y"))])
    return rows.select("c_custkey", builders.clean_segment("s").alias("segment"), builders.same_moves("m", "n").alias("same"), F.array_join(builders.tag_union("x", "y"), ",").alias("tags"))


# round trips of readers and writers


def nations(spark, sf_dir):
    return table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("n_nationkey"), "n_name", F.when(F.col("n_nationkey") % 3 != 0, F.col("n_regionkey").cast("long")).alias("region"))


NATIONS = "SELECT n_nationkey::BIGINT AS n_nationkey, n_name, CASE WHEN n_nationkey % 3 <> 0 THEN n_regionkey::BIGINT END AS region FROM nation"
SHAPE = "n_nationkey long, n_name string, region long"


@query(NATIONS)
def roundtrip_jsonl(spark, sf_dir):
    path = fresh(spark, "jsonl")
    sinks.write_jsonl(nations(spark, sf_dir), path)
    return readers.read_rows(spark, path, SHAPE)


@query("SELECT n_nationkey::VARCHAR AS n_nationkey, n_name || ', \"x\"' AS n_name FROM nation")
def roundtrip_csv(spark, sf_dir):
    path = fresh(spark, "csv") + ".csv"
    sinks.write_csv(nations(spark, sf_dir).select("n_nationkey", F.concat("n_name", F.lit(', "x"')).alias("n_name")), path)
    return readers.read_rows(spark, path, SHAPE)


@query(NATIONS)
def roundtrip_json_document(spark, sf_dir):
    path = fresh(spark, "document") + ".json"
    few = nations(spark, sf_dir)  # a document is one value, so only small tables are written as one
    few.agg(F.to_json(F.struct(F.collect_list(F.struct(*few.columns)).alias("records"))).alias("value")).write.text(path)
    return readers.read_rows(spark, path, SHAPE)


@query(NATIONS)
def roundtrip_compressed(spark, sf_dir):
    path = fresh(spark, "compressed")
    nations(spark, sf_dir).write.option("compression", "bzip2").json(path)
    return readers.read_rows(spark, path, SHAPE)


DEALT = "SELECT o_orderkey::BIGINT AS id, CASE o_orderstatus WHEN 'F' THEN 'train' WHEN 'O' THEN 'val' ELSE 'test' END AS split FROM orders"


def dealt(spark, sf_dir):
    split = F.when(F.col("o_orderstatus") == "F", "train").when(F.col("o_orderstatus") == "O", "val").otherwise("test")
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("long").alias("id"), split.alias("split"))


@query(DEALT)
def roundtrip_split_set(spark, sf_dir):
    root, rows = fresh(spark, "splits"), dealt(spark, sf_dir)
    for name in readers.SPLITS:
        sinks.write_jsonl(rows.where(F.col("split") == name).select("id"), f"{root}/{name}.jsonl")
    return readers.read_split_set(spark, root, "id long").select("id", "split")


@query(f"SELECT split, count(*) AS n, sum(id)::BIGINT AS ids FROM ({DEALT}) WHERE id % 3 = 0 GROUP BY 1")
def roundtrip_variants(spark, sf_dir):
    """The primary variant of a tree, from its own copy."""
    root, rows = fresh(spark, "variants"), dealt(spark, sf_dir)
    sinks.write_variants({"all": rows, "third": rows.where("id % 3 = 0")}, rows.where("id % 3 <> 0").select("id"), root, "third")
    return spark.read.schema("id long, split string").json(f"{root}/primary").groupBy("split").agg(F.count("*").alias("n"), F.sum("id").alias("ids"))


@query("SELECT n_regionkey::BIGINT AS region, count(*) AS files FROM nation GROUP BY 1")
def roundtrip_found_files(spark, sf_dir):
    """Files found below a root, one a nation, in folders by region."""
    root = fresh(spark, "files")
    rows = table(spark, sf_dir, "nation").select(F.col("n_regionkey").alias("region"), F.col("n_nationkey").alias("k"), "n_name")
    rows.repartition("region", "k").write.option("maxRecordsPerFile", 1).partitionBy("region").json(root)
    found = readers.find_files(spark, root, "*.json")
    return found.groupBy(F.regexp_extract("path", r"region=(\d+)", 1).cast("long").alias("region")).agg(F.count("*").alias("files"))


@query("SELECT 'run' || n_regionkey AS experiment, n_nationkey % 2 AS seed, sum(n_nationkey)::DOUBLE AS loss FROM nation GROUP BY 1, 2")
def roundtrip_summaries(spark, sf_dir):
    """Summaries found in the folders of runs and seeds: one of each region and parity of nations."""
    root = fresh(spark, "summaries")
    for run in table(spark, sf_dir, "nation").groupBy("n_regionkey", (F.col("n_nationkey") % 2).alias("seed")).agg(F.sum("n_nationkey").alias("loss")).collect():  # ten rows
        sinks.write_file(spark, f'{{"loss": {float(run["loss"])}}}', f"{root}/run{run['n_regionkey']}_seed{run['seed']}/summary.json")
    return readers.read_summaries(spark, root).select("experiment", F.col("seed").cast("long").alias("seed"), "loss")
