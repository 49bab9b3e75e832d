"""Sidecar tables composed of the single operators: enriched positions, capped and balanced unions, shared holdouts,
chat corpora, targets, rationales and the gates of a pilot table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandmill.functions import scoring, text as t
from strandmill.functions.hashing import rank_key, split_of
from strandmill.operators import alignment, audits, movetext, sidecars
from strandmill.operators.boards import position_key
from strandmill.operators.ranking import first_n
from strandmill.operators.stats import named, rounded
from strandmill.sources.shared import written

# Source names and their types.
ARCHIVE, DATASETS = "waterhorse_annotated_pgn", "mate_"
SPLITS = ("train", "val", "test")


def source_type(source) -> Column:
    name = t.text_of(source)
    return F.when(name == ARCHIVE, "waterhorse_only").when(name.startswith(DATASETS), "mate_only").otherwise("other")


def of_source_type(rows: DataFrame, source: str, wanted: str) -> DataFrame:
    """Rows of one source type in every split; ``mixed`` leaves all."""
    return rows if wanted == "mixed" else rows.where(source_type(source) == wanted)


def enriched(base: DataFrame, evaluations: DataFrame, fen: str = "fen") -> DataFrame:
    """``base`` with ``engine_depth``, ``engine_cp``, ``engine_mate``, ``engine_best`` of the deepest evaluation of its position.

    Of equally deep evaluations the first counts; rows without a position or an evaluation keep nulls.
    """
    flat = sidecars.flat_evaluations(evaluations).withColumn("_o", F.monotonically_increasing_id())
    deep = flat.withColumn("_d", F.coalesce("depth", F.lit(-1)))
    keyed = base.withColumn("position", position_key(fen))
    found = alignment.enrich(keyed, written(deep, "evaluations"), "position", ["_d"], "_o", ["depth", "cp", "mate", "best_move"])
    return found.withColumnsRenamed({"depth": "engine_depth", "cp": "engine_cp", "mate": "engine_mate", "best_move": "engine_best"})


def by_split(values: dict[str, int], split: str = "split") -> Column:
    return F.coalesce(*[F.when(F.col(split) == s, n) for s, n in values.items()], F.lit(0))


def capped(rows: DataFrame, by: str, caps: dict[str, int], identity: str, salt: str, least: dict[str, int] | None = None) -> DataFrame:
    """At most a split's cap of rows of each group, the first by salted digest; a cap of zero or less leaves all.

    A cap never leaves fewer than the split's ``least`` of those there are.
    """
    most = {s: max(n, (least or {}).get(s, 0)) for s, n in caps.items() if n > 0}
    if not most:
        return rows
    order = [rank_key(salt, identity), F.col(identity)]
    cut = first_n(rows.where(F.coalesce(F.col("split").isin(*most), F.lit(False))).withColumn("_by", named(by)), ["split", "_by"], order, max(most.values()), "_place")
    free = rows.where(~F.coalesce(F.col("split").isin(*most), F.lit(False)))
    return cut.where(F.col("_place") <= by_split(most)).select(*rows.columns).union(free)


def multisource(annotated: DataFrame, prompts: DataFrame, caps: dict[str, int], least: dict[str, int], salt: str) -> DataFrame:
    """``(id, split, source, source_family, semantics, text)``: annotated rows, which keep their split, and rows of prompts,
    which get one by their game, capped by split and family."""
    shape = ["id", "split", "source", "source_family", "semantics", "text"]
    first = annotated.withColumn("semantics", F.lit("annotated_pgn_comment")).select(*shape)
    second = prompts.withColumns({"split": split_of("game"), "semantics": F.lit("pairwise_explanation")}).select(*shape)
    return capped(first.union(second), "source_family", caps, "id", salt, least)


def family_report(rows: DataFrame, family: str = "source_family") -> DataFrame:
    """One row: rows, families, the largest one's share, and whether it has half of the rows."""
    sizes = rows.groupBy(named(family).alias("_f")).agg(F.count("*").alias("_n"))
    share_ = F.coalesce(F.max("_n") / F.sum("_n"), F.lit(0.0))
    return sizes.agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("n"), F.count("*").alias("families"), F.round(share_, 6).alias("largest_share"), (share_ >= 0.5).alias("single_family_dominant"))


def balanced(rows: DataFrame, family_caps: dict[str, int], type_caps: dict[str, int], salt: str) -> dict[str, DataFrame]:
    """Three variants of a union: capped by family, capped by source type, and by family with markup stripped."""
    plain = {"normalized_text": F.col("text"), "normalization_applied": F.lit(False)}
    stripped = t.strip_markup(F.col("text"))
    normal = {"normalized_text": stripped, "normalization_applied": stripped != t.text_of("text"), "text": F.when(stripped != "", stripped).otherwise(F.col("text"))}
    family = lambda name: capped(rows, "source_family", family_caps, "id", f"{salt}:{name}")
    typed = rows.withColumn("_type", source_type("source"))
    return {
        "family_balanced": family("family_balanced").withColumns(plain),
        "source_type_balanced": capped(typed, "_type", type_caps, "id", f"{salt}:source_type_balanced").drop("_type").withColumns(plain),
        "family_balanced_plus_style_normalized": family("family_balanced_plus_style_normalized").withColumns(normal),
    }


def regime_metadata(rows: DataFrame, fields: list[str]) -> DataFrame:
    """``(field, value, n, share)``: the rows of each value of each field."""
    total = rows.agg(F.count("*").alias("_all"))  # one row
    pairs = rows.select(F.explode(F.array(*[F.struct(F.lit(f).alias("field"), named(f).alias("value")) for f in fields])).alias("p")).select("p.*")
    counts = pairs.groupBy("field", "value").agg(F.count("*").alias("n"))
    return counts.join(F.broadcast(total)).select("field", "value", "n", F.round(F.col("n") / F.col("_all"), 6).alias("share"))


def shared_holdouts(variants: dict[str, DataFrame], fields: dict[str, str], thresholds: scoring.Thresholds, least: int = 100) -> tuple[DataFrame, DataFrame]:
    """Regimes of every variant and the test rows they share.

    ``fields`` maps a category to its column; ``mixed_baseline`` holds nothing out. A regime is known by the null-safe
    triple (category, field, value). The first result has a row for each regime that is eligible in all variants, with
    its shared test rows and the reason for leaving it out if these are fewer than ``least``; the second the shared ids
    ``(category, field, value, id)`` of those that stay.
    """
    triple = ["category", "field", "value"]
    keys = lambda df: df.select(F.explode(F.array(
        F.struct(F.lit("mixed_baseline").alias("category"), F.lit(None).cast("string").alias("field"), F.lit(None).cast("string").alias("value")),
        *[F.struct(F.lit(c).alias("category"), F.lit(f).alias("field"), named(f).alias("value")) for c, f in fields.items()])).alias("k"), "id", "split").select("k.*", "id", "split")
    every = reduce(DataFrame.union, [keys(v).withColumn("variant", F.lit(name)) for name, v in variants.items()])
    counted = every.groupBy("variant", *triple).agg(F.count("*").alias("total"), *[F.count_if(F.col("split") == s).alias(s) for s in SPLITS])
    fits = F.col("field").isNull() | scoring.eligibility(thresholds).isNull()
    common = counted.where(fits).groupBy(*triple).agg(F.count("*").alias("_v")).where(F.col("_v") == len(variants)).drop("_v")
    same = reduce(lambda a, c: a & F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")), triple, F.lit(True))
    tested = every.where("split = 'test'").select(*triple, "id", "variant").distinct().groupBy(*triple, "id").agg(F.count("*").alias("_v")).where(F.col("_v") == len(variants)).drop("_v")
    shared = written(tested.alias("a").join(common.alias("b"), same, "left_semi"), "shared-tests")
    sizes = shared.groupBy(*triple).agg(F.count("*").alias("n"))
    regimes = common.alias("a").join(sizes.alias("b"), same, "left").select(*[F.col(f"a.{c}").alias(c) for c in triple], F.coalesce("b.n", F.lit(0)).alias("shared_test_rows"))
    regimes = regimes.withColumn("reason", F.when(F.col("shared_test_rows") < least, f"shared_test_rows<{least}"))
    kept = regimes.where("reason is null")
    return regimes, shared.alias("a").join(kept.alias("b"), same, "left_semi").select(*triple, "id")


# Fields under which chat and text rows come, the first that is there counts.
MESSAGES, ROLES, CONTENTS = ("messages", "conversations", "dialogue"), ("role", "author", "from"), ("content", "text", "value")
PROMPTS, RESPONSES, TEXTS = ("prompt", "instruction", "input", "question", "title"), ("response", "output", "answer"), ("text", "content", "body")


def chat_corpus(lines: DataFrame, value: str, key: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Conversations ``(key, messages)``, texts ``(key, prompt, response, text)`` and a ledger ``(key, drop_reason)`` of JSON lines.

    A row with a list under one of ``MESSAGES`` is a conversation; the first of them with messages counts. A
    conversation without messages, and a text row without any text field, are dropped.
    """
    message = "array<struct<" + ",".join(f"`{f}`:string" for f in dict.fromkeys([*ROLES, *CONTENTS])) + ">>"
    plain = ",".join(f"`{f}` string" for f in dict.fromkeys([*PROMPTS, *RESPONSES, *TEXTS]))
    read = lines.select(key, *[F.from_json(value, f"`{m}` {message}")[m].alias(f"_{m}") for m in MESSAGES], F.from_json(value, plain).alias("_t"))
    first = lambda x, fields: F.coalesce(*[F.nullif(x[f], F.lit("")) for f in fields])

    def messages(column: str) -> Column:
        made = F.transform(column, lambda x: F.struct(t.chat_role(F.coalesce(first(x, ROLES), F.lit("unknown"))).alias("role"), t.strip(F.coalesce(first(x, CONTENTS), F.lit(""))).alias("content")))
        kept = F.filter(made, lambda x: x["content"] != "")
        return F.when(F.size(kept) > 0, kept)

    is_chat = F.coalesce(*[F.when(F.col(f"_{m}").isNotNull(), True) for m in MESSAGES], F.lit(False))
    marked = read.select(key, is_chat.alias("_chat"), F.coalesce(*[messages(f"_{m}") for m in MESSAGES]).alias("messages"),
                         *[first(F.col("_t"), f).alias(n) for n, f in (("prompt", PROMPTS), ("response", RESPONSES), ("text", TEXTS))])
    marked = marked.withColumn("drop_reason", F.when(F.col("_chat") & F.col("messages").isNull(), "no_messages").when(~F.col("_chat") & F.coalesce("prompt", "response", "text").isNull(), "no_text"))
    kept = marked.where("drop_reason is null")
    return kept.where("_chat").select(key, "messages"), kept.where("not _chat").select(key, "prompt", "response", "text"), marked.where("drop_reason is not null").select(key, "drop_reason")


def clean_segment(column, variant: str = "strategy") -> Column:
    """A part of a prompt without leading commas, its label without the option's letter, white space collapsed."""
    value = t.strip(F.regexp_replace(t.strip(t.text_of(column)), "^,+", ""))
    value = F.regexp_replace(value, r"\bTactic[AB]:", "Tactic:")
    if variant == "tactic":
        value = F.when(F.lower(value).startswith("tactic "), F.concat(F.lit("Tactic: "), t.strip(F.substring(value, 8, 1 << 30)))).otherwise(value)
    return t.collapse(value)


def rationale_text(source: Column, strategy: Column, tactic: Column, preferred: Column, themes: Column, move: Column, most: int = 240) -> Column:
    """The preferred option's strategy and tactic, else the first one's, else the whole texts; of puzzles their themes;
    without any of these the move; clipped."""
    def chosen(text: Column) -> Column:
        options = t.option_map(text)
        return F.when(F.size(options) > 0, F.coalesce(F.element_at(options, preferred), F.get(F.map_values(options), F.lit(0)))).otherwise(F.nullif(text, F.lit("")))

    both = lambda a, b: F.nullif(F.concat_ws(" ", a, b), F.lit(""))
    themed = F.when(F.size(themes) > 0, F.concat(F.lit("Puzzle themes: "), F.array_join(themes, ", ")))
    text = F.when(F.coalesce(source == "mate", F.lit(False)), both(chosen(strategy), chosen(tactic))).otherwise(F.coalesce(themed, both(strategy, tactic)))
    return t.clip(F.coalesce(text, F.concat(F.lit("Move focus: "), move), F.lit("")), most)


def rationales(aligned: DataFrame, most: int = 240) -> DataFrame:
    """``(rationale_id, sidecar_id, position_id, rationale_short, motifs, threats, defences)`` of the matched rows."""
    rows = aligned.where(F.col("matched_position_id").isNotNull())
    none = F.array().cast("array<string>")

    def tags(vocabulary, own=none) -> Column:
        """Tags of each text on its own, and the row's."""
        return F.array_join(F.array_sort(F.array_distinct(F.concat(F.coalesce(own, none), *[scoring.keyword_labels(t.text_of(c), vocabulary) for c in ("strategy_text", "tactic_text")]))), ",")

    return rows.select(
        F.concat(F.lit("rationale_"), F.substring(F.sha2(F.concat_ws(":", "sidecar_id", "matched_position_id"), 256), 1, 16)).alias("rationale_id"), "sidecar_id", F.col("matched_position_id").alias("position_id"),
        rationale_text(F.col("source"), F.col("strategy_text"), F.col("tactic_text"), t.preferred_option("preferred_move"), F.col("theme_tags"), F.col("matched_move"), most).alias("rationale_short"),
        tags(scoring.MOTIFS, F.col("theme_tags")).alias("motifs"), tags(scoring.THREATS).alias("threats"), tags(scoring.DEFENCES).alias("defences"))


def probe_targets(rows: DataFrame, text: str, vocabulary: dict, least: int) -> tuple[DataFrame, DataFrame]:
    """``rows`` with ``target_labels`` by keywords, without those rarer than ``least``, and ``(label, n, rare)``."""
    labelled = rows.withColumn("target_labels", scoring.keyword_labels(text, vocabulary))
    counts = labelled.select(F.explode("target_labels").alias("label")).groupBy("label").agg(F.count("*").alias("n")).withColumn("rare", F.col("n") < least)
    return audits.without_rare(labelled, "target_labels", least, list(vocabulary)), counts


#: Headers that make a game's identity, beside its file and key; the text of the identity is JSON with sorted keys.
IDENTITY = ("Black", "Date", "Event", "FEN", "Round", "Site", "White")


def record_id(prefix: str, **fields: Column) -> Column:
    """A digest of fields, as JSON with sorted keys and nulls."""
    value = lambda c: F.when(c.isNull(), "null").otherwise(F.regexp_replace(F.to_json(F.array(c)), r"^\[|\]$", ""))
    parts = [F.concat(F.lit(f'"{k}": '), value(c)) for k, c in sorted(fields.items())]
    return F.concat(F.lit(prefix), F.substring(F.sha2(F.concat(F.lit("{"), F.concat_ws(", ", *parts), F.lit("}")), 256), 1, 16))


def annotated_sidecar(rows: DataFrame, text: str = "text", key: str = "pipeline_key", file: str = "source_file") -> tuple[DataFrame, DataFrame]:
    """Rows of the main-line moves that are commented on, of games inside JSON rows, and a ledger ``(key, file, drop_reason)``.

    Reasons: ``missing_text``, ``non_standard_variant``, ``no_comment_annotations``. Positions and the legality of moves
    take the rules of play and are left out; moves stay as they are written.
    """
    read = rows.select(F.col(key).alias("source_row_id"), F.col(file).alias("source_file"), F.when(t.strip(t.text_of(text)) != "", F.col(text)).alias("_text"))
    game = read.withColumn("_g", F.when(F.col("_text").isNotNull(), movetext.games(F.col("_text")))).drop("_text")
    header = lambda name: F.element_at("_g.headers", name)
    told = F.filter("_g.nodes", lambda n: (n["depth"] == 0) & movetext.node_comment(n).isNotNull())
    game_id = record_id("ann_game_", source_file=F.col("source_file"), pipeline_key=F.col("source_row_id"), **{h.lower(): header(h) for h in IDENTITY})
    judged = written(game.select("source_row_id", "source_file", game_id.alias("game_id"), F.col("_g.headers").alias("headers"), told.alias("_told"), sidecars.drop_reasons(
        ("missing_text", F.col("_g").isNull()), ("non_standard_variant", ~sidecars.standard_annotated_game(t.strip(t.text_of(header("Variant"))))), ("no_comment_annotations", F.size(told) == 0)).alias("drop_reason")), "games")
    place = lambda tail, prefix: F.concat(F.lit(prefix), F.substring(F.sha2(F.concat_ws(":", "game_id", F.col("_n.ply").cast("string"), *tail), 256), 1, 16))
    nodes = judged.where("drop_reason is null").select("*", F.explode("_told").alias("_n")).withColumn("_c", movetext.node_comment(F.col("_n")))
    kept = nodes.select(
        place([F.lit("comment")], "sidecar_").alias("sidecar_id"), place([], "pos_").alias("position_id"), "game_id", "source_file", "source_row_id", F.col("_n.ply").alias("ply_index"), F.col("_n.move").alias("target_move"),
        F.col("_c.text").alias("comment_text"), F.col("_c.nags").alias("nag_codes"), F.col("_c.source").alias("comment_source"), "headers", split_of("game_id").alias("split"))
    return kept, judged.where("drop_reason is not null").select("source_row_id", "source_file", "drop_reason")


def pilot_gates(rows: DataFrame, game: str, split: str, reason: str, least_val: int = 1000, least_test: int = 1000) -> DataFrame:
    """``(gate, passed)``: no row with a broken position, target or history, no game in two splits, no empty or tiny split."""
    n = lambda c: F.count_if(c)
    leaks = rows.where(F.col(game).isNotNull()).groupBy(game).agg(F.count_distinct(split).alias("_s")).agg(F.count_if(F.col("_s") > 1).alias("leaks"))
    sums = rows.agg(*[n(F.col(reason) == r).alias(r) for r in ("invalid_fen", "invalid_target_move_uci", "history_fens_contract_violation")], *[n(F.col(split) == s).alias(s) for s in SPLITS])
    gates = {
        "no_invalid_fen_rows": F.col("invalid_fen") == 0, "no_invalid_target_move_rows": F.col("invalid_target_move_uci") == 0,
        "no_history_fens_contract_violations": F.col("history_fens_contract_violation") == 0, "no_split_leakage_by_game_id": F.col("leaks") == 0,
        **{f"{s}_non_empty": F.col(s) > 0 for s in SPLITS}, "val_not_tiny": F.col("val") >= least_val, "test_not_tiny": F.col("test") >= least_test,
    }
    both = sums.join(F.broadcast(leaks))  # one row each
    return both.select(F.explode(F.array(*[F.struct(F.lit(g).alias("gate"), c.alias("passed")) for g, c in gates.items()])).alias("g")).select("g.*")


def same_moves(a: str, b: str) -> Column:
    """Whether two lists hold the same moves, in any order; nulls are equal to nulls only."""
    return F.array_sort(a).eqNullSafe(F.array_sort(b))


def tag_union(*columns: str) -> Column:
    """All tags of several lists, each once, in order."""
    none = F.array().cast("array<string>")
    return F.array_sort(F.array_distinct(F.concat(*[F.coalesce(c, none) for c in columns])))


def rank_diagnostics(ranked: DataFrame) -> DataFrame:
    """One row of ranks ``(rank, strict_rank, ties)``: how many are 1, 2 to 5 and beyond, how many queries have tied
    competitors, their mean and largest number, and how many strict ranks are worse."""
    r, rivals = F.col("rank"), F.col("ties") - 1
    return ranked.agg(
        F.count_if(r == 1).alias("rank_1"), F.count_if(r.between(2, 5)).alias("rank_2_to_5"), F.count_if(r > 5).alias("rank_over_5"), F.count_if(rivals > 0).alias("tied_queries"),
        rounded(F.coalesce(F.avg(rivals), F.lit(0.0))).alias("mean_tied"), F.coalesce(F.max(rivals), F.lit(0)).alias("most_tied"), F.count_if(F.col("strict_rank") > r).alias("penalties"))
