"""Rows of outside sources brought into one shape: evaluations, prompts with options, games to keep, source families."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandmill.functions import text as t
from strandmill.functions.hashing import short_id
from strandmill.operators.boards import position_key


def flat_evaluations(rows: DataFrame) -> DataFrame:
    """``(position, depth, cp, mate, best_move)`` of rows ``fen, depth, cp, mate, pv, evals``.

    Of nested evaluations the deepest counts, the first of equally deep ones, and of it the first line; a null in it
    stays null. Rows without nested evaluations give their own values. Rows without a position are left out.
    """
    deeper = lambda a, x: F.when(a.isNull() | (F.coalesce(x["depth"], F.lit(-1)) > F.coalesce(a["depth"], F.lit(-1))), x).otherwise(a)
    kind = rows.schema["evals"].dataType.elementType.simpleString()
    best = rows.where(t.strip(t.text_of("fen")) != "").withColumn("_best", F.aggregate(F.coalesce("evals", F.array().cast(f"array<{kind}>")), F.lit(None).cast(kind), deeper))
    leaf = F.get(F.col("_best.pvs"), F.lit(0))
    nested = F.size(F.coalesce("_best.pvs", F.array())) > 0
    line = F.coalesce(leaf["line"], F.col("pv"))
    move = F.regexp_extract(t.strip(t.text_of(line)), r"^(\S+)", 1)
    return best.select(
        position_key("fen").alias("position"), F.coalesce("_best.depth", "depth").alias("depth"),
        F.when(nested, leaf["cp"]).otherwise(F.col("cp")).alias("cp"), F.when(nested, leaf["mate"]).otherwise(F.col("mate")).alias("mate"),
        F.when(move != "", move).alias("best_move"))


def value_of(cp: Column, mate: Column, sentinel: int = 100_000) -> Column:
    """One value: centipawns, or without any the sentinel with the mate's sign; null without either."""
    return F.coalesce(cp, F.when(mate > 0, sentinel).when(mate < 0, -sentinel))


def prompt_rows(rows: DataFrame, prompt: str, answer: str, key: str) -> tuple[DataFrame, DataFrame]:
    """Rows of prompts and answers in the shape of a sidecar, and a ledger ``(key, drop_reason)`` of those without
    a position or without moves."""
    shaped = rows.select(
        key, t.quoted_position(prompt).alias("fen"), t.named_moves(prompt).alias("candidate_moves"),
        t.option_texts(prompt, "strategy").alias("strategy_text"), t.option_texts(prompt, "tactic").alias("tactic_text"),
        t.preferred_option(answer).alias("preferred_option"),
        F.get(t.named_moves(answer), F.lit(0)).alias("preferred_move")).withColumn("drop_reason", F.when(F.col("fen").isNull(), "missing_position").when(F.size("candidate_moves") == 0, "missing_moves"))
    kept = shaped.where("drop_reason is null").drop("drop_reason").withColumn("position_id", short_id(F.concat_ws("|", F.lit("prompt"), "fen", F.array_join("candidate_moves", " "))))
    return kept, shaped.where("drop_reason is not null").select(key, "drop_reason")


def drop_reasons(*rules: tuple[str, Column]) -> Column:
    """The first rule that holds; null if none does."""
    reason = F.lit(None).cast("string")
    for name, holds in reversed(rules):
        reason = F.when(F.coalesce(holds, F.lit(False)), name).otherwise(reason)
    return reason


def game_reasons(variant: Column, rated: Column | None, plies: Column, least: int = 0, most: int | None = None) -> Column:
    """Why a game is left out, in order: variant, rating, too short, too long."""
    rules = [("non_standard_variant", ~standard_game(variant))]
    if rated is not None:
        rules.append(("unrated_game", ~F.coalesce(rated, F.lit(False))))
    rules.append(("too_short_game", plies < least))
    if most is not None:
        rules.append(("too_long_game", plies > most))
    return drop_reasons(*rules)


# Variants of plain games, in any case; of annotated games, as they are written; values of a rated header.
VARIANTS = ("", "standard", "chess", "from position")
ANNOTATED_VARIANTS = ("", "Standard")
RATED = ("true", "yes", "1")
# Starts of source names that say how the family is found, and the prefix of families without a domain.
DATASET_SOURCE, ARCHIVE_SOURCE, ARCHIVE_PREFIX = "mate_dataset_", "waterhorse_annotated_pgn", "waterhorse"


def standard_game(variant: Column) -> Column:
    return F.lower(t.strip(t.text_of(variant))).isin(*VARIANTS)


def standard_annotated_game(variant: Column) -> Column:
    """Stricter than :func:`standard_game`: the header as it is written."""
    return t.text_of(variant).isin(*ANNOTATED_VARIANTS)


def rated_game(header: Column, event: Column) -> Column:
    """By the header, else by an event that says so."""
    return F.lower(t.strip(t.text_of(header))).isin(*RATED) | F.lower(t.text_of(event)).contains("rated")


def source_family(given: str, source: str, site: str, event: str, annotator: str, file: str, noted: str | None = None) -> Column:
    """The family of a row's source: a slug of what is given; of a data set its name; of an archive of annotated games
    the domain of site or annotator (``noted`` is one beside the headers), else a prefixed slug of site, event or
    annotator; of any other row the stem of its file, else the source."""
    name = F.coalesce(F.nullif(F.col(source), F.lit("")), F.lit("unknown"))
    known = lambda c: F.when(~t.strip(t.text_of(c)).isin("", "?"), t.strip(t.text_of(c)))
    domains = [t.domain(c) for c in (site, annotator, noted) if c]
    slugs = [F.when(known(c).isNotNull(), F.concat(F.lit(ARCHIVE_PREFIX + "::"), F.substring(t.slug(known(c)), 1, 64))) for c in (site, event, annotator)]
    archive = F.coalesce(*domains, *slugs, F.lit(ARCHIVE_PREFIX + "::unknown"))
    stem = F.regexp_replace(F.regexp_extract(t.text_of(file), r"([^/]*)/*$", 1), r"(?<=[^.])\.[^.]*$", "")
    return (F.when(t.text_of(given) != "", t.slug(given)).when(name.startswith(DATASET_SOURCE), t.slug(name)).when(name.startswith(ARCHIVE_SOURCE), archive)
            .when(stem != "", t.slug(stem)).otherwise(t.slug(name)))
