"""Row-level flags with their corpus-wide counts, the filters that use them, and group audits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandmill.functions import scoring, text as t
from strandmill.functions.hashing import rank_key
from strandmill.operators import stats
from strandmill.operators.dedup import digest
from strandmill.operators.ranking import first_n, left_join_split, names
from strandmill.sources.shared import written


def with_counts(light: DataFrame, key: str = "_template", into: str = "template_count") -> DataFrame:
    """``light`` with how many rows of all splits have the same key; 0 without a key.

    Only repeated keys are joined back; a key of very many rows is joined where its rows lie, and rows without a key take
    no part in the join.
    """
    repeated = written(light.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("_n")).where("_n > 1"), "repeated")
    joined = left_join_split(light, repeated, key, repeated)
    return joined.withColumn(into, F.when(F.col(key).isNull(), 0).otherwise(F.coalesce("_n", F.lit(1))).cast("long")).select(*light.columns, into)


def light_flags(rows: DataFrame, text: str, keep: list[str], config=scoring.BoilerplateConfig()) -> DataFrame:
    """``keep``, digests of template and plain text, and the features of the boilerplate rules: written once, without texts.

    The template of a text and the light view of its plain text are one: both drop markup first.
    """
    featured = scoring.boilerplate_features(rows.select(*dict.fromkeys([*keep, text])), text, config)
    return written(featured.select(*keep, digest(t.normalize(F.col("plain_text"), "punct_light")).alias("_template"), F.md5("plain_text").alias("plain_md5"), *scoring.FEATURES), "flags")


def boilerplate_flags(rows: DataFrame, text: str, keep: list[str], config=scoring.BoilerplateConfig()) -> DataFrame:
    """``keep`` with ``template_count``, counts, ``plain_md5`` and ``categories`` of each row."""
    return scoring.with_categories(with_counts(light_flags(rows, text, keep, config)), "template_count", config)


def category_audit(flagged: DataFrame, by: str) -> DataFrame:
    """Rows of each category in each group, and their share of the group; only pairs that occur."""
    sizes = flagged.groupBy(by).agg(F.count("*").alias("_all"))
    hits = flagged.select(by, F.explode("categories").alias("category")).groupBy(by, "category").agg(F.count("*").alias("n"))
    return hits.join(sizes, by).select(by, "category", "n", F.round(F.col("n") / F.col("_all"), 6).alias("share"))


def first_category(categories: str, drops=scoring.BASE_DROPS) -> Column:
    """The first category, in rule order, that is among those to drop."""
    return F.get(F.filter(F.col(categories), lambda x: x.isin(*drops)), F.lit(0))


# The variants of a clean table, the categories they drop, and what they cap.
VARIANTS = {
    "remove_eval_markup_heavy": (("markup_only", "pgn_markup_heavy"), None), "remove_short_boilerplate": (scoring.BASE_DROPS, None),
    "keep_comment_source_balance": (scoring.BASE_DROPS, "source"), "template_capped": (scoring.BASE_DROPS, "template"),
}


def clean(flagged: DataFrame, identity: str, within: list[str], keep: int | None = 3, salt: str = "clean", drops=scoring.BASE_DROPS, order: list[Column] | None = None) -> tuple[DataFrame, DataFrame]:
    """Of rows with flags those that stay, and a ledger ``(identity, drop_reason)`` of the others.

    Reasons in order: ``boilerplate:`` and the first dropped category, ``empty_after_cleanup``, and ``template_cap`` beyond the first
    ``keep`` rows of a template in its group, by ``order``, else by a salted digest. No text is moved: :func:`attach` fetches those of the rows that stay.
    """
    reasoned = flagged.withColumn("drop_reason", F.coalesce(F.concat(F.lit("boilerplate:"), first_category("categories", drops)), F.when(F.col("_bare"), "empty_after_cleanup")))
    lost, passed = reasoned.where("drop_reason is not null").select(identity, "drop_reason"), reasoned.where("drop_reason is null").drop("drop_reason")
    if keep is None:
        return passed, lost
    keyed = passed.withColumn("_key", F.coalesce("_template", F.concat(F.lit("own:"), F.col(identity).cast("string"))))
    kept = first_n(keyed, [*within, "_key"], order or [rank_key(salt, identity), F.col(identity)], keep).drop("_key", "keep_rank")
    capped = passed.select(identity).join(kept.select(identity), identity, "left_anti").withColumn("drop_reason", F.lit("template_cap"))
    return kept, lost.union(capped)


def attach(rows: DataFrame, kept: DataFrame, identity: str, text: str) -> DataFrame:
    """The rows that stay, with ``plain_text``."""
    return rows.join(kept.select(identity), identity, "left_semi").withColumn("plain_text", t.strip_markup(text))


def clean_variants(rows: DataFrame, text: str, identity: str, split: str, source: str, template_cap: int = 3, source_cap: int = 3, salt: str = "clean") -> dict[str, tuple[DataFrame, DataFrame]]:
    """Kept rows and ledger of each of ``VARIANTS``; texts are flagged once for all of them."""
    flagged = written(boilerplate_flags(rows, text, [identity, split, source]), "flagged")
    out = {}
    for name, (drops, cap) in VARIANTS.items():
        within, most = {None: ([split], None), "source": ([split, source], source_cap), "template": ([split], template_cap)}[cap]
        out[name] = clean(flagged, identity, within, most, f"{salt}:{name}", drops)
    return out


def variant_counts(variants: dict[str, tuple[DataFrame, DataFrame]], by: str | None = None) -> DataFrame:
    """``(variant, outcome, n)``: rows kept, and rows dropped for each reason; of each value of ``by`` among the kept ones."""
    parts = None
    for name, (kept, ledger) in variants.items():
        outcome = F.lit("kept") if by is None else F.concat(F.lit("kept:"), F.coalesce(F.col(by).cast("string"), F.lit("unknown")))
        one = kept.select(F.lit(name).alias("variant"), outcome.alias("outcome")).union(ledger.select(F.lit(name), "drop_reason"))
        parts = one if parts is None else parts.union(one)
    return parts.groupBy("variant", "outcome").agg(F.count("*").alias("n"))


def before_and_after(rows: DataFrame, text: str, identity: str, split: str, source: str, percentiles: tuple[float, ...] = (0.5, 0.9), order: list[Column] | None = None, **caps) -> DataFrame:
    """``(variant, scope, value, n, repeated, flagged, mean, max, percentiles)`` of the lengths of plain texts: before cleaning
    and after each of ``VARIANTS``, of all rows, by split and by source. Caps keep the first rows by ``order``, as in :func:`clean`.

    Texts are flagged once. Rows are counted by their small features before anything is counted by variant and scope, and
    percentiles come from counts of distinct lengths, so no set of rows is gathered.
    """
    length = F.length(t.strip_markup(text)).cast("long")
    flagged = written(boilerplate_flags(rows.withColumn("size", length), text, [identity, split, source, "size"]), "flagged")
    kept = [flagged.select(F.lit("before").alias("variant"), identity)]
    for name, (drops, cap) in VARIANTS.items():
        within, most = {None: ([split], None), "source": ([split, source], caps.get("source_cap", 3)), "template": ([split], caps.get("template_cap", 3))}[cap]
        kept.append(clean(flagged, identity, within, most, f"{caps.get('salt', 'clean')}:{name}", drops, order)[0].select(F.lit(name).alias("variant"), identity))
    every = kept[0]
    for one in kept[1:]:
        every = every.union(one)
    light = flagged.select(identity, F.col(split).alias("_split"), F.coalesce(F.col(source).cast("string"), F.lit("unknown")).alias("_source"), "size", (F.col("template_count") > 1).alias("_repeated"), (F.size("categories") > 0).alias("_flagged"))
    counted = written(every.join(light, identity).groupBy("variant", "_split", "_source", "size", "_repeated", "_flagged").agg(F.count("*").alias("_c")), "audits")
    scope = lambda name, value: F.struct(F.lit(name).alias("scope"), value.alias("value"))
    scoped = counted.select("*", F.explode(F.array(scope("all", F.lit("all")), scope("split", F.col("_split")), scope("source", F.col("_source")))).alias("_s")).select("*", "_s.*")
    by = ["variant", "scope", "value"]
    sums = scoped.groupBy(*by).agg(F.sum(F.when(F.col("_repeated"), F.col("_c")).otherwise(0)).alias("repeated"), F.sum(F.when(F.col("_flagged"), F.col("_c")).otherwise(0)).alias("flagged"))
    sizes = stats.distribution(scoped, by, "size", percentiles, "_c")
    return sums.join(sizes, by)


def quantile_thresholds(scored: DataFrame, by: list[str], config=scoring.InformativenessConfig()) -> DataFrame:
    """Each group's threshold: the larger of the medium bound and its quantile of scores."""
    p = config.source_quantile
    return stats.distribution(scored, by, "score", (p,)).select(*by, F.greatest(F.lit(config.medium), F.col(stats.label_of(p))).alias("threshold"))


def informative_variants(scored: DataFrame, by: list[str], special: Column | None = None, config=scoring.InformativenessConfig()) -> DataFrame:
    """``scored`` with a boolean for each filter: high, medium, the group's quantile, and medium or special with a floor."""
    score = F.col("score")
    return scored.join(quantile_thresholds(scored, by, config), by).withColumns({
        "keep_high": score >= config.high, "keep_medium": score >= config.medium, "keep_quantile": score >= F.col("threshold"),
        "keep_special": (score >= config.medium) if special is None else (score >= config.medium) | (special & (score >= config.special_floor))})


def family_audit(rows: DataFrame, family: str, text: str, split: str, least: int = 1) -> DataFrame:
    """A row per family: rows, share of all, rows by split, share of repeated texts, mean, median and largest length."""
    keyed = rows.select(stats.named(family).alias("family"), split, digest(t.normalize(text, "punct_light")).alias("_key"), F.length(t.text_of(text)).alias("_length"))
    counts = stats.shares(stats.pivot_counts(keyed, "family", split, ["train", "val", "test"], "n").where(F.col("n") >= least))
    pairs = keyed.groupBy("family", "_key").agg(F.count("*").alias("c"))
    copies = pairs.groupBy("family").agg(F.round(F.sum(F.when(F.col("_key").isNotNull(), F.col("c") - 1).otherwise(0)) / F.sum("c"), 6).alias("duplicate_share"))
    lengths = stats.distribution(keyed, "family", "_length", (0.5,)).select("family", F.col("mean").alias("mean_length"), F.col("p50").alias("median_length"), F.col("max").alias("max_length"))
    return counts.join(copies, "family").join(lengths, "family")


def style_audit(rows: DataFrame, family: str, text: str, least: int = 1) -> DataFrame:
    """Averages of style features by family, the style they make, and how far each family is from the others.

    Texts are read once, for a table of features; the counts of templates are joined to that.
    """
    featured = scoring.informativeness(scoring.boilerplate_features(rows.select(stats.named(family).alias("family"), text), text), text)
    light = written(featured.select(
        "family", "char_length", "token_count", "lexical_diversity", F.col("markup_share").alias("markup_rate"), "score", digest(t.normalize(F.col("plain_text"), "punct_light")).alias("_template"),
        F.arrays_overlap("_own", F.array(F.lit("markup_only"), F.lit("pgn_markup_heavy"))).alias("_heavy"),
        (F.col("mostly_numeric_or_result") | (F.col("symbol_ratio") >= 0.25)).alias("_numeric")), "styles")
    rate = lambda c: F.round(F.avg(c.cast("int")), 6)
    averages = with_counts(light).groupBy("family").agg(
        F.count("*").alias("n"), *[F.round(F.avg(c), 6).alias(c) for c in ("char_length", "token_count", "lexical_diversity", "markup_rate", "score")],
        rate(F.col("_heavy")).alias("markup_heavy_rate"), rate(F.col("_numeric")).alias("numeric_rate"), rate(F.col("template_count") > 1).alias("duplicate_rate")).where(F.col("n") >= least)
    named = averages.withColumn("style", scoring.style_cluster(F.col("markup_heavy_rate"), F.col("numeric_rate"), F.col("duplicate_rate"), F.col("score")))
    return stats.divergence(named, ["char_length", "token_count", "lexical_diversity", "markup_rate", "duplicate_rate", "numeric_rate"])


def label_frequency(labelled: DataFrame, labels: str, by=()) -> DataFrame:
    return labelled.select(*names(by), F.explode(labels).alias("label")).groupBy(*names(by), "label").agg(F.count("*").alias("n"))


def without_rare(labelled: DataFrame, labels: str, least: int, vocabulary: list[str]) -> DataFrame:
    """``labelled`` without labels that occur fewer than ``least`` times; the vocabulary is a short given list."""
    counts = labelled.agg(*[F.count_if(F.array_contains(labels, v)).alias(f"c{i}") for i, v in enumerate(vocabulary)]).first()
    rare = [v for i, v in enumerate(vocabulary) if counts[i] < least]
    return labelled.withColumn(labels, F.filter(labels, lambda x: ~x.isin(*rare))) if rare else labelled
