"""Row classifiers and scorers: boilerplate categories, informativeness, keyword labels, style and gate rules."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandmill.functions import text as t

# Words of the domain, of explanation and of moves, and the patterns of results and templates.
DOMAIN_WORDS = (
    "attack", "attacks", "back", "bishop", "capture", "captures", "castle", "castles", "castling", "center", "central",
    "check", "checkmate", "counterplay", "defend", "defends", "diagonal", "endgame", "exchange", "file", "fork", "king",
    "knight", "mate", "pawn", "pin", "promotion", "queen", "rank", "recapture", "rook", "skewer", "square", "tactic", "threat",
)
EXPLANATORY_WORDS = ("because", "but", "however", "if", "since", "so", "therefore", "thus", "while", "with")
ANCHOR_WORDS = (
    "capture", "captures", "castle", "castles", "castling", "check", "checkmate", "mate", "promotes", "promotion",
    "recapture", "takes", "threat", "threatens",
)
SQUARE = r"(?i)\b[a-h][1-8]\b"
RESULT = r"(?i)^(1-0|0-1|1/2-1/2)(\s+.+)?\.?$"
SYMBOLS_ONLY = r"^[!?\.]+$"
ENGINE_TEMPLATE = r"(?i)^(inaccuracy|mistake|blunder)\.\s+.+\s+was best\.?$|^forced\.?$"
KEYWORD_LABELS = {
    "check": (" check", "check ", "checking", "in check"),
    "mate_threat": ("checkmate", " mate", "mate!", "mate threat"),
    "fork": ("fork",),
    "pin": (" pin", "pinned"),
    "skewer": ("skewer",),
    "discovered_attack": ("discovered attack",),
    "discovered_check": ("discovered check",),
    "king_safety": ("king safety", "opposing king", "enemy king", "near the opposing king"),
    "passed_pawn": ("passed pawn",),
    "open_file": ("open file",),
    "promotion": ("promotion", "promote", "queen the pawn"),
    "capture": ("capture", "captures", "captured", "taken", "take ", "trades the lower value piece"),
    "recapture": ("recapture",),
}
BASE_DROPS = (
    "engine_template", "low_lexical_diversity_repeated", "markup_only", "pgn_markup_heavy", "result_comment",
    "short_repeated_template", "symbol_only",
)


@dataclass(frozen=True)
class BoilerplateConfig:
    repeated_count: int = 20
    short_characters: int = 24
    short_tokens: int = 4
    low_diversity: float = 0.5
    low_diversity_tokens: int = 6
    heavy_share: float = 0.35


@dataclass(frozen=True)
class InformativenessConfig:
    medium: float = 0.45
    high: float = 0.62
    source_quantile: float = 0.6
    special_floor: float = 0.3


def clamp(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def share(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(0.0)


#: What :func:`boilerplate_features` adds: all that the rules need of a text, so that texts are read once.
FEATURES = ("token_count", "lexical_diversity", "markup_share", "_own", "_short", "_dull", "_bare")


def boilerplate_features(rows: DataFrame, column: str, config: BoilerplateConfig = BoilerplateConfig()) -> DataFrame:
    """Adds ``plain_text`` and ``FEATURES``: counts, the categories of the text alone in rule order, and whether it is
    short, dull or without anything."""
    staged = rows.withColumn("_raw", t.strip(t.text_of(column))).withColumns({
        "plain_text": t.strip_markup(F.col("_raw")), "_tags": t.markup_tags(F.col("_raw")),
        "markup_share": share(t.markup_characters(F.col("_raw")).cast("double"), F.length("_raw"))})
    staged = staged.withColumn("_tokens", t.tokens(F.col("plain_text"))).withColumns({
        "token_count": F.size("_tokens"), "lexical_diversity": t.diversity(F.col("_tokens"))})
    c, plain, n = F.col, F.col("plain_text"), F.col("token_count")
    tagged, bare = F.size("_tags") > 0, plain == ""
    rules = [
        ("markup_only", (c("_raw") != "") & tagged & bare),
        ("pgn_markup_heavy", tagged & (bare | (c("markup_share") >= config.heavy_share) | ((n <= 2) & F.arrays_overlap("_tags", F.array(*map(F.lit, ("eval", "clk", "emt"))))))),
        ("result_comment", plain.rlike(RESULT)),
        ("symbol_only", plain.rlike(SYMBOLS_ONLY)),
        ("engine_template", plain.rlike(ENGINE_TEMPLATE)),
    ]
    return staged.withColumns({
        "_own": F.array_compact(F.array(*[F.when(rule, F.lit(name)) for name, rule in rules])), "_bare": bare,
        "_short": (F.length(plain) <= config.short_characters) | (n <= config.short_tokens),
        "_dull": (n > 0) & (n <= config.low_diversity_tokens) & (c("lexical_diversity") <= config.low_diversity)}).drop("_raw", "_tags", "_tokens")


def with_categories(featured: DataFrame, template_count: str, config: BoilerplateConfig = BoilerplateConfig()) -> DataFrame:
    """Adds ``categories``, those of the text alone and those of repeated templates; an empty template counts 0."""
    repeated = F.col(template_count) >= config.repeated_count
    more = [("short_repeated_template", F.col("_short")), ("low_lexical_diversity_repeated", F.col("_dull"))]
    return featured.withColumn("categories", F.concat("_own", F.array_compact(F.array(*[F.when(repeated & rule, F.lit(name)) for name, rule in more]))))


def boilerplate(rows: DataFrame, column: str, template_count: str, config: BoilerplateConfig = BoilerplateConfig()) -> DataFrame:
    """Adds ``plain_text``, ``token_count``, ``lexical_diversity``, ``markup_share`` and ``categories``, in rule order."""
    return with_categories(boilerplate_features(rows, column, config), template_count, config).drop("_own", "_short", "_dull", "_bare")


def informativeness(rows: DataFrame, column: str, original: str | None = None, config: InformativenessConfig = InformativenessConfig()) -> DataFrame:
    """Adds the features, ``score`` and ``bucket``."""
    staged = rows.withColumn("_text", t.strip(t.text_of(column)))
    staged = staged.withColumns({"_tokens": t.tokens(F.col("_text")), "_original": t.strip(t.text_of(original)) if original else F.col("_text")})
    words, n = F.col("_tokens"), F.size("_tokens")
    among = lambda names: F.size(F.filter(words, lambda x: x.isin(*names)))
    staged = staged.withColumns({
        "char_length": F.length("_text"), "token_count": n, "lexical_diversity": t.diversity(words),
        "alpha_token_ratio": share(F.size(F.filter(words, lambda x: x.rlike("[a-z]"))).cast("double"), n),
        "_numeric": share(F.size(F.filter(words, lambda x: x.rlike("^[0-9]+$"))).cast("double"), n),
        "markup_ratio": share(t.markup_characters(F.col("_original")).cast("double"), F.length("_original")),
        "symbol_ratio": share(F.length(F.regexp_replace("_text", r"[\p{L}\p{N}" + t.SPACE[1:-1] + "]+", "")).cast("double"), F.length("_text")),
        "domain_hits": among(DOMAIN_WORDS), "explanatory_hits": among(EXPLANATORY_WORDS),
        "anchor_hits": among(ANCHOR_WORDS) + F.regexp_count("_text", F.lit(SQUARE)),
    }).drop("_tokens")
    staged = staged.withColumn("mostly_numeric_or_result", F.col("_text").rlike(RESULT) | (F.col("_numeric") >= 0.5) | (F.col("markup_ratio") >= 0.5))
    score, penalty = map(F.expr, score_sql())
    staged = staged.withColumn("score", clamp(score - penalty)).drop("_text", "_numeric", "_original")
    return staged.withColumn("bucket", bucket(F.col("score"), config))


# Feature, where it starts to count, the span over which it grows, and its weight; then what is added or taken off.
SCALES = (
    ("least(char_length, 220)", "20.0", "120.0", "0.18"), ("least(token_count, 32)", "4.0", "12.0", "0.16"), ("lexical_diversity", "0.35", "0.45", "0.16"),
    ("alpha_token_ratio", "0.0", "1.0", "0.10"), ("domain_hits", "0.0", "2.0", "0.16"),
)
BONUSES = (("explanatory_hits > 0", "0.12"), ("anchor_hits > 0", "0.12"))
PENALTIES = (("mostly_numeric_or_result", "0.35"), ("symbol_ratio >= 0.25", "0.10"), ("alpha_token_ratio < 0.5", "0.08"))


def score_sql() -> tuple[str, str]:
    """Weighted features and penalties, in words that both engines know; numbers are doubles in both."""
    d = lambda x: f"CAST({x} AS DOUBLE)"
    unit = lambda x, low, span: f"greatest({d(0)}, least({d(1)}, ({x} - {d(low)}) / {d(span)}))"
    given = lambda rules: " + ".join(f"CASE WHEN {rule} THEN {d(w)} ELSE {d(0)} END" for rule, w in rules)
    scaled = " + ".join(f"{d(w)} * {unit(x, low, span)}" for x, low, span, w in SCALES)
    return f"({scaled} + {given(BONUSES)})", f"({given(PENALTIES)})"


def bucket(score: Column, config: InformativenessConfig = InformativenessConfig()) -> Column:
    return F.when(score >= config.high, "high").when(score >= config.medium, "medium").otherwise("low")


def keyword_labels(column: Column, labels=KEYWORD_LABELS) -> Column:
    """Labels of which a pattern occurs, in the order of the map."""
    low = F.lower(t.text_of(column))
    hit = lambda patterns: F.greatest(F.lit(False), *[low.contains(p) for p in patterns])
    return F.array_compact(F.array(*[F.when(hit(p), F.lit(name)) for name, p in labels.items()]))


def style_cluster(markup: Column, numeric: Column, duplicates: Column, score: Column) -> Column:
    """Style of a group by its rates of markup-heavy, of numeric or symbol-heavy and of repeated rows, and its mean score."""
    return (F.when((markup >= 0.2) | (numeric >= 0.2), "markup_heavy").when(duplicates >= 0.25, "repetitive")
            .when((score >= 0.68) & (markup < 0.1), "human_leaning").otherwise("mixed_style"))


def pool_class(rows: Column) -> Column:
    return F.when(rows <= 199, "exploratory_only").when(rows < 500, "secondary_shared").when(rows >= 1000, "strong_primary").otherwise("primary_shared")


def interval_reading(low: Column, high: Column) -> Column:
    return F.when(low > 0, "credible_positive").when(high < 0, "credible_negative").otherwise("inconclusive")


@dataclass(frozen=True)
class Thresholds:
    total: int = 30
    train: int = 20
    val: int = 2
    test: int = 2
    order: tuple = field(default=("total", "train", "val", "test"))


def eligibility(thresholds: Thresholds = Thresholds()) -> Column:
    """The first minimum that a group misses, such as ``total<30``; null if it meets all."""
    rule = F.lit(None).cast("string")
    for name in reversed(thresholds.order):
        least = getattr(thresholds, name)
        rule = F.when(F.col(name) < least, F.lit(f"{name}<{least}")).otherwise(rule)
    return rule


# What in a text gives which tag, tried in this order; theme groups by parts of tags.
MOTIFS = {"checkmate_pattern": ("mate",), "check": ("check",), "exchange": ("trade", "exchange"), "line_opening": ("open file", "open diagonal")}
THREATS = {"mate_threat": ("mate",), "forcing_check": ("check",), "king_pressure": ("king",)}
DEFENCES = {"defensive_response": ("defend", "respond", "legal king move")}
THEME_GROUPS = {"promotion_related": ("promotion", "promote"), "check_related": ("check", "mate", "evasion"), "castling_related": ("castle", "castling"), "en_passant_related": ("enpassant",)}
# Labels that could join the keyword map, their patterns, and how likely these mislead.
CANDIDATE_LABELS = {
    "trade_up": (("trade the lower value piece for a higher value piece", "trade your lesser piece for a more valuable piece", "more valuable piece"), "low"),
    "sacrifice_for_attack": (("sacrifice a piece", "surrender a piece"), "medium"),
    "open_line_attack": (("open file or diagonal", "unlock a file or diagonal", "create an open file or diagonal"), "low"),
    "piece_activity": (("more actively", "greater board command", "more influence over the board", "control over the board"), "high"),
    "king_attack_zone": (("opposing king", "enemy king", "near the opposing king", "proximity to the opposing king"), "medium"),
}


def theme_groups(tags: Column) -> list[Column]:
    """A boolean for each theme group: a tag, without its other signs, has a part of the group."""
    plain = F.transform(F.coalesce(tags, F.array().cast("array<string>")), lambda x: F.regexp_replace(F.lower(x), r"[^\p{L}\p{N}]", ""))
    some = lambda parts: F.exists(plain, lambda x: F.greatest(F.lit(False), *[x.contains(p) for p in parts]))
    return [some(parts).alias(f"theme_{name}") for name, parts in THEME_GROUPS.items()]


def verification_gate(missing: Column, mismatched: Column, suspicious: Column) -> Column:
    return (F.when((missing > 0) | (mismatched > 0), "NOT_VERIFIED").when(suspicious > 0, "VERIFIED_BUT_NEEDS_SANITY_AUDIT").otherwise("VERIFIED_GOOD"))


def readiness(matched: dict[str, Column], rationales: dict[str, Column], leaked: Column, enough: tuple[int, int, int] = (100, 25, 25)) -> Column:
    """``not_ready`` if a split is empty or leaks, ``partially_ready`` if one is small, else ``ready``."""
    empty = (leaked > 0) | (F.least(*matched.values()) == 0) | (F.least(*rationales.values()) == 0)
    small = F.greatest(*[matched[s] < n for s, n in zip(("train", "val", "test"), enough)])
    return F.when(empty, "not_ready").when(small, "partially_ready").otherwise("ready")


def signal_state(ap_gain: Column, f1_gain: Column) -> Column:
    """How much a probe gains over its baseline."""
    return F.when((ap_gain > 0.06) & (f1_gain > 0.10), "strong").when((ap_gain > 0.02) | (f1_gain > 0.05), "some").otherwise("none")
