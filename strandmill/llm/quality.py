"""Quality rules: a threshold table compiled into one Spark projection, without user functions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandmill.llm.common import free_names, let

SPACES = " \t\n\x0b\f\r"

#: Frequent function words of English, German, French and Spanish.
STOP_WORDS = (
    "the", "of", "and", "to", "in", "a", "is", "that", "it", "for", "on", "with", "as", "was", "be", "by", "this", "are", "from", "or",
    "der", "die", "das", "und", "den", "von", "zu", "mit", "sich", "des", "auf", "ist", "im", "nicht", "ein", "eine",
    "le", "la", "les", "de", "et", "un", "une", "du", "que", "est", "pour", "dans", "qui", "en",
    "el", "los", "las", "y", "por", "se", "con", "del", "su", "para",
)


@dataclass(frozen=True)
class Rule:
    """Passes when ``100 * numerator`` is at most (or, with ``least``, at least) ``percent * denominator``."""

    name: str
    numerator: str
    denominator: str
    percent: int
    least: bool = False

    def sql(self) -> str:
        return f"100 * {self.numerator} {'>=' if self.least else '<='} {self.percent} * {self.denominator}"


#: Length, symbol, stop-word and line ratios. Metrics are those of :func:`measures`.
RULES = (
    Rule("mean_word_length_low", "word_chars", "n_words", 200, least=True),
    Rule("mean_word_length_high", "word_chars", "n_words", 1500),
    Rule("symbols_per_word", "n_symbols", "n_words", 20),
    Rule("shouted_marks_per_word", "n_shouts", "n_words", 30),
    Rule("stop_words", "n_stop_words", "n_words", 2, least=True),
    Rule("repeated_lines", "n_dup_lines", "n_lines", 60),
)
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50


def words(text: Column) -> Column:
    """Runs of characters other than ASCII white space; none for a null text."""
    trimmed = F.trim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, r"[\x20\x09-\x0D]+"))


def repeated_words(tokens: Column, window: int = 3) -> Column:
    """How many words lie in ``window``-word runs that occur at least twice, the first occurrence included.

    Runs are compared by 64-bit hash: sorting (hash, start) brings equal runs together, and the starts that have an
    equal neighbour cover the words. It costs n log n whatever the text repeats.
    """
    size = F.size(tokens)
    runs = F.when(size >= window, F.transform(
        F.sequence(F.lit(1), size - (window - 1)),
        lambda i: F.struct(F.xxhash64(*[F.element_at(tokens, i + k) for k in range(window)]).alias("h"), i.alias("p")),
    ))

    def starts(s: Column) -> Column:
        same = lambda x, j: F.coalesce(F.get(s, j)["h"] == x["h"], F.lit(False))
        return F.sort_array(F.transform(F.filter(s, lambda x, j: same(x, j - 1) | same(x, j + 1)), lambda x: x["p"]))

    def covered(q: Column) -> Column:
        return F.aggregate(F.transform(q, lambda p, j: F.least(F.get(q, j + 1) - p, F.lit(window))), F.lit(0), lambda a, x: a + x)

    return F.coalesce(let(let(F.sort_array(runs), starts), covered), F.lit(0)).cast("long")


def measures(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` and the metrics of the rule table as long columns."""
    raw = F.coalesce(F.col(text), F.lit(""))
    tokens, lines, run = free_names(docs.columns, "_words", "_lines", "_joined")
    worded = docs.withColumns({
        tokens: words(F.col(text)),
        lines: F.filter(F.split(raw, "\n"), lambda x: F.trim(x, F.lit(SPACES)) != ""),
    })
    joined = worded.withColumn(run, F.array_join(tokens, ""))
    return joined.withColumns({
        "n_words": F.size(tokens).cast("long"),
        "word_chars": F.length(run).cast("long"),
        "n_symbols": F.regexp_count(run, F.lit("[#*$%&|<>]")).cast("long"),
        "n_shouts": F.regexp_count(run, F.lit("!")).cast("long"),
        "n_lines": F.size(lines).cast("long"),
        "n_dup_lines": (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"),
        "n_stop_words": F.size(F.filter(tokens, lambda w: F.lower(w).isin(*STOP_WORDS))).cast("long"),
        "n_repeat_words": repeated_words(F.col(tokens)),
    }).drop(tokens, lines, run)


def verdict_sql(rules=RULES) -> tuple[str, str]:
    """SQL of ``base_failed`` and ``kept``, the rule table compiled to one expression."""
    base = f"(n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words)"
    return base, f"(NOT {base} AND {' AND '.join(f'({r.sql()})' for r in rules)})"


def apply_rules(docs: DataFrame, text: str = "text", rules=RULES) -> DataFrame:
    """``docs`` with the metrics, ``base_failed``, ``kept`` and ``failed_rules`` (names, in table order).

    A null or empty text has no words and fails the base. Rows are judged one by one, so ties and repeated rows get
    equal verdicts and an empty table gives an empty one. Columns of ``docs`` that bear a metric's name are replaced.
    """
    base, kept = verdict_sql(rules)
    failed = F.filter(F.array(*[F.when(~F.expr(r.sql()), F.lit(r.name)) for r in rules]), lambda x: x.isNotNull())
    return measures(docs, text).withColumns({"base_failed": F.expr(base), "kept": F.expr(kept), "failed_rules": failed})


def op1_quality_rules(spark, sf_dir):
    from strandmill.llm.common import table

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return apply_rules(docs).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def oracle_sql() -> str:
    base, kept = verdict_sql()
    stops = ", ".join(f"'{w}'" for w in STOP_WORDS)
    blank = r"[^\x20\x09-\x0D]"
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT rid, doc_id, text, regexp_extract_all(text, '{blank}+') AS ws,
        list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{blank}')) AS ls FROM d),
g AS (SELECT rid, unnest(range(1, greatest(len(ws) - 2, 0) + 1)) AS p, ws FROM w),
h AS (SELECT rid, p, ws[p] || ' ' || ws[p + 1] || ' ' || ws[p + 2] AS k FROM g),
r AS (SELECT rid, p FROM (SELECT rid, p, count(*) OVER (PARTITION BY rid, k) AS c FROM h) WHERE c > 1),
n AS (SELECT rid, count(DISTINCT q) AS n_repeat_words FROM (SELECT rid, unnest([p, p + 1, p + 2]) AS q FROM r) GROUP BY rid),
m AS (SELECT doc_id, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
        len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols, len(regexp_extract_all(text, '!'))::BIGINT AS n_shouts,
        len(ls)::BIGINT AS n_lines, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
        len(list_filter(ws, lambda x: lower(x) IN ({stops})))::BIGINT AS n_stop_words,
        coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words FROM w LEFT JOIN n USING (rid))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, {base} AS base_failed, {kept} AS kept FROM m"""
