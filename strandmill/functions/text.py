"""Text normalisers and token helpers as Column expressions; each has the same rule as SQL for the oracle."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as str.strip and str.split see it: the Unicode spaces and U+001C to U+001F.
SPACE = r"[\t-\r\x1c-\x20\x85\xa0  -     　]"
SPACE_RE2 = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
#: Neither a word character (letter, number, underscore) nor white space.
PUNCTUATION = r"[^\p{L}\p{N}_" + SPACE[1:-1] + "]"
PUNCTUATION_RE2 = r"[^\p{L}\p{N}_" + SPACE_RE2[1:-1] + "]"
#: Runs of what is not a word character, white space or not.
GAP = r"[^\p{L}\p{N}_]+"
#: The white space of SPACE, one by one.
SPACES = "".join(map(chr, [*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
NAG = r"\$\p{Nd}+"
MARKUP = r"\[%([a-zA-Z]+)[^\]]*\]"
TOKEN = "[a-z0-9']+"
MODES = ("raw", "lower_ws", "punct_light", "nag_stripped")

#: Words that carry no topic.
STOP_WORDS = ("a", "an", "and", "as", "at", "be", "by", "for", "from", "in", "into", "is", "it", "of", "on", "or", "the", "to", "with")


def text_of(column) -> Column:
    return F.coalesce(column if isinstance(column, Column) else F.col(column), F.lit(""))


def strip(column: Column) -> Column:
    return F.trim(column, F.lit(SPACES))


def collapse(column: Column) -> Column:
    return F.trim(F.regexp_replace(column, f"{SPACE}+", " "))


def normalize(column, mode: str) -> Column:
    """One of the views under which texts count as equal; null counts as empty."""
    text = text_of(column)
    if mode == "raw":
        return strip(text)
    if mode == "lower_ws":
        return collapse(F.lower(text))
    if mode == "nag_stripped":
        text = F.regexp_replace(text, NAG, " ")
    elif mode != "punct_light":
        raise ValueError(f"unknown mode: {mode}")
    return F.trim(F.regexp_replace(F.lower(text), GAP, " "))  # punctuation and white space become single spaces at once


def strip_markup(column) -> Column:
    return collapse(F.regexp_replace(text_of(column), MARKUP, " "))


def template(column) -> Column:
    return normalize(F.regexp_replace(text_of(column), MARKUP, " "), "punct_light")


def markup_tags(column: Column) -> Column:
    return F.transform(F.regexp_extract_all(column, F.lit(MARKUP), F.lit(1)), lambda x: F.lower(x))


def markup_characters(column: Column) -> Column:
    """How many characters of the text are markup."""
    return F.length(column) - F.length(F.regexp_replace(column, MARKUP, ""))


def tokens(column: Column) -> Column:
    return F.regexp_extract_all(F.lower(column), F.lit(TOKEN), F.lit(0))


def topic_tokens(column: Column) -> Column:
    return F.filter(tokens(column), lambda x: (F.length(x) > 1) & ~x.isin(*STOP_WORDS))


def diversity(words: Column) -> Column:
    return F.when(F.size(words) > 0, F.size(F.array_distinct(words)) / F.size(words)).otherwise(0.0)


def slug(column, kept: str = "a-z0-9._:@/-", empty: str = "unknown") -> Column:
    """Lower case, other characters than ``kept`` as single underscores, none at the ends."""
    text = F.regexp_replace(F.regexp_replace(F.lower(strip(text_of(column))), f"{SPACE}+", "_"), f"[^{kept}]+", "_")
    text = F.regexp_replace(F.regexp_replace(text, "_+", "_"), "^_+|_+$", "")
    return F.when(text == "", empty).otherwise(text)


def domain(column) -> Column:
    """The host of an address, or a bare domain up to its first slash, without ``www.``; null where there is none."""
    text = F.lower(strip(text_of(column)))
    host = F.when(text.contains("://"), F.regexp_extract(text, "^[a-z][a-z0-9+.-]*://([^/?#]*)", 1)).otherwise(text)
    host = F.substring_index(F.regexp_replace(host, "^www\\.", ""), "/", 1)
    return F.when(host.contains(".") & ~host.contains(" "), host)


def clip(column, most: int) -> Column:
    text = collapse(text_of(column))
    return F.when(F.length(text) > most, F.concat(F.rtrim(F.substring(text, 1, most - 3)), F.lit("..."))).otherwise(text)


def split_list(column: Column) -> Column:
    """Values between commas or white space, without empty ones."""
    text = strip(text_of(column))
    only_commas = text.contains(",") & ~text.rlike(SPACE)
    parts = F.when(only_commas, F.split(text, ",")).otherwise(F.split(F.regexp_replace(text, ",", " "), f"{SPACE}+"))
    return F.filter(F.transform(parts, strip), lambda x: x != "")


def chat_role(column) -> Column:
    role = F.lower(strip(text_of(column)))
    return F.when(role.isin("human", "user", "prompt"), "user").when(role.isin("assistant", "gpt", "model", "bot"), "assistant").otherwise(role)


def spaced_tag(column: Column) -> Column:
    return F.lower(F.replace(F.regexp_replace(column, "([a-z])([A-Z])", "$1 $2"), F.lit("_"), F.lit(" ")))


def option_map(column: Column) -> Column:
    """``A: x || B: y`` as a map; a later key wins."""
    parts = F.filter(F.transform(F.split(column, r"\|\|"), strip), lambda x: x.contains(":"))
    pairs = F.transform(parts, lambda x: F.struct(strip(F.substring_index(x, ":", 1)).alias("key"), strip(F.regexp_replace(x, "^[^:]*:", "")).alias("value")))
    last = F.filter(pairs, lambda x, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda y: y["key"] == x["key"]))
    return F.map_from_entries(last)


def between(column: Column, start: str, ends: list[str]) -> Column:
    """What follows ``start`` until the nearest of ``ends``; null without ``start``."""
    rest = F.when(column.contains(start), F.regexp_replace(column, "(?s)^.*?\\Q" + start + "\\E", ""))
    return F.regexp_replace(rest, "(?s)(" + "|".join("\\Q" + e + "\\E" for e in ends) + ").*$", "") if ends else rest


# How prompts quote a position and name their moves, and the letters of the options.
QUOTED_POSITION = r'FEN[^"]*"([^"]+)"'
NAMED_MOVE = r"Move[A-Z]:([a-h][1-8][a-h][1-8][nbrq]?)"
OPTIONS = ("A", "B", "C", "D")


def quoted_position(column) -> Column:
    """The position that a prompt quotes; null where there is none."""
    found = strip(F.regexp_extract(text_of(column), QUOTED_POSITION, 1))
    return F.when(found != "", found)


def named_moves(column) -> Column:
    """The moves that a prompt names, each once, in their order."""
    return F.array_distinct(F.regexp_extract_all(text_of(column), F.lit(NAMED_MOVE), F.lit(1)))


def preferred_option(column) -> Column:
    """X of ``MoveX:...`` at the start of an answer."""
    found = F.regexp_extract(strip(text_of(column)), "^Move([^:]*):", 1)
    return F.when(found != "", found)


def option_texts(column, kind: str) -> Column:
    """``A: ... || B: ...`` with the strategy (after its first comma) or the tactic of each option; null without any."""
    text, parts = text_of(column), []
    for letter in OPTIONS:
        after = [f"Move{chr(ord(letter) + 1)}:", f"Tactic{chr(ord(letter) + 1)}:"]
        if kind == "strategy":
            part = strip(between(text, f"Move{letter}:", ["Tactic", after[0]]))
            told = F.when(part.contains(","), strip(F.regexp_replace(part, "(?s)^[^,]*,", ""))).otherwise(part)
        else:
            part = told = strip(between(text, f"Tactic{letter}:", after))
        parts.append(F.when(part != "", F.concat(F.lit(f"{letter}: "), told)))
    joined = F.concat_ws(" || ", *parts)
    return F.when(joined != "", joined)


def snippet(column, pattern: str, window: int = 120) -> Column:
    """The surroundings of the first place of ``pattern``, of any case, with white space collapsed; else the beginning."""
    text = text_of(column)
    at = F.instr(F.lower(text), pattern.lower())
    start = F.greatest(at - window // 2, F.lit(1))
    return collapse(F.when(at > 0, F.substring(text, start, at - start + len(pattern) + window // 2)).otherwise(F.substring(text, 1, window)))


def character_ids(column, vocabulary: str, length: int, unknown: int = 1) -> Column:
    """Places in ``vocabulary``, from 2, of the first ``length`` characters; others are 1, padding is 0."""
    known = F.lit("".join(dict.fromkeys(vocabulary)))
    place = lambda c: F.when(F.instr(known, c) > 0, F.instr(known, c) + 1).otherwise(unknown)
    text = F.substring(text_of(column), 1, length)
    spelt = F.filter(F.split(text, ""), lambda c: c != "")
    return F.concat(F.transform(spelt, lambda c: place(c).cast("int")), F.array_repeat(F.lit(0), F.lit(length) - F.size(spelt)))


class Sql:
    """The same rules for DuckDB."""

    @staticmethod
    def strip(x: str) -> str:
        return f"regexp_replace({x}, '^{SPACE_RE2}+|{SPACE_RE2}+$', '', 'g')"

    @staticmethod
    def collapse(x: str) -> str:
        return Sql.strip(f"regexp_replace({x}, '{SPACE_RE2}+', ' ', 'g')")

    @staticmethod
    def normalize(x: str, mode: str) -> str:
        x = Sql.strip(f"coalesce({x}, '')")
        if mode == "raw":
            return x
        x = Sql.collapse(f"lower({x})")
        if mode == "nag_stripped":
            x = f"regexp_replace({x}, '{NAG}', ' ', 'g')"
        return x if mode == "lower_ws" else Sql.collapse(f"regexp_replace({x}, '{PUNCTUATION_RE2}', ' ', 'g')")

    @staticmethod
    def strip_markup(x: str) -> str:
        stripped = Sql.strip(f"coalesce({x}, '')")
        return Sql.collapse(f"regexp_replace({stripped}, '{MARKUP}', ' ', 'g')")

    @staticmethod
    def template(x: str) -> str:
        return Sql.normalize(Sql.strip_markup(x), "punct_light")

    @staticmethod
    def tokens(x: str) -> str:
        return f"regexp_extract_all(lower({x}), '{TOKEN.replace(chr(39), chr(39) * 2)}')"

    @staticmethod
    def topic_tokens(x: str) -> str:
        words = ", ".join(f"'{w}'" for w in STOP_WORDS)
        return f"list_filter({Sql.tokens(x)}, lambda t: length(t) > 1 AND t NOT IN ({words}))"

    @staticmethod
    def diversity(x: str) -> str:
        return f"(CASE WHEN len({x}) > 0 THEN len(list_distinct({x})) / len({x}) ELSE 0.0 END)"
