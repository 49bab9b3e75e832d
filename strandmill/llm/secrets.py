"""Secret scans: assignments lexed into name-literal pairs, constants propagated, literals scored by target names."""

from __future__ import annotations

import math
import re
from bisect import bisect
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from strandmill.llm.common import slices
from strandmill.llm.lexing import LOGIN, Target, read

#: Kinds in the order of ties; the first three are the base.
KINDS = ("assign", "access", "hex", "literal")

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
HEX = re.compile(r"[0-9a-f]{32,}")

#: Parts of names that make a target sensitive, and how much.
NAME_WEIGHTS = (
    ("password", 1.0), ("passwd", 1.0), ("passphrase", 1.0), ("pwd", 0.9), ("secret", 1.0), ("token", 0.9),
    ("apikey", 1.0), ("accesskey", 1.0), ("privatekey", 1.0), ("signingkey", 1.0), ("encryptionkey", 1.0),
    ("credential", 0.9), ("authorization", 0.8), ("connectionstring", 0.8),
)
PLACEHOLDER = re.compile(r"^(?:x+|\*+|changeme|example\w*|your\w*|<.*>|\$\{.*\}|none|null|true|false|todo)$", re.IGNORECASE | re.ASCII)

WORD_CHARACTER = re.compile(r"\w", re.ASCII)

#: Names whose values may hold white space.
PHRASE = re.compile("pass|pwd", re.IGNORECASE)


def base_spans(text: str) -> list[tuple[int, int, str, int, int]]:
    """(start, kind's place, kind, end, start of the value), leftmost and not overlapping per kind."""
    out = [(m.start(), 0, "assign", m.end(), m.start(2)) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    out += [(m.start(), 1, "access", m.end(), m.start()) for m in ACCESS.finditer(text)] if "AKIA" in text else []
    return out + [(m.start(), 2, "hex", m.end(), m.start()) for m in HEX.finditer(text)]


def name_weight(name: str) -> float:
    plain = re.sub(r"[^a-z0-9]", "", name.lower())
    return max((w for part, w in NAME_WEIGHTS if part in plain), default=0.0)


def literal_strength(value: str, phrase: bool = False) -> float:
    """From 0 to 1: placeholders and short or uniform values are weak, long varied ones strong.

    White space makes a value worthless but for a pass phrase: three words or more, one of them with a digit or sign.
    Line ends don't count, nor do lines of dashes such as those around keys.
    """
    if "\n" in value:
        value = "".join(x.strip() for x in value.splitlines() if not x.lstrip().startswith("-----"))
    if len(value) < 8 or PLACEHOLDER.match(value):
        return 0.0
    if len(words := value.split()) > 1 or value != value.strip():
        if not phrase or len(words) < 3 or not any(not c.isalpha() for word in words for c in word):
            return 0.0
    entropy = -sum(n / len(value) * math.log2(n / len(value)) for n in Counter(value).values())
    return min(1.0, entropy / 3.0) * (1.0 if any(c.isdigit() for c in value) else 0.7)


class Endings:
    """:func:`literal_strength` of the endings of an unquoted value, which has no white space, from one pass over it.

    Names inside such a value have all of what follows as theirs, so their values are endings of one another.
    """

    def __init__(self, text: str, start: int, end: int):
        counts: Counter = Counter()
        self.text, self.start, self.end, self.plain, total = text, start, end, end, 0.0
        self.entropy = [0.0] * (end - start + 1)
        for at in range(end - 1, start - 1, -1):
            c = text[at]
            counts[c] += 1
            n, size = counts[c], end - at
            total += n * math.log2(n) - (n - 1) * math.log2(n - 1) if n > 1 else 0.0
            self.entropy[at - start] = math.log2(size) - total / size
            if self.plain == at + 1 and WORD_CHARACTER.match(c):
                self.plain = at  # from here on there are only word characters
        self.last_digit = max((i for i in range(start, end) if text[i].isdigit()), default=-1)

    def strength(self, at: int) -> float:
        if self.end - at < 256:
            return literal_strength(self.text[at:self.end])
        head, tail = self.text[at:at + 7].lower(), self.text[self.end - 1]
        if self.plain <= at + 4 and head.startswith("your") or self.plain <= at + 7 and head == "example" or head[0] == "<" and tail == ">" or head[:2] == "${" and tail == "}":
            return 0.0
        return min(1.0, self.entropy[at - self.start] / 3.0) * (1.0 if self.last_digit >= at else 0.7)


def reached(targets: list[Target]) -> list[tuple[Target, float]]:
    """Targets with the largest weight that reaches them: their own, or that of a target they are a constant of.

    Weights run from the heaviest name on through the graph of constants, so each definition is settled once and
    cycles end; where a name is defined, above or below its use, does not matter.
    """
    defined: dict[str, list[int]] = {}
    for i, target in enumerate(targets):
        if target.name:
            defined.setdefault(target.name, []).append(i)
    weights = [target.weight for target in targets]
    order = sorted((i for i, w in enumerate(weights) if w > 0), key=lambda i: -weights[i])
    done: set[str] = set()
    for start in order:
        more = [start]
        while more:
            for name in targets[more.pop()].references:
                if name not in done:
                    done.add(name)
                    for i in defined.get(name, ()):
                        weights[i] = max(weights[i], weights[start])
                        more.append(i)
    return [(target, w) for target, w in zip(targets, weights) if w > 0]


def lexed_spans(text: str, threshold: float = 0.6) -> list[tuple[int, int, str, int, int]]:
    """Literals whose name, or a name they reach through constants, is sensitive; scored name times strength."""
    plain = text.lower().replace("_", "").replace("-", "").replace(".", "")  # as name_weight sees any name in it
    if not any(part in plain for part, _ in NAME_WEIGHTS) and not LOGIN.search(text):
        return []
    best: dict[tuple[int, int], float] = {}
    weigh = lru_cache(4096)(name_weight)
    for targets in read(text, weigh):
        constants = {x.name for x in targets if x.literals and len(x.name) >= 8}
        longest = max(map(len, constants), default=0)
        endings: dict[int, Endings] = {}
        found = reached(targets)
        lowest: dict[int, int] = {}
        for target, _ in found:
            for a, b in target.literals if target.inner else ():
                lowest[b] = min(a, lowest.get(b, a))
        for target, weight in found:
            phrase = PHRASE.search(target.name) is not None
            if target.inner:
                for a, b in target.literals:
                    if b not in endings:
                        endings[b] = Endings(text, lowest[b], b)
                    known = b - a <= longest and text[a:b] in constants
                    if b > a and not known and (score := weight * endings[b].strength(a)) >= threshold:
                        best[a, b] = max(score, best.get((a, b), 0.0))
                continue
            values = [text[a:b] for a, b in target.literals]
            whole = literal_strength("".join(values), phrase) if len(values) > 1 else 0.0  # concatenations are folded
            for span, value in zip(target.literals, values):
                score = weight * max(whole, literal_strength(value, phrase)) if value not in constants else 0.0
                if score >= threshold and value:
                    best[span] = max(score, best.get(span, 0.0))
    out, last = [], -1
    for start, end in sorted(best, key=lambda x: (x[0], -x[1])):  # of spans inside another the outer one is enough
        if end > last:
            out.append((start, 3, "literal", end, start))
            last = end
    return out


def find_secrets(text: str | None, threshold: float = 0.6) -> list[tuple[int, int, str, int, int]]:
    """All spans of a text in order; lexed ones only where no base span covers them."""
    text = text or ""
    base = sorted(base_spans(text))
    reach = list(accumulate((x[3] for x in base), max))  # how far the spans up to each one go
    more = [x for x in lexed_spans(text, threshold) if not ((i := bisect(base, x[0], key=lambda y: y[0])) and x[3] <= reach[i - 1])]
    return sorted(base + more)


def redacted(text: str, spans: list[tuple[int, int, str, int, int]], mark: str = "[REDACTED]") -> str:
    """``text`` with the value of every span replaced; overlapping spans by one mark."""
    out, at = [], 0
    for start, end in sorted((value, end) for _, _, _, end, value in spans):
        if start >= at:
            out += [text[at:start], mark]
        at = max(at, end)
    return "".join([*out, text[at:]])


SPANS = "array<struct<kind:string,start:bigint,end:bigint>>"
SPANS_TYPE = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def scan_secrets(docs: DataFrame, text: str = "text", into: str = "secrets", threshold: float = 0.6) -> DataFrame:
    """``docs`` with ``into``, the spans found (kind, start, end; code points, end exclusive), ordered by start and kind.

    Row by row over whole texts, nothing is shuffled; a null text has no span, equal texts get equal spans, an empty
    table stays empty, and a column with the name of ``into`` is replaced.
    """
    @arrow_udf(SPANS)
    def scan(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in slices(batches):
            yield pa.array([[{"kind": k, "start": a, "end": b} for a, _, k, b, _ in find_secrets(x.as_py(), threshold)] for x in batch], SPANS_TYPE)

    return docs.withColumn(into, scan(F.col(text).cast("string")))


def redact(docs: DataFrame, text: str = "text", threshold: float = 0.6, mark: str = "[REDACTED]") -> DataFrame:
    """``docs`` with the secrets in ``text`` replaced by ``mark``; null texts stay null, clean texts stay as they are."""
    @arrow_udf("string")
    def clean(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in slices(batches):
            yield pa.array([x and redacted(x, find_secrets(x, threshold), mark) for x in batch.to_pylist()], pa.string())

    return docs.withColumn(text, clean(F.col(text).cast("string")))


def op8_secret_scans(spark, sf_dir):
    from strandmill.llm.common import table

    found = scan_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"))
    joined = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    of = lambda kind: F.size(F.filter("secrets", lambda x: x["kind"] == kind)).cast("long")
    base = F.filter("secrets", lambda x: x["kind"].isin(*KINDS[:3]))
    return found.select("doc_id", of("assign").alias("n_assign"), of("access").alias("n_access"), of("hex").alias("n_hex"),
                        F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("secrets")).alias("spans"))
