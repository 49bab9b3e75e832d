"""Lexing of source and configuration text into targets and the parts of the values they take.

``tokens`` knows comments, quotes with escapes, triple quotes, brackets and line ends. ``Reading`` walks them once and
notes for every target (assignment, mapping entry, attribute, keyword argument, option, default of a lookup) the
literals and names in its value. A target inside a bracket or an indented block weighs as much as the names above it.
Every step costs time in proportion to the text, whatever it leaves unbalanced.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable
from typing import NamedTuple

Span = tuple[int, int]


class Token(NamedTuple):
    kind: str  # string, word, op, open, close, mark, line
    start: int
    end: int
    inner: Span  # of a string, without its quotes


TOKEN = re.compile(r"""
    (?P<escape>\\.)
  | (?P<block>/\*|<!--)
  | (?P<triple>\"{3}|'{3})
  | (?P<comment>(?:(?<=\s)|(?<![\s\S]))(?:\#|//)|(?:(?<=\n)|(?<![\s\S]));)
  | (?P<string>"(?:[^"\\\n]|\\.)*+"|(?:(?<![A-Za-z0-9])|(?<=(?<![A-Za-z0-9_])[rbfuRBFU]))'(?:[^'\\\n]|\\.)*+'|`[^`\n]*+`)
  | (?P<op>:=|=>|==|=|::|:)
  | (?P<word>\|\||[A-Za-z0-9_+/.~!@%^*?$\#-]++)
  | (?P<open>[(\[{]|<(?=[A-Za-z/?!]))
  | (?P<close>[)\]}>])
  | (?P<mark>[,;&|<])
  | (?P<line>\n)
""", re.VERBOSE | re.ASCII | re.DOTALL)
CLOSING = {"/*": "*/", "<!--": "-->", '"""': '"""', "'''": "'''"}
OPENING = {")": "(", "]": "[", "}": "{", ">": "<"}
#: A path of names, as targets and references have them.
NAME = re.compile(r"[$]?[A-Za-z_][A-Za-z0-9_.-]*", re.ASCII)
PLAIN = re.compile(r"[$]?[A-Za-z_][A-Za-z0-9_.]*", re.ASCII)
DIGIT = re.compile("[0-9]")
#: Name and value inside a string, such as a connection text or an address, and the login of an address.
INSIDE = re.compile(r"(?<![A-Za-z0-9_.-])([A-Za-z_][A-Za-z0-9_.-]*+)\x20?=([^;&\s\"']+)", re.ASCII)
LOGIN = re.compile(r"://[^/\s:@]*+:([^/\s@]++)@", re.ASCII)
# What joins or replaces values, what may stand before one, calls that look a name up, keys that name a value.
JOINS = ("+", ".", "||", "or", "??")
SCHEMES = ("bearer", "basic", "token", "digest")
LOOKUP = re.compile(r"(?:get|env|environ|read|load|open|find|fetch|lookup|config|param|prompt|input|print|log|info|warn|error|debug|format)\w*$", re.IGNORECASE)
NAMING = ("key", "name", "id")


def tokens(text: str, start: int, end: int, comments: list[Span] | None) -> list[Token]:
    """Tokens of a stretch; comments go to the list, or are read as text if there is none."""
    out, at, missing = [], start, set()
    while at < end and (m := TOKEN.search(text, at, end)):
        kind, at = m.lastgroup, m.end()
        if kind in ("block", "triple"):
            close = CLOSING[m[0]]
            stop = -1 if close in missing else text.find(close, at, end)
            if stop < 0:
                missing.add(close)
            elif kind == "triple":
                out.append(Token("string", m.start(), stop + 3, (at, stop)))
                at = stop + 3
            else:
                if comments is not None:
                    comments.append((at, stop))
                    at = stop + len(close)
        elif kind == "comment":
            if comments is not None:
                stop = text.find("\n", at, end)
                stop = end if stop < 0 else stop
                comments.append((at, stop))
                at = stop
        elif kind != "escape":
            out.append(Token(kind, m.start(), at, (m.start() + 1, at - 1)))
    return out


class Target(NamedTuple):
    name: str
    weight: float
    literals: list[Span]
    references: list[str]
    inner: bool  # inside an unquoted value


class Level:
    """What stands above a token: a bracket, or a block that is indented deeper than ``indent``."""

    def __init__(self, weight: float, opener: str = "", indent: int | None = None, call: str | None = None, resume: tuple[str, float] | None = None):
        self.weight, self.opener, self.indent, self.call, self.resume = weight, opener, indent, call, resume
        self.named: str | None = None  # the name that the next value belongs to
        self.waiting: list[Span] = []  # literals of ``value`` that came before their name


class Reading:
    """The targets of a stretch of text; ``weigh`` says how sensitive a name is."""

    def __init__(self, text: str, weigh: Callable[[str], float], start: int, end: int, comments: list[Span] | None):
        self.text, self.weigh, self.end = text, weigh, end
        self.list, self.targets = tokens(text, start, end, comments), []
        self.levels, self.openers, self.i, self.until = [Level(0.0)], Counter(), 0, 0
        # where a run of touching words and operators ends that starts at a token
        n = len(self.list)
        self.run = list(range(1, n + 1))
        for i in range(n - 2, -1, -1):
            if self.list[i + 1].kind in ("word", "op") and self.list[i].end == self.list[i + 1].start:
                self.run[i] = self.run[i + 1]
        while self.i < n:
            self.step()

    def kind(self, i: int) -> str:
        return self.list[i].kind if 0 <= i < len(self.list) else "end"

    def of(self, i: int) -> str:
        return self.text[self.list[i].start:self.list[i].end] if 0 <= i < len(self.list) else ""

    def quoted(self, i: int) -> str:
        return self.text[slice(*self.list[i].inner)]

    def touching(self, i: int) -> bool:
        return 0 < i < len(self.list) and self.list[i - 1].end == self.list[i].start

    def note(self, name: str, weight: float, literals=(), references=(), inner: bool = False) -> None:
        if literals or references:
            self.targets.append(Target(name, max(weight, self.weigh(name)), list(literals), list(references), inner))

    def name(self, i: int) -> str | None:
        """The name that a token before an operator is."""
        if self.kind(i) == "close" and self.of(i) == "]" and self.kind(i - 1) == "string":
            found = self.quoted(i - 1)
        elif self.kind(i) == "string":
            found = self.quoted(i)
        else:
            found = self.text[self.list[i].start:self.list[i].end].rpartition("?")[2].lstrip("-+!@*")
        return found if NAME.fullmatch(found) else None

    def step(self) -> None:
        here, kind = self.i, self.list[self.i].kind
        self.i += 1
        if kind == "line":
            self.new_line(here)
        elif kind == "open":
            self.enter(here, self.levels[-1].weight)
        else:
            if kind == "close":
                self.leave(self.of(here))
                if self.i != here + 1:
                    return
            if kind in ("string", "word", "close") and self.of(self.i) in ("=", ":", ":=", "=>") and (name := self.name(here)):
                self.i += 1
                self.take(name, self.of(here + 1))
            elif kind == "string":
                self.element(here)
            elif kind == "word":
                level = self.levels[-1]
                if level.indent is not None and level.weight and self.kind(here + 1) in ("line", "end") and (self.kind(here - 1) == "line" or self.of(here - 1) == "-"):
                    self.note("", level.weight, [(self.list[here].start, self.list[here].end)])
                elif self.of(here).startswith("--") and self.kind(here + 1) in ("word", "string") and not self.of(here + 1).startswith("-") and (name := self.name(here)):
                    self.take(name, " ")

    def new_line(self, here: int) -> None:
        """A block ends at a line that is indented no deeper than the one that opened it; blank lines end none."""
        following = self.list[here + 1] if here + 1 < len(self.list) else None
        if following is not None and following.kind != "line":
            deep = following.start - self.list[here].end + (self.of(here + 1) == "-")
            while self.levels[-1].indent is not None and deep <= self.levels[-1].indent:
                self.levels.pop()

    def enter(self, here: int, weight: float, resume: tuple[str, float] | None = None) -> None:
        called = self.of(here - 1) if self.of(here) in ("(", "[") and self.kind(here - 1) == "word" and self.touching(here) else None
        self.levels.append(Level(weight, self.of(here), call=called, resume=resume))
        self.openers[self.of(here)] += 1

    def leave(self, closing: str) -> None:
        opener = OPENING[closing]
        if not self.openers[opener] or closing == ">" and self.levels[-1].opener != "<":
            return
        while True:
            level = self.levels.pop()
            self.openers[level.opener] -= 1
            if level.opener == opener:
                break
        if level.resume and self.of(self.i) in JOINS:  # a value goes on behind its bracket
            self.i += 1
            self.value(*level.resume)

    def element(self, here: int) -> None:
        """A string that stands alone: part of what is above it, an argument, or the value of an argument before it."""
        level, t = self.levels[-1], self.list[here]
        if level.call is not None and level.named:
            self.note(level.named, level.weight, [t.inner])
        elif level.call is not None:
            level.named = self.quoted(here) if NAME.fullmatch(self.text, *t.inner) else None
            if level.weight and not LOOKUP.search(level.call) and level.opener == "(":
                self.note("", level.weight, [t.inner])
        elif level.weight:
            self.note("", level.weight, [t.inner])
        self.inside(t)

    def inside(self, t: Token) -> None:
        for m in INSIDE.finditer(self.text, *t.inner):
            self.note(m[1], 0.0, [m.span(2)])
        for m in LOGIN.finditer(self.text, *t.inner):
            self.note("password", 0.0, [m.span(1)])

    def take(self, name: str, op: str) -> None:
        level, first, literals = self.levels[-1], self.i, []
        weight = max(level.weight, self.weigh(name))
        last = name.lower().rpartition(".")[2]
        if last == "value" and level.named:
            weight = max(weight, self.weigh(level.named))
        block = self.of(first) in ("|", ">", "|-", ">-", "|+") and self.kind(first + 1) == "line"
        if op == ":" and (block or self.kind(first) == "line"):
            self.levels.append(Level(weight, indent=self.indent(self.list[first - 2].start)))
            if block:
                self.text_block(name, weight)
            return
        while self.kind(self.i) == "line" and op in ("=", ":=", "=>"):
            self.i += 1
        literals = self.value(name, weight, op)
        if last in NAMING and len(literals) == 1 and level.opener in ("<", "{"):
            level.named = self.text[slice(*literals[0])]
            for span in level.waiting:
                self.note(level.named, 0.0, [span])
            level.waiting = []
        elif last == "value" and not level.named:
            level.waiting += literals

    def value(self, name: str, weight: float, op: str = "") -> list[Span]:
        """Notes the literals and names of a value, from the token at hand on, and gives the literals."""
        literals, references, inner = [], [], False
        while True:
            here = self.i
            kind = self.kind(here)
            if kind == "string":
                literals.append(self.list[here].inner)
                self.inside(self.list[here])
                self.i += 1
            elif kind == "open" and self.of(here) != "<":
                self.enter(here, weight, (name, weight))
                self.i += 1
                break
            elif kind == "word":
                if self.of(here).lower() in SCHEMES and self.kind(here + 1) == "word" and not self.touching(here + 1):
                    here = self.i = here + 1
                if self.kind(here + 1) == "string" and self.touching(here + 1) and len(self.of(here)) in (1, 2):
                    self.i += 1  # the prefix of a string
                    continue
                start, stop = self.list[here].start, self.run[here]
                end, inner = self.list[stop - 1].end, start < self.until
                plain = PLAIN.fullmatch(self.text, start, end) is not None
                then = self.of(stop) if self.touching(stop) else ""
                if then in ("(", "[") and plain:
                    self.i = stop
                    self.enter(stop, weight, (name, weight))
                    self.i += 1
                    break
                if plain and self.of(stop) in ("=", ":=") and then == "":  # a type, or a target in a chain
                    if op == ":":
                        self.i, op = stop + 1, "="
                        continue
                    references.append(self.text[start:end])
                    break
                if PLAIN.match(self.text, start):  # names inside an unquoted value refer to what touches them up to the next operator
                    references += [x.strip(".").lstrip("$") for x in self.text[start:self.list[here].end if inner else end].split("+") if PLAIN.fullmatch(x)]
                if not plain or DIGIT.search(self.text, start, end):
                    literals.append((start, end))
                self.i = stop
                if op == ":":
                    self.phrase(name, weight, start)
                if stop - here > 1:
                    self.until, self.i = max(self.until, end), here  # names in it are targets of their own
                    break
            else:
                break
            if self.kind(self.i) == "word" and self.of(self.i) in JOINS:
                self.i += 1
            elif self.kind(self.i) != "string":
                break
        self.note(name, weight, literals, references, inner)
        return literals

    def phrase(self, name: str, weight: float, start: int) -> None:
        """Words up to the end of a line are one value more; it counts for names of passwords."""
        last = self.i
        while self.kind(last) == "word":
            last += 1
        if last > self.i and self.kind(last) in ("line", "end"):
            self.note(name, weight, [(start, self.list[last - 1].end)])

    def indent(self, at: int) -> int:
        """How deep the line of a key lies that ends it; at most one key of a line does, so lines are read once."""
        line = self.text[self.text.rfind("\n", 0, at) + 1:at]
        return len(line) - len(line.lstrip(" \t-"))

    def text_block(self, name: str, weight: float) -> None:
        """The lines of an indented text are the parts of one value."""
        deep, spans, at = self.levels[-1].indent, [], self.list[self.i + 1].end
        while at < self.end:
            stop = self.text.find("\n", at, self.end)
            stop = self.end if stop < 0 else stop
            line = self.text[at:stop]
            if body := line.strip():
                if len(line) - len(line.lstrip(" \t")) <= deep:
                    break
                low = at + line.index(body)
                spans.append((low, low + len(body)))
            at = stop + 1
        self.note(name, weight, spans)
        while spans and self.i < len(self.list) and self.list[self.i].start < spans[-1][1]:
            self.i += 1


def read(text: str, weigh: Callable[[str], float]) -> list[list[Target]]:
    """The targets of a text, and those of each of its comments, which define nothing outside of it."""
    comments: list[Span] = []
    found = [Reading(text, weigh, 0, len(text), comments).targets]
    return found + [targets for low, high in comments if (targets := Reading(text, weigh, low, high, None).targets)]
