"""Licence scans: pigeonhole seeds find candidate places of short notices, bounded-error matching verifies them."""

from __future__ import annotations

from bisect import bisect
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from strandmill.llm.common import slices

#: Phrase and label, found as consecutive words.
BASE_PHRASES = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))

#: Label, notice in lower case with single spaces, and the words of it that tell it from other licences.
#: Edits may fall on any other word.
NOTICES = (
    ("apache", "licensed under the apache license version 2 0", "apache 2 0"),
    ("mit", "released under the mit license", "mit"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy", "free charge any copy"),
    ("bsd", "redistribution and use in source and binary forms with or without modification", "source binary"),
    ("bsd-3-clause", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products", "neither nor endorse"),
    ("bsl", "boost software license version 1 0", "boost 1 0"),
    ("gpl", "licensed under the gnu general public license", "gnu general public"),
    ("lgpl", "gnu lesser general public license", "lesser general"),
    ("agpl", "gnu affero general public license", "affero general"),
    ("mpl", "subject to the terms of the mozilla public license", "mozilla public"),
    ("epl", "under the terms of the eclipse public license", "eclipse public"),
    ("cddl", "common development and distribution license", "development distribution"),
    ("cc", "licensed under a creative commons", "creative commons"),
    ("cc-by-nc", "licensed under cc by nc", "cc by nc"),
    ("cc-by-sa", "licensed under cc by sa", "cc by sa"),
    ("cc-by-nd", "licensed under cc by nd", "cc by nd"),
    ("cc0", "released under cc0 1 0 universal", "cc0"),
    ("public-domain", "dedicated to the public domain", "public domain"),
    ("isc", "permission to use copy modify and or distribute this software", "use copy modify distribute"),
    ("unlicense", "this is free and unencumbered software released into the public domain", "unencumbered public domain"),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable", "express implied warranty liable"),
)

RESULT = ("struct<n_words:bigint,base:array<struct<label:string,word:bigint>>,"
          "spans:array<struct<label:string,start:bigint,end:bigint,edits:int,score:double>>>")
RESULT_TYPE = pa.struct([
    ("n_words", pa.int64()),
    ("base", pa.list_(pa.struct([("label", pa.string()), ("word", pa.int64())]))),
    ("spans", pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("edits", pa.int32()), ("score", pa.float64())]))),
])


@dataclass(frozen=True)
class Seed:
    notice: int
    offset: int
    size: int


class Scanner:
    """One text at a time; built once per Python worker."""

    def __init__(self, notices=NOTICES, error_percent: int = 10):
        import ahocorasick
        import regex

        self.word = regex.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
        self.notices, self.patterns, self.edits = notices, [], []
        seeds: dict[str, list[Seed]] = {}
        self.exact = [set(words.split()) for _, _, words in notices]
        for i, (_, notice, _) in enumerate(notices):
            allowed = len(notice) * error_percent // 100
            # allowed edits touch at most as many of the pieces, so one of allowed + 1 pieces stands unchanged
            cuts = [len(notice) * j // (allowed + 1) for j in range(allowed + 2)]
            for a, b in zip(cuts, cuts[1:]):
                seeds.setdefault(notice[a:b], []).append(Seed(i, a, b - a))
            self.edits.append(allowed)
            self.patterns.append(regex.compile(rf"(?b) (?:{regex.escape(notice, literal_spaces=True)}){{e<={allowed}}} "))
        self.seeds = ahocorasick.Automaton()
        for text, where in seeds.items():
            self.seeds.add_word(text, where)
        self.seeds.make_automaton()

    def places(self, norm: str) -> list[tuple[int, int, int, int]]:
        """(start, end, edits, notice) in ``norm``, verified, without overlaps: fewest edits for the length first."""
        windows: set[tuple[int, int]] = set()
        for end, where in self.seeds.iter(norm):
            for seed in where:
                windows.add((seed.notice, end - seed.size - seed.offset - self.edits[seed.notice]))
        # each window holds one place, so a better one nearby hides no other and a search costs a notice's length
        found = set()
        for i, start in windows:
            stop = start + 2 * (self.edits[i] + 1) + len(self.notices[i][1]) + 1
            if (m := self.patterns[i].search(norm, max(0, start), min(len(norm), stop))) is not None and self.exact[i] <= set(m[0].split()):
                found.add((sum(m.fuzzy_counts), m.start() + 1, m.end() - 1, i))
        kept: list[tuple[int, int, int, int]] = []  # in order, without overlaps
        for edits, start, end, i in sorted(found, key=lambda x: (x[0] / len(self.notices[x[3]][1]), x[1] - x[2], x[1], x[3])):
            at = bisect(kept, (start,))
            if (at == 0 or kept[at - 1][1] <= start) and (at == len(kept) or end <= kept[at][0]):
                kept.insert(at, (start, end, edits, i))
        return kept

    def scan(self, text: str | None) -> dict:
        low = text or ""
        low = low.lower() if low.isascii() else low.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")
        words = self.word.findall(low)
        norm = f" {' '.join(words)} "
        base = []
        for phrase, label in BASE_PHRASES:
            at, seen, word = norm.find(f" {phrase} "), 0, 0
            while at >= 0:
                word += norm.count(" ", seen, at)
                base.append({"label": label, "word": word})
                at, seen = norm.find(f" {phrase} ", at + 1), at
        spans = []
        if places := self.places(norm):
            where = [m.span() for m in self.word.finditer(low)]
            seen, last = 0, -1
            for start, end, edits, i in places:
                first = last + norm.count(" ", seen, start)
                seen, last = end, first + norm.count(" ", start, end)
                label, notice, _ = self.notices[i]
                spans.append({"label": label, "start": where[first][0], "end": where[last][1], "edits": edits, "score": 1 - edits / len(notice)})
        return {"n_words": len(words), "base": base, "spans": spans}


def scan_licenses(docs: DataFrame, text: str = "text", into: str = "license_scan", notices=NOTICES, error_percent: int = 10) -> DataFrame:
    """``docs`` with a struct ``into``: word count, base phrases and verified notice spans (code points of the text).

    A null text counts as empty. Texts are scanned whole, one row at a time in Arrow batches, with one automaton per
    worker; nothing is shuffled. Equal texts get equal results; an empty table gives an empty one; a column that has
    the name of ``into`` is replaced.
    """
    @arrow_udf(RESULT)
    def scan(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        scanner = Scanner(notices, error_percent)
        for batch in slices(batches):
            yield pa.array([scanner.scan(x.as_py()) for x in batch], RESULT_TYPE)

    return docs.withColumn(into, scan(F.col(text).cast("string")))


def op2_license_scans(spark, sf_dir):
    from strandmill.llm.common import table

    found = scan_licenses(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "license_scan.*")
    base = F.array_sort(F.array_distinct("base.label"))
    return found.select(
        "doc_id", "n_words", F.size("base").cast("long").alias("n_base"),
        F.array_min("base.word").alias("first_word"), F.array_max("base.word").alias("last_word"),
        F.array_join(base, ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_distinct(F.concat("base.label", "spans.label"))), ",").alias("labels"),
        F.greatest(F.when(F.size("base") > 0, 1.0).otherwise(0.0), F.coalesce(F.array_max("spans.score"), F.lit(0.0))).alias("score"),
        F.size("spans").cast("long").alias("n_spans"),
    )
