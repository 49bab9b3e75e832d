"""Fill-in-the-middle: a table-driven byte DFA counts a text's units and finds sentinels, a second pass locates the cuts.

A unit is a run of ASCII letters or any other character. The DFA reads bytes: continuation bytes of UTF-8 start nothing,
a letter after a letter starts no unit, and ``<``, a letter of the sentinels, ``>`` in a row complete a sentinel. A
transition emits what it starts or completes. What state the DFA is in depends on the three bytes before, so a buffer is
read in lanes side by side, each from three bytes before its start: one table look-up moves all lanes by a byte.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from strandmill.llm.common import text_slices

#: The sentinels before prefix, suffix and middle; each is ``<``, a letter, ``>``.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Counted by a transition: a unit starts, a character starts, a sentinel is complete.
UNIT, CHARACTER, SENTINEL = 1, 2, 4
OTHER, LETTER, MARK, OPEN, CLOSE, REST = range(6)
GROUND, IN_LETTERS, OPENED, MARKED = range(4)


def tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte classes, and next state and emission of each (state, class); classes from 6 on are first bytes of a text,
    which are read from the ground state whatever came before."""
    classes = np.full(256, OTHER, np.uint8)
    classes[np.r_[ord("A"):ord("Z") + 1, ord("a"):ord("z") + 1]] = LETTER
    classes[[ord(s[1]) for s in (PREFIX, SUFFIX, MIDDLE)]] = MARK
    classes[ord("<")], classes[ord(">")] = OPEN, CLOSE
    classes[0x80:0xC0] = REST
    moves, emits = np.zeros((4, 12), np.uint8), np.zeros((4, 12), np.uint8)
    for state in range(4):
        for c in range(12):
            kind, at = c % 6, GROUND if c >= 6 else state
            letter, inside = kind in (LETTER, MARK), at in (IN_LETTERS, MARKED)
            moves[state, c] = OPENED if kind == OPEN else MARKED if kind == MARK and at == OPENED else IN_LETTERS if letter else GROUND
            emits[state, c] = 0 if kind == REST else CHARACTER | (0 if letter and inside else UNIT) | (SENTINEL if kind == CLOSE and at == MARKED else 0)
    return classes, moves, emits


CLASSES, MOVES, EMITS = tables()


def scan(data: np.ndarray, starts: np.ndarray, lane: int = 0) -> np.ndarray:
    """What each byte's transition emits, for a buffer of texts that begin at ``starts``; ``lane`` bytes are read in a row."""
    n, back = len(data), 3
    lane = lane or max(32, min(4096, int(n**0.5)))
    kinds = np.zeros(-(-n // lane) * lane + back, np.uint8)
    kinds[back:back + n] = CLASSES[data]
    kinds[back + starts[starts < n]] += 6
    lanes = (len(kinds) - back) // lane
    # row i holds byte i - 3 of every lane, so rows below 3 are the last bytes of the lanes before
    steps = np.lib.stride_tricks.as_strided(kinds, (lane + back, lanes), (1, lane))
    found, at = np.empty((lane, lanes), np.uint8), np.zeros(lanes, np.intp)
    moves, emits = (MOVES.astype(np.intp) * 12).ravel(), EMITS.ravel()
    for i in range(lane + back):
        at += steps[i]
        if i >= back:
            np.take(emits, at, out=found[i - back], mode="clip")
        at = np.take(moves, at, mode="clip")
    return np.ascontiguousarray(found.T).ravel()[:n]


class Counted:
    """Running counts of one emission over a buffer, kept at every ``block`` bytes: positions and counts in bounded memory."""

    def __init__(self, found: np.ndarray, bit: int, block: int = 1024):
        self.found, self.bit, self.block = found, bit, block
        padded = np.zeros(-(-max(1, len(found)) // block) * block, bool)
        np.not_equal(found & bit, 0, out=padded[:len(found)])
        self.before = np.concatenate(([0], np.cumsum(padded.reshape(-1, block).sum(1))))

    def upto(self, at: int) -> int:
        """How many there are before byte ``at``."""
        b = at // self.block
        return int(self.before[b]) + int(np.count_nonzero(self.found[b * self.block:at] & self.bit))

    def place(self, k: int) -> int:
        """The byte of the one with ``k`` before it."""
        b = int(np.searchsorted(self.before, k, "right")) - 1
        return b * self.block + int(np.flatnonzero(self.found[b * self.block:(b + 1) * self.block] & self.bit)[k - self.before[b]])


CUTS = pa.struct([("n", pa.int64()), ("sentinel", pa.bool_()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64())])


def cut_buffer(data: np.ndarray, offsets: np.ndarray, first: np.ndarray, second: np.ndarray) -> list[dict]:
    """Units and cuts of the texts between ``offsets``; ``first`` and ``second`` are taken modulo one more than a text's units."""
    found = scan(data, offsets[:-1])
    units, characters, sentinels = (Counted(found, bit) for bit in (UNIT, CHARACTER, SENTINEL))
    out = []
    for i in range(len(offsets) - 1):
        a, b = int(offsets[i]), int(offsets[i + 1])
        before, chars = units.upto(a), characters.upto(a)
        n = units.upto(b) - before
        cuts = sorted((int(first[i]) % (n + 1), int(second[i]) % (n + 1)))
        head, tail = (characters.upto(units.place(before + k) if k < n else b) - chars for k in cuts)
        out.append({"n": n, "sentinel": sentinels.upto(b) > sentinels.upto(a), "prefix_chars": head, "middle_chars": tail - head})
    return out


def cuts(text: Column, first: Column, second: Column) -> Column:
    """Struct of a text's number of units, whether it has a sentinel, and the characters of prefix and middle."""
    @arrow_udf("struct<n:bigint,sentinel:boolean,prefix_chars:bigint,middle_chars:bigint>")
    def of(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for texts, a, b in batches:
            out, at = [], 0
            for part in text_slices(texts):
                part = part.cast(pa.large_string())
                _, offsets, data = part.buffers()
                offsets = np.frombuffer(offsets, np.int64)[part.offset:part.offset + len(part) + 1]
                whole = np.frombuffer(data, np.uint8)[offsets[0]:offsets[-1]] if data else np.zeros(0, np.uint8)
                out += cut_buffer(whole, offsets - offsets[0], *(x.slice(at, len(part)).to_numpy(zero_copy_only=False) for x in (a, b)))
                at += len(part)
            yield pa.array(out, CUTS)

    return of(text, first, second)


def draws(key: Column, seed: str) -> list[Column]:
    """The first four 8-digit groups of the hex sha256 of seed and key, as longs."""
    digest = F.sha2(F.concat(F.lit(seed), F.coalesce(key.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]


def fill_in_middle(docs: DataFrame, key: str = "doc_id", text: str = "text", seed: str = "1:", plain_from: int = 90, spm_below: int = 20) -> DataFrame:
    """``key, n, form, prefix_chars, middle_chars, output``: each text cut in three at two drawn units, and rearranged.

    Form: ``plain`` (the text as it is) where it is empty, has a sentinel or is drawn so, else ``spm`` (suffix, prefix,
    middle) or ``psm``. The draws depend on the key alone, so repeated keys are drawn alike; a null key draws as an empty
    one, a null text is an empty one, an empty table gives an empty one. Texts are read whole where they lie, nothing is
    shuffled; other columns don't matter.
    """
    a, b, c, d = draws(F.col("key"), seed)
    read = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    found = read.select("key", "text", cuts(F.col("text"), a, b).alias("cut"), c.alias("c"), d.alias("d"))
    plain = (F.col("text") == "") | F.col("cut.sentinel") | (F.col("c") % 100 >= plain_from)
    form = F.when(plain, "plain").when(F.col("d") % 100 < spm_below, "spm").otherwise("psm")
    head, middle = F.col("cut.prefix_chars").cast("int"), F.col("cut.middle_chars").cast("int")
    parts = found.select("key", F.col("cut.n").alias("n"), form.alias("form"), "cut", "text",
                         F.substring("text", F.lit(1), head).alias("prefix"), F.substring("text", head + 1, middle).alias("middle"),
                         F.substring("text", head + middle + 1, F.length("text")).alias("suffix"))
    output = (F.when(F.col("form") == "plain", F.col("text"))
              .when(F.col("form") == "psm", F.concat(F.lit(PREFIX), "prefix", F.lit(SUFFIX), "suffix", F.lit(MIDDLE), "middle"))
              .otherwise(F.concat(F.lit(SUFFIX), "suffix", F.lit(PREFIX), "prefix", F.lit(MIDDLE), "middle")))
    cut = F.col("form") != "plain"
    return parts.select(F.col("key").alias(key), "n", "form", F.when(cut, F.col("cut.prefix_chars")).alias("prefix_chars"),
                        F.when(cut, F.col("cut.middle_chars")).alias("middle_chars"), output.alias("output"))


def restored(output: Column, form: Column) -> Column:
    """The text that ``output`` was made of, in the three parts' first order.

    A rearranged text has no sentinel, and no sentinel begins inside another, so the first of each kind is the one put there.
    """
    def after(text: Column, mark: str) -> Column:
        return F.substring(text, F.instr(text, F.lit(mark)) + len(mark), F.length(text))

    def before(text: Column, mark: str) -> Column:
        return F.substring(text, F.lit(1), F.instr(text, F.lit(mark)) - 1)

    head, tail = before(output, MIDDLE), after(output, MIDDLE)
    psm = F.concat(before(after(head, PREFIX), SUFFIX), tail, after(head, SUFFIX))
    spm = F.concat(after(head, PREFIX), tail, before(after(head, SUFFIX), PREFIX))
    return F.when(form == "plain", output).when(form == "psm", psm).otherwise(spm)


def op11_fill_in_middle(spark, sf_dir):
    from strandmill.llm.common import table

    made = fill_in_middle(table(spark, sf_dir, "documents"))
    digest = lambda x: F.sha2(x.cast("binary"), 256)
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"),
                       digest(restored(F.col("output"), F.col("form"))).alias("restored_sha256"))


def oracle_sql() -> str:
    h = lambda i: f"('0x' || substr(sha256('1:' || doc_id), {8 * i + 1}, 8))::BIGINT"
    return f"""
WITH units AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u,
         {h(0)} AS h1, {h(1)} AS h2, {h(2)} AS h3, {h(3)} AS h4 FROM documents
), places AS (
  SELECT *, len(u)::BIGINT AS n, least(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS a, greatest(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS b,
         CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain'
              WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM units
), parts AS (
  SELECT *, coalesce(array_to_string(u[1:a], ''), '') AS p, coalesce(array_to_string(u[a + 1:b], ''), '') AS m, coalesce(array_to_string(u[b + 1:], ''), '') AS s FROM places
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM parts"""
