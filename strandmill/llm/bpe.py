"""BPE encoding and decoding: a trie of distinct words, traversed depth first with the last token of every prefix.

The first tokens of an encoding are themselves the encoding of what they spell, so a prefix is known by its last token
and by the prefix before that token. The last token of a prefix is the one token at its end that does not merge across
the boundary to the last token of what lies before. One step per node of the trie finds it, and words with a common
prefix share these steps.
"""

from __future__ import annotations

import gc
import json
import re
from collections.abc import Iterable, Iterator
from contextlib import closing, contextmanager
from functools import cache
from itertools import islice
from struct import pack

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from strandmill.llm.common import text_slices

#: Words as the library splits them, in classes that the ``re`` module knows; :meth:`Encoder.agrees` says for which texts.
WORD = r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\w\s]|_)+|\s+(?!\S)|\s+"
#: Words that are held, and meet in one trie, at a time.
WORDS = 1 << 18
#: Distinct words, bytes of them, and pairs of tokens that a task remembers; then it starts anew.
REMEMBERED, REMEMBERED_BYTES, PAIRS = 350_000, 16_000_000, 1 << 18


def byte_letters() -> list[str]:
    """The letter that stands for each byte in byte-level vocabularies: itself where it prints, else the next from U+0100 on."""
    prints = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(0x100, 0x200))
    return [chr(b) if b in prints else chr(next(rest)) for b in range(256)]


def spellings(spec: dict) -> dict[int, bytes]:
    """The bytes of every id of a byte-level file; a special token with other letters is its text."""
    value = {c: b for b, c in enumerate(byte_letters())}
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    return {i: bytes(map(value.__getitem__, t)) if all(c in value for c in t) else t.encode() for t, i in (spec["model"]["vocab"] | special).items()}


def read_file(path: str) -> dict:
    with open(path, encoding="utf-8") as lines:
        return json.load(lines)


class Vocabulary:
    """Tokens, merges and special tokens of a byte-level BPE file of the ``tokenizers`` library.

    Settings that this encoder does not have (normalizers, dropout, word prefixes and the like) are an error, truncation
    and padding are not used.
    """

    def __init__(self, path: str):
        spec = read_file(path)
        model, split = spec["model"], spec["pre_tokenizer"] or {}
        odd = [k for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges") if model.get(k)]
        if model["type"] != "BPE" or split.get("type") != "ByteLevel" or split.get("add_prefix_space") or not split.get("use_regex") or spec["normalizer"] or odd:
            raise ValueError(f"{path} is not a plain byte-level BPE file: {odd}")
        ids = model["vocab"]
        self.bytes_of = spellings(spec)
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        #: left -> right -> rank, and token -> (rank, left, right) of the merge that makes it
        self.ranks: dict[int, dict[int, int]] = {}
        for r, (a, b) in enumerate(pairs):
            self.ranks.setdefault(ids[a], {}).setdefault(ids[b], r)
        self.made = {ids[a + b]: (r, ids[a], ids[b]) for r, (a, b) in reversed(list(enumerate(pairs)))}
        if len(self.made) != len(pairs):
            raise ValueError(f"{path} makes a token by more than one merge")
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] for t in spec["added_tokens"]):
            raise ValueError(f"{path} has added tokens that are not matched as they stand")
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.right_edge, self.left_edge = cache(lambda t: self._edge(t, 2)), cache(lambda t: self._edge(t, 1))
        self.whole = cache(self._whole)

    def _edge(self, token: int, side: int) -> list[tuple[int, float]]:
        """Tokens that stand at one edge while ``token`` is merged, each with the rank of the merge that ends it."""
        edge, end = [], float("inf")
        while True:
            edge.append((token, end))
            if token not in self.made:
                return edge
            end, token = self.made[token][0], self.made[token][side]

    def fits(self, left: int, right: int) -> bool:
        """Whether ``left`` and ``right`` stay two tokens: no merge across their boundary comes before those inside.

        A merge applies when both its tokens stand at the boundary. Of equal merges the one further left is done first:
        inside ``left`` before the boundary, at the boundary before inside ``right``.
        """
        ranks, edge = self.ranks, self.left_edge(right)
        for a, until_a in self.right_edge(left):
            if after := ranks.get(a):
                for b, until_b in edge:
                    if b in after and after[b] < until_a and after[b] <= until_b:
                        return False
        return True

    def _whole(self, token: int) -> bool:
        """Whether the encoding of what ``token`` spells is ``token`` itself; some tokens of a file never come about."""
        if token not in self.made:
            return True
        made, left, right = self.made[token]
        earlier = ((self.ranks.get(a, {}).get(b, made), x, y) for a, x in self.right_edge(left) for b, y in self.left_edge(right))
        return self.whole(left) and self.whole(right) and not any(r < min(x, made) and r <= y for r, x, y in earlier)


class Encoder:
    """Ids of texts; a task encodes each distinct word once, along the trie of the words it meets together."""

    def __init__(self, path: str):
        import regex
        from tokenizers.pre_tokenizers import ByteLevel

        self.vocabulary = Vocabulary(path)
        self.pattern, self.library = re.compile(WORD), ByteLevel(add_prefix_space=False, use_regex=True)
        special = self.vocabulary.special
        self.special = regex.compile("|".join(map(regex.escape, sorted(special, key=len, reverse=True)))) if special else None
        #: every end of every token, with the token's id where it is one: the search for the token at a prefix's end stops at the first miss
        self.ends: dict[bytes, int] = {}
        for token, spelled in self.vocabulary.bytes_of.items():
            if token not in special.values():
                for i in range(1, len(spelled)):
                    self.ends.setdefault(spelled[i:], -1)
                self.ends[spelled] = token
        self.known: dict[str, bytes] = {}
        self.pairs: dict[int, bool] = {}
        self.held = 0
        self.same: dict[str, bool] = {}

    def traverse(self, words: Iterable[bytes]) -> Iterator[list[int]]:
        """Encodings of distinct words in byte order.

        Sorted words are their trie's depth-first listing, and ``last`` is the path from its root: the last token of
        every prefix. From a word to the next the path is cut to their common prefix and grown by the new nodes.
        """
        ends, whole, compatible, pairs, before = self.ends.get, self.vocabulary.whole, self.vocabulary.fits, self.pairs, b""
        last, sizes = [-1], [0]
        for word in words:
            depth, most = 0, min(len(word), len(before))
            while depth < most and word[depth] == before[depth]:
                depth += 1
            del last[depth + 1:], sizes[depth + 1:]
            for end in range(depth + 1, len(word) + 1):
                at = start = end
                while start and (found := ends(word[start - 1:end])) is not None:
                    start -= 1
                    if found >= 0:
                        token, at = found, start
                # exactly one token at the prefix's end fits what lies before; mostly it is the longest
                while True:
                    if not at:
                        fits = whole(token)
                    elif (fits := pairs.get(pair := last[at] << 20 | token)) is None:
                        fits = pairs[pair] = whole(token) and compatible(last[at], token)
                    if fits:
                        break
                    at += 1
                    while (token := ends(word[at:end])) < 0:
                        at += 1
                last.append(token)
                sizes.append(end - at)
            ids, at = [], len(word)
            while at:
                ids.append(last[at])
                at -= sizes[at]
            before = word
            yield ids[::-1]

    def learn(self, words: set[str]) -> None:
        """Encodes words that are not remembered yet. What is remembered is bounded; beyond that it starts anew."""
        if len(self.known) > REMEMBERED or self.held > REMEMBERED_BYTES:
            self.known.clear()
            self.held = 0
        if len(self.pairs) > PAIRS:
            self.pairs.clear()
        new = sorted(words.difference(self.known))  # the order of characters is that of their bytes in UTF-8
        for word, ids in zip(new, self.traverse(map(str.encode, new))):
            self.known[word] = pack(f"<{len(ids)}I", *ids)
            self.held += len(word) + 4 * len(ids)

    def close(self) -> None:
        """Drops all tables: a worker that goes on with another task holds none of this one's."""
        self.vocabulary.__dict__.clear()
        self.__dict__.clear()

    def agrees(self, text: str) -> bool:
        """Whether pattern and library class all characters of a text alike: those of numbers that are no digits, some
        controls, and of other Unicode versions differ."""
        found = set(text)
        for c in found:
            if c not in self.same:
                probe = f"a{c}1 {c}"
                self.same[c] = self.pattern.findall(probe) == [probe[i:j] for _, (i, j) in self.library.pre_tokenize_str(probe)]
        return all(map(self.same.__getitem__, found))

    def runs(self, text: str) -> Iterator[list[str] | int]:
        """A text's words in runs of bounded length, and the ids of special tokens between them."""
        at, agrees = 0, self.agrees(text)
        for stop in [*(self.special.finditer(text) if self.special else ()), None]:
            part = text[at:stop.start() if stop else None] if at or stop else text
            if agrees and len(part) < WORDS:
                yield self.pattern.findall(part)
            else:
                found = (m.group() for m in self.pattern.finditer(part)) if agrees else (part[i:j] for _, (i, j) in self.library.pre_tokenize_str(part))
                while words := list(islice(found, WORDS)):
                    yield words
            if stop:
                at = stop.end()
                yield self.vocabulary.special[stop.group()]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers. So many words as ``WORDS`` meet in one trie."""
        out, waiting, n = [bytearray() for _ in texts], [], 0

        def settle():
            self.learn(set().union(*(run for _, run in waiting if not isinstance(run, int))))
            for i, run in waiting:
                out[i] += pack("<I", run) if isinstance(run, int) else b"".join(map(self.known.__getitem__, run))
            waiting.clear()

        for i, text in enumerate(texts):
            for run in self.runs(text):
                waiting.append((i, run))
                n += 1 if isinstance(run, int) else len(run)
                if n >= WORDS:
                    settle()
                    n = 0
        settle()
        return list(map(bytes, out))


@contextmanager
def no_collector() -> Iterator[None]:
    """Without Python's cycle collector, which would go through the tables of a vocabulary again and again: encoding makes no cycles."""
    gc.collect()
    gc.disable()
    try:
        yield
    finally:
        gc.enable()


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def encode(text: Column, path: str | None = None) -> Column:
    """The ids of a string column as binary: little-endian unsigned 32-bit integers, no special tokens added.

    The text of a special token of the file is that token. A null text is an empty one. Texts are read whole, in runs of
    bounded length; equal texts have equal ids.
    """
    file = path or vocabulary_path()

    @arrow_udf("binary")
    def of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        with no_collector(), closing(Encoder(file)) as encoder:
            for batch in batches:
                for part in text_slices(batch, 2_000_000):  # handed on at once: ids are larger than texts
                    yield pa.array(encoder.encode([x or "" for x in part.to_pylist()]), pa.binary())

    return of(text.cast("string"))


def decode(ids: Column, path: str | None = None) -> Column:
    """The text of a binary column of ids as :func:`encode` gives it, special tokens included.

    Bytes that are no UTF-8 become U+FFFD, ids that the file does not have are left out, null ids are an empty text.
    """
    file = path or vocabulary_path()

    @arrow_udf("string")
    def of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        known = spellings(read_file(file))
        spelled = [known.get(i, b"") for i in range(max(known) + 2)]  # the last one stands for all ids beyond

        def text(x: bytes) -> str:
            runs = (np.minimum(np.frombuffer(x[i:i + 4 * WORDS], "<u4"), len(spelled) - 1).tolist() for i in range(0, len(x), 4 * WORDS))
            return b"".join([b"".join(map(spelled.__getitem__, run)) for run in runs]).decode("utf-8", "replace")

        for batch in batches:
            for part in text_slices(batch, 2_000_000):
                yield pa.array([text(x.as_py() or b"") for x in part], pa.string())

    return of(ids)


def encode_documents(docs: DataFrame, text: str = "text", into: str = "ids", path: str | None = None) -> DataFrame:
    """``docs`` with the binary column ``into``; see :func:`encode`.

    Rows are encoded where they lie, without a shuffle; ties, repeated rows and null keys are rows as any other, an empty
    table gives an empty one. A column of the name ``into`` is replaced, all others stay.
    """
    return docs.withColumn(into, encode(F.col(text), path))


def op13_bpe(spark, sf_dir):
    from strandmill.llm.common import table

    ids = encode_documents(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")
    return ids.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"),
                      F.sha2(decode(F.col("ids")).cast("binary"), 256).alias("decoded_sha256"))
