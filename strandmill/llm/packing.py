"""Packing: first-fit decreasing over a tournament tree of bin capacities, in randomised groups of documents."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from strandmill.llm.common import slices


class Tokens:
    """Ids of a vocabulary file: a ``tokenizers`` one, or ranks, which give the same ids as their ``tokenizers`` file in less time.

    The file decides on the library, never the text. As by default in ``tokenizers``, the text of a special token is
    that token.
    """

    def __init__(self, path: str, special: str = "<|endoftext|>"):
        if path.endswith(".tiktoken"):
            import base64

            import public_tokenizers
            import tiktoken

            with open(path, "rb") as lines:
                known = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
            ranks = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=known, special_tokens={special: len(known)})
            self.ids = lambda text: ranks.encode_to_numpy(text, allowed_special="all").astype("<u4")
        else:
            from tokenizers import Tokenizer

            plain = Tokenizer.from_file(path)
            self.ids = lambda text: np.array(plain.encode(text, add_special_tokens=False).ids, "<u4")


def vocabulary() -> str:
    """The ranks of ``byte_bpe_50k.json``; tests hold both files' ids against each other over all characters."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


CUT = "struct<doc_tokens:bigint,pieces:array<struct<start:bigint,length:bigint,ids_crc32:bigint>>>"
CUT_TYPE = pa.struct([("doc_tokens", pa.int64()), ("pieces", pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])))])


def cut(column, size: int, end_id: int, path: str):
    """Token count (with the end id) and pieces of at most ``size`` ids: full ones from the start, the rest last."""
    @arrow_udf(CUT)
    def of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        tokens, end = Tokens(path), np.array([end_id], "<u4")
        for batch in slices(batches):
            out = []
            for x in batch:
                ids = np.concatenate((tokens.ids(x.as_py() or ""), end))
                out.append({"doc_tokens": len(ids), "pieces": [
                    {"start": a, "length": min(size, len(ids) - a), "ids_crc32": zlib.crc32(ids[a:a + size].tobytes())} for a in range(0, len(ids), size)]})
            yield pa.array(out, CUT_TYPE)

    return of(column)


def first_fit_decreasing(lengths: list[int], capacity: int) -> tuple[list[int], list[int]]:
    """Bin and offset of each length: longest first, each into the first bin with room.

    A tournament tree holds the room of every bin at its leaves and the larger of two rooms above them, so the first
    bin with room is found, and its room updated, in log n steps.
    """
    leaves = 1
    while leaves < len(lengths):
        leaves *= 2
    room = [capacity] * (2 * leaves)
    bins, offsets = [0] * len(lengths), [0] * len(lengths)
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        need, at = lengths[i], 1
        while at < leaves:
            at *= 2
            if room[at] < need:
                at += 1
        bins[i], offsets[i] = at - leaves, capacity - room[at]
        room[at] -= need
        while at > 1:
            at //= 2
            now = max(room[2 * at], room[2 * at + 1])
            if room[at] == now:
                break
            room[at] = now
    return bins, offsets


def regrouped(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.Table]:
    """The batches' rows in groups of exactly ``rows``, the last one smaller, whatever the size of a batch is."""
    held, n = [], 0
    for batch in batches:
        held, n = [*held, batch], n + batch.num_rows
        while n >= rows:
            table = pa.Table.from_batches(held)
            yield table.slice(0, rows)
            held, n = table.slice(rows).to_batches(), n - rows
    if n:
        yield pa.Table.from_batches(held)


def pack_groups(size: int, group_rows: int, schema: pa.Schema, length_at: int):
    """Streams a task's pieces and packs each run of ``group_rows`` on its own; sequence numbers are the task's own."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, made = TaskContext.get().partitionId(), 0
        for part in regrouped(batches, group_rows):
            bins, offsets = first_fit_decreasing(part.column(length_at).to_pylist(), size)
            numbers = (task << 36) + made + np.array(bins, np.int64)
            made += max(bins) + 1
            yield from pa.table([*part.columns, pa.array(numbers), pa.array(offsets, pa.int64())], schema=schema).to_batches()

    return run


def pack(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = 1024, end_id: int = 0, group_rows: int = 10_000,
         tokenizer: str | None = None) -> DataFrame:
    """One row per piece: key, ``start``, ``length``, ``ids_crc32``, ``doc_tokens``, ``sequence_id``, ``offset``.

    Texts are tokenised once where they are read; only piece lengths are shuffled. The groups are random: pieces are
    dealt to tasks by a hash that also holds their row's place in the input, so that copies of one document spread,
    sorted by that hash, and packed in runs of ``group_rows``, which bounds memory (the last run of a task is smaller). A null or empty text is one
    piece with the end id alone. Repeated rows are packed each, a null key is kept, an empty table gives an empty one,
    other columns of ``docs`` don't matter.
    """
    pieces = (docs.select(F.col(key).alias("key"), F.monotonically_increasing_id().alias("at"), cut(F.col(text).cast("string"), size, end_id, tokenizer or vocabulary()).alias("cut"))
              .select("key", "at", "cut.doc_tokens", F.explode("cut.pieces").alias("piece"))
              .select("key", "piece.start", "piece.length", "piece.ids_crc32", "doc_tokens", F.xxhash64("key", "at").alias("deal")))
    dealt = pieces.repartition("deal").sortWithinPartitions("deal", "key", "start").drop("deal")
    kinds = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}
    schema = pa.schema([(c, kinds[t]) for c, t in dealt.dtypes] + [("sequence_id", pa.int64()), ("offset", pa.int64())])
    columns = ", ".join(f"{c} {t}" for c, t in dealt.dtypes)
    packed = dealt.mapInArrow(pack_groups(size, group_rows, schema, 2), f"{columns}, sequence_id bigint, offset bigint")
    return packed.withColumnRenamed("key", key)


def op6_first_fit_packing(spark, sf_dir):
    from strandmill.llm.common import table

    return pack(table(spark, sf_dir, "documents"))
