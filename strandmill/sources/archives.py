"""Zip archives of row files, written and read by many tasks.

A reader finds an archive's members in its central directory and deals them to partitions by compressed size; a task
reads the byte ranges of its members only, as a stream. Files are opened by pyarrow's file systems, which know local and
remote stores; archives of other stores are read whole by :func:`readers.read_archived_lines`.
"""

from __future__ import annotations

import io
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from strandmill.sources.readers import hidden, member_lines

LINES = pa.schema([("path", pa.string()), ("member", pa.string()), ("line", pa.int64()), ("value", pa.string())])


def opened(path: str):
    from pyarrow import fs

    system, inside = fs.FileSystem.from_uri(path if "://" in path else f"file:{path.removeprefix('file:')}" if path.startswith(("/", "file:/")) else path)
    return system, inside


@dataclass(frozen=True)
class Member:
    name: str
    start: int  # of its local header
    packed: int
    method: int
    check: int


@dataclass
class Share(InputPartition):
    """Members of one archive for one task."""

    path: str
    members: list[Member]


def members(path: str) -> list[Member]:
    """What an archive holds, by name, without folders and files of operating systems."""
    import zipfile

    system, inside = opened(path)
    with system.open_input_file(inside) as file, zipfile.ZipFile(file if file.size() > 1 << 16 else io.BytesIO(file.read())) as archive:
        found = [i for i in archive.infolist() if not hidden(i.filename)]
        if locked := [i.filename for i in found if i.flag_bits & 1]:
            raise ValueError(f"{path}: {locked[0]} is encrypted")
        return sorted((Member(i.filename, i.header_offset, i.compress_size, i.compress_type, i.CRC) for i in found), key=lambda m: m.name)


def shares(path: str, size: int) -> Iterator[Share]:
    """Runs of members of about ``size`` compressed bytes; a larger member is a run of its own."""
    run, held = [], 0
    for m in members(path):
        if run and held + m.packed > size:
            yield Share(path, run)
            run, held = [], 0
        run.append(m)
        held += m.packed
    if run:
        yield Share(path, run)


class MemberStream(io.RawIOBase):
    """The bytes of one member, inflated as they are read, and checked at the end."""

    def __init__(self, file, path: str, member: Member):
        import bz2

        self.file, self.member, self.label, self.left, self.check = file, member, f"{path}: {member.name}", member.packed, 0
        file.seek(member.start)
        head = file.read(30)
        if head[:4] != b"PK\x03\x04" or member.method not in (0, 8, 12):
            raise ValueError(f"{self.label} is damaged or packed by an unknown method")
        file.seek(member.start + 30 + int.from_bytes(head[26:28], "little") + int.from_bytes(head[28:30], "little"))
        self.inflate = {0: None, 8: zlib.decompressobj(-15), 12: bz2.BZ2Decompressor()}[member.method]
        self.ready, self.done = b"", False

    def readable(self) -> bool:
        return True

    def readinto(self, buffer) -> int:
        while not self.ready and not self.done:
            chunk = self.file.read(min(self.left, 1 << 18))
            self.left -= len(chunk)
            try:
                self.ready = self.inflate.decompress(chunk) if self.inflate else chunk
            except (zlib.error, OSError, EOFError) as e:
                raise ValueError(f"{self.label} is damaged: {e}") from None
            self.check = zlib.crc32(self.ready, self.check)
            if not self.left or not chunk:
                self.done = True
                if self.member.method == 8:
                    tail = self.inflate.flush()
                    self.ready, self.check = self.ready + tail, zlib.crc32(tail, self.check)
                if self.check != self.member.check:
                    raise ValueError(f"{self.label} is damaged: its check sum differs")
        n = min(len(buffer), len(self.ready))
        buffer[:n], self.ready = self.ready[:n], self.ready[n:]
        return n


class ArchiveReader(DataSourceReader):
    def __init__(self, options):
        self.paths, self.size = options["paths"].split("\n"), int(options.get("membersize", 8_000_000))

    def partitions(self):
        return [share for path in self.paths if path for share in shares(path, self.size)] or [Share("", [])]

    def read(self, partition: Share):
        if not partition.members:
            return
        system, inside = opened(partition.path)
        with system.open_input_file(inside) as file:
            for member in partition.members:
                held: list[tuple] = []
                try:
                    for i, line in enumerate(member_lines(member.name, io.BufferedReader(MemberStream(file, partition.path, member), 1 << 16))):
                        held.append((partition.path, member.name, i, line.rstrip("\n")))
                        if len(held) == 4096:
                            yield batch(held)
                            held = []
                except UnicodeDecodeError as e:
                    raise ValueError(f"{partition.path}: {member.name} is no UTF-8: {e}") from None
                if held:
                    yield batch(held)


def batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*rows), LINES.types)], schema=LINES)


class ArchiveSource(DataSource):
    """``spark.read.format("archived_lines").option("paths", ...)``: the lines of the members of zip archives."""

    @classmethod
    def name(cls) -> str:
        return "archived_lines"

    def schema(self) -> str:
        return "path string, member string, line bigint, value string"

    def reader(self, schema) -> ArchiveReader:
        return ArchiveReader(self.options)


def read_members(spark: SparkSession, paths: list[str], size: int = 8_000_000) -> DataFrame:
    """``(path, member, line, value)`` of zip archives; members packed once more (gz, bz2, xz) are unpacked by their names.

    A task reads members of about ``size`` compressed bytes. A member that is damaged, encrypted or no UTF-8 is an error
    that names it. An archive without members has no rows.
    """
    spark.dataSource.register(ArchiveSource)
    return spark.read.format("archived_lines").option("paths", "\n".join(paths)).option("membersize", str(size)).load()


def packed(name: str, content: bytes) -> bytes:
    """A member's content, packed once more if its name says so."""
    import bz2
    import gzip
    import lzma

    pack = {"gz": gzip.compress, "bz2": bz2.compress, "xz": lzma.compress}.get(name.rpartition(".")[2].lower())
    return pack(content) if pack else content


def write_archives(rows: DataFrame, root: str, archive: str, member: str, order: str, value: str) -> DataFrame:
    """Writes ``(archive, member, order, value)`` rows as lines of zip archives below ``root``: ``(path, members)``.

    Rows are sorted by archive and member, and a task streams them into its archives; a member is packed before it is
    added. An archive gets its name when it is whole, so a task that runs twice leaves one.
    """
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import uuid
        import zipfile

        state: dict = {"name": None}
        done: list[tuple[str, int]] = []

        def close():
            if state["name"] is not None:
                state["zip"].writestr(state["member"], packed(state["member"], state["text"].getvalue()))
                state["zip"].close()
                state["stream"].close()
                system, inside = opened(f"{root}/{state['name']}.zip")
                system.move(state["temporary"], inside)
                done.append((f"{root}/{state['name']}.zip", state["n"] + 1))

        for rows in batches:
            for name, part, text in zip(*(rows.column(i).to_pylist() for i in range(3))):
                if name != state["name"]:
                    close()
                    system, inside = opened(f"{root}/.{name}-{uuid.uuid4().hex}")
                    system.create_dir(inside.rpartition("/")[0], recursive=True)
                    stream = system.open_output_stream(inside)
                    state = {"name": name, "temporary": inside, "stream": stream, "zip": zipfile.ZipFile(stream, "w", zipfile.ZIP_DEFLATED), "member": part, "text": io.BytesIO(), "n": 0}
                elif part != state["member"]:
                    state["zip"].writestr(state["member"], packed(state["member"], state["text"].getvalue()))
                    state |= {"member": part, "text": io.BytesIO(), "n": state["n"] + 1}
                state["text"].write((text or "").encode() + b"\n")
        close()
        yield pa.RecordBatch.from_arrays([pa.array([d[i] for d in done], kind) for i, kind in ((0, pa.string()), (1, pa.int64()))], names=["path", "members"])

    dealt = rows.select(archive, member, value, order).repartition(archive).sortWithinPartitions(archive, member, order).drop(order)
    return dealt.mapInArrow(write, "path string, members bigint")
