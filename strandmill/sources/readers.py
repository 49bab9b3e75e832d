"""Readers of row files and split sets: JSON lines, JSON documents, CSV, compressed and zipped members, game texts."""

from __future__ import annotations

import io
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandmill.functions import text as t

SPLITS = ("train", "val", "test")


def read_jsonl(spark: SparkSession, paths, schema: T.StructType | str | None = None, strict: bool = True) -> DataFrame:
    """JSON lines of one path or several; blank lines are skipped, a malformed one fails the read unless not ``strict``."""
    reader = spark.read.option("mode", "FAILFAST" if strict else "DROPMALFORMED")
    return (reader.schema(schema) if schema else reader).json(paths)


def read_json_document(spark: SparkSession, paths, schema: T.StructType | str) -> DataFrame:
    """Documents that are a list of rows, or hold one under ``records``; other members are skipped."""
    row = (T._parse_datatype_string(schema) if isinstance(schema, str) else schema).simpleString()
    texts = spark.read.text(paths, wholetext=True).select(F.trim("value").alias("value"))
    listed = F.when(F.col("value").startswith("["), F.from_json("value", f"array<{row}>", {"mode": "FAILFAST"})).otherwise(
        F.from_json("value", f"struct<records:array<{row}>>", {"mode": "FAILFAST"})["records"])
    return texts.select(F.explode(listed).alias("r")).where("r is not null").select("r.*")


def read_csv(spark: SparkSession, paths) -> DataFrame:
    """A header and strings."""
    return spark.read.csv(paths, header=True, inferSchema=False, multiLine=True, escape='"')


def member_lines(name: str, stream) -> Iterator[str]:
    """Text lines of a possibly compressed stream, by the suffix of its name."""
    import bz2
    import gzip
    import lzma

    opened = {"gz": gzip.open, "bz2": bz2.open, "xz": lzma.open}.get(name.rpartition(".")[2].lower())
    yield from io.TextIOWrapper(opened(stream, "rb") if opened else stream, "utf-8")


def hidden(name: str) -> bool:
    last = name.rstrip("/").rpartition("/")[2]
    return name.endswith("/") or "__MACOSX" in name or last.startswith("._") or last == ".DS_Store"


def read_archived_lines(spark: SparkSession, paths, rows: int = 10_000) -> DataFrame:
    """``(path, member, line, value)`` of zip archives and of xz files, which Spark does not open by itself.

    A file is read by one task, as such files cannot be split, and handed on in batches of ``rows`` lines.
    """
    def lines(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import zipfile

        for batch in batches:
            for path, content in zip(batch["path"], batch["content"]):
                if path.lower().endswith(".zip"):
                    archive = zipfile.ZipFile(io.BytesIO(content))
                    members = ((n, archive.open(n)) for n in archive.namelist() if not hidden(n))
                else:
                    members = [(path.rpartition("/")[2], io.BytesIO(content))]
                for name, stream in members:
                    held = []
                    for i, line in enumerate(member_lines(name, stream)):
                        held.append((path, name, i, line.rstrip("\n")))
                        if len(held) == rows:
                            yield pd.DataFrame(held, columns=["path", "member", "line", "value"])
                            held = []
                    if held:
                        yield pd.DataFrame(held, columns=["path", "member", "line", "value"])

    files = spark.read.format("binaryFile").load(paths).select("path", "content")
    return files.mapInPandas(lines, "path string, member string, line long, value string")


def read_rows(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """Rows of a file by its suffix."""
    low = path.lower()
    if low.endswith((".pkl", ".pickle")):
        raise ValueError("pickled rows are not read: unpickling runs code of the file")
    if low.endswith((".zip", ".xz")):
        lines = read_archived_lines(spark, path).where(F.trim("value") != "")
        return lines.select(F.from_json("value", schema if isinstance(schema, str) else schema, {"mode": "FAILFAST"}).alias("r")).select("r.*")
    stem = low.removesuffix(".gz").removesuffix(".bz2").removesuffix(".zst")
    if stem.endswith(".csv"):
        return read_csv(spark, path)
    if stem.endswith(".json"):
        return read_json_document(spark, path, schema)
    if stem.endswith(".parquet"):
        return spark.read.parquet(path)
    return read_jsonl(spark, path, schema)


def find_files(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """``(path, length, modificationTime)`` below ``root``, without hidden and cache folders; contents are not read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root)
    return found.select("path", "length", "modificationTime").where(~F.col("path").rlike(r"/\.(metadata|cache)/"))


def file_catalog(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """``(path, length, sha256)`` of the files below ``root``: provenance rows."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root)
    return found.select("path", "length", F.sha2("content", 256).alias("sha256"))


def exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def read_split_set(spark: SparkSession, root: str, schema: T.StructType | str, lenient: bool = False) -> DataFrame:
    """``root/{train,val,test}.jsonl`` with ``split``; a missing file fails, or is skipped if ``lenient``."""
    found = None
    for name in SPLITS:
        path = f"{root}/{name}.jsonl"
        if lenient and not exists(spark, path):
            continue
        one = read_jsonl(spark, path, schema)
        own = F.coalesce("split", F.lit(name)) if lenient and "split" in one.columns else F.lit(name)
        one = one.withColumn("split", own)
        found = one if found is None else found.unionByName(one, allowMissingColumns=True)
    if found is None:
        raise FileNotFoundError(f"no split of {root}")
    return found


def read_games(spark: SparkSession, paths) -> DataFrame:
    """``(path, headers, moves)`` of game texts with several games: split at the header that starts one, by Spark's text reader."""
    raw = spark.read.option("lineSep", "\n[Event ").text(paths).select(F.col("_metadata.file_path").alias("path"), "value")
    text = F.regexp_replace(F.concat(F.lit("[Event "), F.regexp_replace("value", r"^\s*\[Event ", "")), "\r", "")
    header = r'\[(\w+)\s+"([^"]*)"\]'
    names, values = (F.regexp_extract_all("text", F.lit(header), F.lit(i)) for i in (1, 2))
    first = F.transform(F.array_distinct(names), lambda n: F.struct(n.alias("key"), F.element_at(values, F.array_position(names, n).cast("int")).alias("value")))
    return raw.withColumn("text", text).where(F.trim("value") != "").select(
        "path", F.map_from_entries(first).alias("headers"), t.strip(F.regexp_replace("text", r"(?m)^\[[^\n]*\]\n?", "")).alias("moves"))


def read_sharded_json(spark: SparkSession, root: str, schema: T.StructType | str) -> DataFrame:
    """JSON lines of all ``*.jsonl`` and ``*.jsonl-*`` files below ``root``, with ``source_file``, the file's name."""
    found = spark.read.schema(schema).option("mode", "FAILFAST").option("recursiveFileLookup", True).option("pathGlobFilter", "{*.jsonl,*.jsonl-*}").json(root)
    return found.select("*", F.col("_metadata.file_name").alias("source_file"))


def read_summaries(spark: SparkSession, root: str, name: str = "summary.json") -> DataFrame:
    """JSON documents named ``name`` below ``root`` with ``experiment`` and ``seed`` from their folders."""
    found = spark.read.option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", name).json(root)
    path = F.col("_metadata.file_path")
    return found.withColumns({"experiment": F.regexp_extract(path, r"/([^/]+?)(?:[_-]seed[_-]?\d+)?/(?:eval/)?[^/]+$", 1), "seed": F.nullif(F.regexp_extract(path, r"seed[_-]?(\d+)", 1), F.lit("")).cast("int")})


def read_settings(spark: SparkSession, paths) -> DataFrame:
    """``(path, settings)`` of YAML files, settings as JSON text; a file that is empty has those of an empty map.

    Files are parsed by tasks with the PyYAML library where that is installed; a file that is no YAML is an error that names it.
    """
    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import json

        import yaml

        for batch in batches:
            out = []
            for path, text in zip(batch["path"], batch["value"]):
                try:
                    out.append((path, json.dumps(yaml.safe_load(text) or {}, default=str)))
                except yaml.YAMLError as e:
                    raise ValueError(f"{path} is no YAML: {e}") from None
            yield pd.DataFrame(out, columns=["path", "settings"])

    return spark.read.text(paths, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value").mapInPandas(parse, "path string, settings string")


def load_settings(spark: SparkSession, *paths: str) -> dict:
    """Settings of a few files, merged in the order given."""
    import json

    return merge_settings(*[json.loads(r["settings"]) for path in paths for r in read_settings(spark, path).collect()])


def merge_settings(*layers: dict) -> dict:
    """Nested dictionaries merged, later ones win, lists are replaced."""
    out: dict = {}
    for layer in layers:
        for k, v in layer.items():
            out[k] = merge_settings(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else v
    return out
