"""Writers: JSON lines, CSV, variant trees with their ledger, and small reports."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def write_jsonl(rows: DataFrame, path: str, *partitions: str) -> int:
    """Overwrites ``path`` with JSON lines, nulls kept; returns the number of rows, counted as they are written."""
    seen = Observation()
    writer = rows.observe(seen, F.count("*").alias("n")).write.mode("overwrite").option("ignoreNullFields", False)
    (writer.partitionBy(*partitions) if partitions else writer).json(path)
    return seen.get["n"]


def write_csv(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").csv(path, header=True, escape='"')  # quotes doubled, as the reader takes them


def write_file(spark: SparkSession, value: str, path: str) -> None:
    """One small text as one file, such as a manifest, on whatever file system the path names."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    stream = target.getFileSystem(spark._jsc.hadoopConfiguration()).create(target, True)
    try:
        stream.write(bytearray(value.encode()))
    finally:
        stream.close()


def name_shards(spark: SparkSession, written: str, folder: str, pattern: str) -> int:
    """Moves the part files that Spark wrote to ``folder``, numbered by ``pattern``; returns how many there are."""
    paths = spark._jvm.org.apache.hadoop.fs.Path
    system = paths(written).getFileSystem(spark._jsc.hadoopConfiguration())
    system.mkdirs(paths(folder))
    parts = sorted(str(s.getPath()) for s in system.listStatus(paths(written)) if s.getPath().getName().startswith("part-"))
    for i, part in enumerate(parts):
        if not system.rename(paths(part), paths(f"{folder}/{pattern.format(i)}")):
            raise OSError(f"{part} was not moved")
    return len(parts)


def yaml_lines(value, deep: int = 0) -> list[str]:
    """Settings as YAML: nested maps and lists, scalars as JSON, which YAML reads."""
    pad, rows = "  " * deep, value.items() if isinstance(value, dict) else ((None, x) for x in value)
    out = []
    for key, x in rows:
        head = f"{pad}-" if key is None else f"{pad}{json.dumps(key) if not str(key).replace('_', '').isalnum() else key}:"
        if isinstance(x, (dict, list, tuple)) and x:
            out += [head, *yaml_lines(x, deep + 1)]
        else:
            out.append(f"{head} {json.dumps(x if x or not isinstance(x, tuple) else [], ensure_ascii=False, default=str)}")
    return out


def write_yaml(spark: SparkSession, value: dict, path: str) -> None:
    write_file(spark, "\n".join(yaml_lines(value)) + "\n", path)


def write_by_schema(parts: dict[str, DataFrame], root: str) -> dict[str, int]:
    """``root/<schema>.jsonl`` of each part, and ``root/manifest.yaml`` with the rows that were written."""
    counts = {name: write_jsonl(rows, f"{root}/{name}.jsonl") for name, rows in parts.items()}
    write_yaml(next(iter(parts.values())).sparkSession, {"rows": counts, "files": [f"{name}.jsonl" for name in parts]}, f"{root}/manifest.yaml")
    return counts


def write_variants(variants: dict[str, DataFrame], ledger: DataFrame, root: str, primary: str) -> dict[str, int]:
    """``root/variant=.../split=...``, the ledger beside it, and the primary variant once more at ``root/primary``."""
    if primary not in variants:
        raise ValueError(f"{primary} is none of the variants {sorted(variants)}")
    counts = {name: write_jsonl(rows, f"{root}/variants/variant={name}", "split") for name, rows in variants.items()}
    write_jsonl(ledger, f"{root}/ledger")
    # from what was just written, so that the variant is computed once
    again = ledger.sparkSession.read.schema(variants[primary].schema).json(f"{root}/variants/variant={primary}")
    write_jsonl(again, f"{root}/primary", "split")
    return counts


def flat_columns(schema: T.StructType, above: str = "") -> list[tuple[str, str]]:
    """(path, dotted name) of the scalar fields; lists and maps are left out."""
    out = []
    for f in schema.fields:
        path, name = f"{above}`{f.name}`", f"{above}{f.name}".replace("`", "")
        if isinstance(f.dataType, T.StructType):
            out += flat_columns(f.dataType, f"{path}.")
        elif not isinstance(f.dataType, (T.ArrayType, T.MapType)):
            out.append((path, name))
    return out


def flatten(rows: DataFrame) -> DataFrame:
    return rows.select(*[F.col(path).alias(name) for path, name in flat_columns(rows.schema)])


def markdown(title: str, rows: list[dict]) -> str:
    names = list(rows[0]) if rows else []
    lines = [f"# {title}", ""] + ([f"| {' | '.join(names)} |", f"|{'---|' * len(names)}"] if names else ["no rows"])
    return "\n".join(lines + [f"| {' | '.join(str(r[n]) for n in names)} |" for r in rows]) + "\n"


def write_report(rows: DataFrame, path: str, title: str, most: int = 1000) -> None:
    """A small aggregate as JSON, CSV and Markdown through Spark's writers; more than ``most`` rows are an error."""
    found = [r.asDict(recursive=True) for r in rows.limit(most + 1).collect()]
    if len(found) > most:
        raise ValueError(f"a report holds at most {most} rows")
    spark = rows.sparkSession
    text = lambda value, to: spark.createDataFrame([(value,)], "value string").coalesce(1).write.mode("overwrite").text(to)
    text(json.dumps(found, ensure_ascii=False, default=str), f"{path}/json")
    text(markdown(title, found), f"{path}/md")
    write_csv(flatten(rows), f"{path}/csv")
