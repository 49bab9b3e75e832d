"""Archives read by members, choices explained in prompts."""

import bz2
import gzip
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from strandmill.operators import pairwise
from strandmill.sources import archives


@pytest.fixture()
def packed(tmp_path):
    path = tmp_path / "a.zip"
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("b/lines.jsonl", "one\n\ntwo é\nlast", zipfile.ZIP_DEFLATED)
        z.writestr("a.jsonl", "stored\n", zipfile.ZIP_STORED)
        z.writestr("c.txt", "x\n" * 100_000, zipfile.ZIP_BZIP2)
        z.writestr("d.jsonl.gz", gzip.compress(b"inner\nlines\n"))
        z.writestr("e.jsonl.bz2", bz2.compress(b"inner2\n"))
        z.writestr("empty.jsonl", "")
        z.writestr("__MACOSX/a.jsonl", "no")
        z.writestr("b/._lines.jsonl", "no")
        z.writestr("b/", "")
    return str(path)


def test_members_of_every_kind(spark, packed):
    rows = archives.read_members(spark, [packed], 10)
    assert rows.rdd.getNumPartitions() == 6  # a task for each of the members that are longer than the bound
    found = {}
    for r in rows.collect():
        found.setdefault(r["member"], []).append((r["line"], r["value"]))
    assert {m: sorted(x) for m, x in found.items() if m != "c.txt"} == {
        "a.jsonl": [(0, "stored")], "b/lines.jsonl": [(0, "one"), (1, ""), (2, "two é"), (3, "last")], "d.jsonl.gz": [(0, "inner"), (1, "lines")], "e.jsonl.bz2": [(0, "inner2")]}
    assert len(found["c.txt"]) == 100_000
    whole = archives.read_members(spark, [packed, packed])
    assert whole.rdd.getNumPartitions() == 2 and whole.count() == 2 * rows.count()


def test_damaged_members_are_named(spark, packed):
    content = bytearray(open(packed, "rb").read())
    at = content.index(b"stored\n")
    content[at:at + 6] = b"STORED"
    open(packed, "wb").write(content)
    with pytest.raises(Exception, match="a.jsonl is damaged"):
        archives.read_members(spark, [packed]).collect()


def test_empty_archives(spark, tmp_path):
    zipfile.ZipFile(tmp_path / "none.zip", "w").close()
    assert archives.read_members(spark, [str(tmp_path / "none.zip")]).collect() == []


def test_archives_come_back(spark, tmp_path):
    rows = spark.createDataFrame([(f"z{i % 2}", f"m{i % 3}", i, f"v{i}" if i % 5 else None) for i in range(60)], "a string, m string, k int, v string").repartition(7)
    made = archives.write_archives(rows, f"file://{tmp_path}/out", "a", "m", "k", "v").collect()
    assert sorted(r["members"] for r in made) == [3, 3]
    found = {(r["path"][-6:], r["member"], r["line"], r["value"]) for r in archives.read_members(spark, [r["path"] for r in made]).collect()}
    want = set()
    for z in range(2):
        for m in range(3):
            want |= {(f"z{z}.zip", f"m{m}", at, f"v{i}" if i % 5 else "") for at, i in enumerate(i for i in range(60) if i % 2 == z and i % 3 == m)}
    assert found == want
    assert not [p for p in (tmp_path / "out").iterdir() if p.name.startswith(".") and not p.name.endswith(".crc")]


def test_choices(spark):
    asked = 'The FEN of the given chess board is "8/8 w - -". MoveA:e2e4 , plan A MoveB: no MoveB:d2d4 tactic  b\n'
    cases = [(asked, "MoveB:d2d4"), (asked, "moveA:E2E4"), (asked, "MoveA:a2a4"), (asked, ""), (asked, None), (asked.replace("FEN of", "x"), "MoveB:d2d4"), (asked.replace(" tactic  b", ""), "MoveB:d2d4")]
    rows = spark.createDataFrame([("p", m, i, json.dumps({"input": a, "output": b})) for m in ("x_Tactics.jsonl", "noexplain.jsonl", "y.txt") for i, (a, b) in enumerate(cases)] + [("p", "y.jsonl", 9, "broken"), ("p", "y.jsonl", 10, " ")],
                                 "path string, member string, line long, value string")
    ids = pairwise.pairwise_rows(rows, "s").select("source_row_id", "target_move_uci", "comment_text", "source_family", "comment_source").orderBy("source_row_id").collect()
    assert [tuple(r) for r in ids] == [("x_Tactics.jsonl:0", "d2d4", "Tactic: b", "tactic", "tactic_explanation"), ("x_Tactics.jsonl:1", "e2e4", "plan A MoveB: no", "tactic", "tactic_explanation")]
