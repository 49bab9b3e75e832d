"""Rows of unknown shape, and annotated games."""

import random
import time

import pytest
from pyspark.sql import functions as F

from strandmill.operators import builders, movetext, variants


def nested(rng, ply, depth, number, out):
    """A random line written down by recursion, with the nodes that it holds."""
    line, own, text = number[0], 0, []
    number[0] += 1
    for _ in range(rng.randint(1, 4)):
        node = {"ply": ply, "depth": depth, "variation": line, "move": f"N{rng.choice('abc')}{rng.randint(1, 8)}", "before": [], "after": [], "nags": []}
        if own == 0 and rng.random() < 0.3:
            node["before"].append("note")
            text.append("{ note }")
        own += 1
        out.append(node)
        text.append(f"{ply}. {node['move']}")
        for _ in range(rng.randint(0, 2)):
            node["nags"].append(n := rng.randint(1, 30))
            text.append(f"${n}")
        if rng.random() < 0.4:
            node["after"].append("so ( it ) is")
            text.append("{so ( it )  is}")
        while depth < 4 and rng.random() < 0.3:
            text.append(f"( {nested(rng, ply, depth + 1, number, out)} )")
        ply += 1
    return " ".join(text)


def test_games_against_recursion():
    rng = random.Random(2)
    for _ in range(300):
        want = []
        text = nested(rng, 1, 0, [0], want)
        assert movetext.read_game(f'[Event "a \\"b\\""]\n[Site "s"]\n[Event "later"]\n\n{text} 1-0') == {"headers": [("Event", 'a "b"'), ("Site", "s")], "result": "1-0", "nodes": want}


@pytest.mark.parametrize("text", ["(" * 200_000, ")" * 200_000, "{" * 200_000, "( Na1 " * 60_000, "Na1 {x} ) " * 40_000, '[Event "' * 40_000, "[a \"" + "\\" * 200_000, "$" * 200_000, "1" * 200_000, "; " * 100_000, "a" * 200_000])
def test_unbalanced_text_costs_its_length(text):
    began = time.time()
    movetext.read_game(text)
    assert time.time() - began < 3


def test_games_of_odd_text(spark):
    assert movetext.read_game("") == {"headers": [], "result": None, "nodes": []}
    assert movetext.read_game("1. e4 ) {a} e5!? ( d5 {open")["nodes"][1:] == [
        {"ply": 2, "depth": 0, "variation": 0, "move": "e5", "before": [], "after": [], "nags": [5]}, {"ply": 2, "depth": 1, "variation": 1, "move": "d5", "before": [], "after": ["open"], "nags": []}]
    rows = spark.createDataFrame([(1, None), (2, "e4 {a}"), (2, "e4 {a}")], "k int, t string")
    assert sorted((r["k"], r["comment_text"]) for r in movetext.annotated_nodes(rows, "k", "t").collect()) == [(2, "a"), (2, "a")]
    assert movetext.annotated_nodes(rows.limit(0), "k", "t").collect() == []


def test_record_ids_are_those_of_sorted_json(spark):
    import hashlib
    import json

    rows = [('a"b\\', "é\n", None), ("[x]", "", "y")]
    frame = spark.createDataFrame(rows, "b string, a string, c string").select("b", builders.record_id("p_", b=F.col("b"), a=F.col("a"), c=F.col("c")).alias("i"))
    want = {b: "p_" + hashlib.sha256(json.dumps({"b": b, "a": a, "c": c}, sort_keys=True, ensure_ascii=False).encode()).hexdigest()[:16] for b, a, c in rows}
    assert {r["b"]: r["i"] for r in frame.collect()} == want


LINES = ['{"split": null, "text": "a"}', '{"split": "x", "messages": {}, "schema": "conversation"}', '{"messages": [], "split": 1}', "[1]", "broken", None, '{"dialogue": [1]}']


def test_keys_and_shapes(spark):
    rows = variants.parsed(spark.createDataFrame([(i, x) for i, x in enumerate(LINES)], "i int, value string"), "value")
    v = F.col("row")
    got = rows.select("i", v.isNotNull().alias("o"), variants.has_key(v, "split").alias("s"), variants.is_conversation(v).alias("c")).orderBy("i").collect()
    assert [(r["o"], r["s"], r["c"]) for r in got] == [(True, True, False), (True, True, False), (True, True, True), (False, False, False), (False, False, False), (False, False, False), (True, False, True)]
    assert variants.require_consistent(rows.where("i < 3"), "row", "split") and not variants.require_consistent(rows.where("i < 3"), "row", "none")
    with pytest.raises(ValueError):
        variants.require_consistent(rows, "row", "split")
    assert {r["key"]: (r["n"], r["presence"]) for r in variants.key_presence(rows, "row", ["split", "x"]).collect()} == {"split": (3, "some"), "x": (0, "none")}
    shape = variants.shapes(rows.where("i < 1"), "row", "i").first()["shape"]
    assert "text" in shape and "STRING" in shape
    kinds = variants.classified(rows)
    assert {r["i"]: r["kind"] for r in kinds.collect()} == {0: "text_only", **{i: "unusable" for i in range(1, 7)}}
    (row,) = variants.normalized(kinds.withColumn("source", F.lit("s"))).collect()
    assert row["source_row_id"].startswith("row_") and len(row["source_row_id"]) == 20 and row["split_group_id"] is None
    assert variants.inventory(kinds.limit(0).withColumns({"source": F.lit("s"), "file": F.lit("f")}), ["a"]).collect()[0]["rows"] == 0


def test_usable_rows_are_classified_once(spark, counted):
    """A filter of the kind was pushed below what makes it, which read each row again for every use."""
    of, read = counted
    lines = spark.createDataFrame([("own", '{"text": "one", "id": "x"}'), ("own", '{"id": "y"}'), ("own", "no object"), ("own", '{"text": "nameless"}')], "source string, value string")
    rows = variants.normalized(variants.classified(variants.parsed(lines.select("source", of("value").alias("value")), "value")))
    assert [r["source_row_id"] for r in rows.where(~F.col("source_row_id").startswith("row_")).collect()] == ["x"] and read() == 4
