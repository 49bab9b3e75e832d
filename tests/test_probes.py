"""Rankings from one scan, probe rows, settings, choices."""

import random

import pytest
from pyspark.sql import functions as F

from strandmill.operators import rankings, reports, targets
from strandmill.sources import readers, sinks
from strandmill.sources.shared import fresh


@pytest.mark.parametrize("held", [3, 10**6])
def test_top_many_against_sorting(spark, monkeypatch, held):
    monkeypatch.setattr(rankings, "HELD", held)
    rng = random.Random(5)
    data = [(i, rng.choice("ab") if i % 9 else None, rng.choice([None, 1.0, 2.0, 3.5]), rng.randint(0, 4)) for i in range(500)]
    rows = spark.createDataFrame(data, "i int, g string, x double, y int").repartition(6)
    found = rankings.top_many(rows, [rankings.Ranking("down", ((F.col("x"), True), (F.col("y"), False)), 4), rankings.Ranking("up", ((F.col("y"), False),), 30, F.col("x") > 1)], "i", "g", ("x",))
    assert found._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    want = set()
    for g in (None, "a", "b"):
        own = [d for d in data if d[1] == g]
        down = sorted(own, key=lambda d: (-d[2] if d[2] is not None else float("inf"), d[3], d[0]))[:4]
        up = sorted((d for d in own if d[2] is not None and d[2] > 1), key=lambda d: (d[3], d[0]))[:30]
        want |= {(n, g, p + 1, d[0], d[2]) for n, r in (("down", down), ("up", up)) for p, d in enumerate(r)}
    assert {tuple(r) for r in found.collect()} == want
    assert rankings.top_many(rows.limit(0), [rankings.Ranking("a", ((F.col("x"), True),))], "i").collect() == []


def test_settings_are_read_merged_and_rolled_up(spark):
    root = fresh(spark, "settings")
    sinks.write_yaml(spark, {"a": {"b": [1, 2], "c": "x: y"}, "report": {"drop_reasons": {"r": 2, "s": 1}}}, f"{root}/1.yaml")
    sinks.write_yaml(spark, {"a": {"b": [3]}, "d": None, "report": {"drop_reasons": {"r": 5}}}, f"{root}/2.yaml")
    sinks.write_file(spark, "", f"{root}/3.yaml")
    assert readers.load_settings(spark, f"{root}/1.yaml", f"{root}/2.yaml", f"{root}/3.yaml") == {"a": {"b": [3], "c": "x: y"}, "report": {"drop_reasons": {"r": 5, "s": 1}}, "d": None}
    assert {r["reason"]: r["n"] for r in reports.summed_drop_reasons(readers.read_settings(spark, f"{root}/*.yaml")).collect()} == {"r": 7, "s": 1}
    sinks.write_file(spark, "a: [", f"{root}/bad.yaml")
    with pytest.raises(Exception, match="bad.yaml is no YAML"):
        readers.read_settings(spark, f"{root}/bad.yaml").collect()


def test_small_rules(spark):
    assert targets.merged_keywords({"a": ("x", "y"), "b": ("z",)}, {"b": ("w", "z"), "c": ("v",)}) == {"a": ("x", "y"), "b": ("z", "w"), "c": ("v",)}
    rows = spark.createDataFrame([(1, "a"), (2, "b"), (None, "c")], "k int, v string")
    with pytest.raises(KeyError):
        targets.gathered(rows, spark.createDataFrame([(1, 0.5)], "k int, e double"), "k").collect()
    results = spark.createDataFrame([("r", 0.5, 10, "a"), ("r", 0.5, 10, "b"), ("r", 0.5, 20, "c"), ("s", None, 1, "d")], "r string, m double, n int, b string")
    assert sorted((r["r"], r["b"]) for r in targets.best_choices(results, "r", "m", "n", "b").collect()) == [("r", "b"), ("s", "d")]
    game = spark.range(1).select(targets.position_record(F.lit("g"), F.lit(3), F.lit("f"), F.lit("e2e4"), F.lit(None).cast("string"), F.lit(None).cast("array<string>")).alias("p")).first()["p"]
    assert game["game_id"] == "g" and game["concept_tags"] == [] and game["position_id"].startswith("pos_")
