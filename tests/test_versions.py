"""Fingerprints, null controls, regimes."""

import pytest
from pyspark.sql import functions as F

from strandmill.operators import controls, regimes, versions


def test_rows_joined_grow_with_the_change(spark):
    before = spark.range(200_000).select(F.col("id").alias("k"), (F.col("id") * 7 % 1000).alias("v"), F.when(F.col("id") % 3 > 0, "x").alias("s"))
    after = before.where("k <> 77").withColumn("v", F.when(F.col("k") == 5000, -1).otherwise(F.col("v"))).withColumn("s", F.when(F.col("k") == 9, "x").otherwise(F.col("s"))).union(spark.createDataFrame([(-4, 1, "n")], "k long, v long, s string"))
    a, b = versions.suspects(before, after.repartition(9, "v"), "k", ["v", "s"])
    assert 3 <= a.count() <= 8 and 3 <= b.count() <= 8
    found = {tuple(r[:2]): r["changed"] for r in versions.changes(before, after, "k", ["v", "s"]).collect()}
    assert found == {(77, "removed"): [], (5000, "changed"): ["v"], (9, "changed"): ["s"], (-4, "added"): []}
    assert versions.changes(before, before.repartition(3), "k", ["v", "s"]).collect() == []
    assert versions.changes(before.limit(0), before.limit(0), "k", ["v", "s"]).collect() == []
    # a null and a value, values of two columns exchanged, a row twice
    small = lambda rows: spark.createDataFrame(rows, "k long, a string, b string")
    lock = lambda rows: versions.table_lock(small(rows), ["k", "a", "b"]).first()["fingerprint"]
    assert len({lock(r) for r in ([(1, "x", None)], [(1, None, "x")], [(1, "x", None)] * 2, [(1, "", None)], [])}) == 5


@pytest.mark.parametrize("n", [1, 2, 3, 5, 64, 65, 1000, 4097])
def test_permutations_are_one_to_one_and_differ(spark, n):
    places = spark.range(n).select("id", *[controls.feistel(F.col("id"), n, F.lit(s).cast("int")).alias(f"p{s}") for s in range(3)]).collect()
    for s in range(3):
        assert sorted(r[f"p{s}"] for r in places) == list(range(n))
    if n >= 64:
        moved = [sum(r[a] != r[b] for r in places) for a, b in (("id", "p0"), ("p0", "p1"), ("p1", "p2"))]
        assert min(moved) > 0.9 * n


def test_controls_do_not_depend_on_partitions(spark):
    rows = spark.range(300).select("id", F.array(F.col("id") % 7, F.lit(1.0)).alias("a"), F.array(F.col("id") % 5, F.lit(2.0)).alias("b"))
    one, other = (controls.assignments(r, "id", [F.col("id")], 4, 9).collect() for r in (rows, rows.repartition(11)))
    assert {tuple(r) for r in one} == {tuple(r) for r in other} and len(one) == 1200
    values = {r["control"]: r["value"] for r in controls.statistic(rows, "id", "a", "b", spark.createDataFrame(one)).collect()}
    for c in range(1, 5):
        want = sum((r["id"] % 7) * (r["partner"] % 5) + 2.0 for r in one if r["control"] == c) / 300
        assert abs(values[c] - want) < 1e-9
    real = controls.statistic(rows, "id", "a", "b")
    row = controls.falsification(real, spark.createDataFrame([(1, 3, 0.0), (2, 3, 1e9)], "control int, n long, value double")).first()
    assert (row["controls"], row["reached"], row["p"]) == (2, 1, 2 / 3)


def test_regimes_of_rows(spark):
    rows = spark.createDataFrame([(i, "test" if i % 4 == 0 else "train", "ab"[i % 2], None if i % 5 == 0 else f"s{i % 3}") for i in range(120)], "id long, split string, f string, g string")
    made, known = regimes.with_bits(rows, ["f", "g"], "split", 10, 1)
    assert {r["regime"] for r in known.collect()} == {"f:a", "g:s0", "g:s1", "g:s2"}  # no test row has b
    plain = rows.collect()
    for r in known.collect():
        want = {x["id"] for x in plain if (x["split"] == "test") == (x[r["field"]] == r["value"])}
        got = regimes.rows_of(made, known, r["regime"], "split").collect()
        assert {x["id"] for x in got} == want and len(got) == len(want)
        assert sum(x["n"] for x in regimes.sizes(made, known, "split").where(F.col("regime") == r["regime"]).collect()) == len(want)
    with pytest.raises(KeyError):
        regimes.rows_of(made, known, "f:c", "split")
    held = regimes.bitmaps(made, "id").groupBy("number").agg(F.sum(F.bitmap_count("bits")).alias("n")).collect()
    assert {r["n"] for r in held} == {60, 32} and sum(r["n"] for r in held) == 60 + 96


def test_bootstrap_against_plain_loops(spark):
    import numpy as np

    from strandmill.operators import retrieval

    rng = np.random.default_rng(1)
    data = [(int(i), float(rng.normal(0.1))) for i in range(150)]
    row = retrieval.bootstrap(spark.createDataFrame([*data, (None, 5.0), (7000, None)], "k long, d double").repartition(5), "d", "k", 200, 3).first()
    means = []
    for r in range(200):
        draws = [retrieval.poisson_draws(np.array([k]), 200, 3)[0][r] for k, _ in data]
        means.append(sum(t * d for t, (_, d) in zip(draws, data)) / max(1.0, sum(draws)))
    means.sort()
    assert (row["mean"], row["low"], row["high"]) == (round(sum(means) / 200, 6), round(means[int(0.025 * 199)], 6), round(means[int(0.975 * 199)], 6))


@pytest.mark.parametrize("least", [3, 10**6])
def test_left_join_of_hot_and_null_keys(spark, least):
    from strandmill.operators.ranking import left_join_split

    rows = spark.createDataFrame([(i, "hot" if i % 3 == 0 else None if i % 3 == 1 else f"k{i}") for i in range(60)], "i int, k string")
    side = spark.createDataFrame([("hot", 1), ("k2", 2), ("k5", None), ("other", 3)], "k string, v int")
    want = {(i, {"hot": 1, "k2": 2}.get(k)) for i, k in ((r["i"], r["k"]) for r in rows.collect())}
    found = left_join_split(rows, side, "k", least=least, parts=10).collect()
    assert {(r["i"], r["v"]) for r in found} == want and len(found) == 60
