"""Small cases of sidecars, run summaries and reports: nulls, ties, empty tables."""

import pytest
from pyspark.sql import functions as F

from strandmill.functions import scoring, text as t
from strandmill.operators import ranking, reports, retrieval, runs, sidecars

EVALUATION = "fen string, depth int, cp int, mate int, pv string, evals array<struct<depth:int,pvs:array<struct<cp:int,mate:int,line:string>>>>"
BOARD = "8/8/8/8/8/8/8/K1k5 w - - 0 1"


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_prompt_functions(spark):
    prompt = F.lit('The FEN of the board is "8/8 w - -" MoveA:e2e4, a plan, in the center TacticA: e2e4 e7e5 MoveB:a7a8q, a queen')
    assert one(spark, t.quoted_position(prompt)) == "8/8 w - -"
    assert one(spark, t.named_moves(F.lit("MoveA:e2e4 MoveB:a7a8q MoveC:e2e4"))) == ["e2e4", "a7a8q"]
    assert one(spark, t.option_texts(prompt, "strategy")) == "A: a plan, in the center || B: a queen"
    assert one(spark, t.option_texts(prompt, "tactic")) == "A: e2e4 e7e5"
    assert one(spark, t.preferred_option(F.lit("MoveB:a7a8q"))) == "B"
    for f in (t.quoted_position, t.preferred_option, lambda x: t.option_texts(x, "tactic")):
        assert one(spark, f(F.lit(None).cast("string"))) is None
    assert one(spark, t.named_moves(F.lit(None).cast("string"))) == []


def test_snippets_and_character_ids(spark):
    assert one(spark, t.snippet(F.lit("x" * 100 + " Fork here " + "y" * 100), "fork", 20)) == "x" * 9 + " Fork here yyyy"
    assert one(spark, t.snippet(F.lit("none"), "fork", 20)) == "none"
    assert one(spark, t.character_ids(F.lit("ab?"), "aab", 5)) == [2, 3, 1, 0, 0]
    assert one(spark, t.character_ids(F.lit(None).cast("string"), "ab", 2)) == [0, 0]


def test_evaluations(spark):
    rows = spark.createDataFrame([
        (BOARD, 3, 10, None, "e2e4 e7e5", None),
        (BOARD, None, 7, None, None, [(20, [(1, None, "a2a3")]), (24, [(None, 2, "b2b3 b7b6"), (9, None, "h2h3")]), (24, [(5, None, "c2c3")])]),
        (None, 1, 1, None, None, None), (BOARD, 1, None, None, None, [(9, [])])], EVALUATION)
    found = [tuple(r)[1:] for r in sidecars.flat_evaluations(rows).collect()]
    assert found == [(3, 10, None, "e2e4"), (24, None, 2, "b2b3"), (9, None, None, None)]
    assert sidecars.flat_evaluations(rows.limit(0)).count() == 0
    assert one(spark, sidecars.value_of(F.lit(None).cast("int"), F.lit(-3))) == -100_000


def test_prompt_rows(spark):
    rows = spark.createDataFrame([(1, 'FEN "x" MoveA:e2e4', "MoveA:e2e4"), (2, "MoveA:e2e4", None), (3, 'FEN "x"', None), (4, None, None)], "id int, p string, a string")
    kept, ledger = sidecars.prompt_rows(rows, "p", "a", "id")
    assert [(r["id"], r["preferred_option"], r["preferred_move"]) for r in kept.collect()] == [(1, "A", "e2e4")]
    assert {r["id"]: r["drop_reason"] for r in ledger.collect()} == {2: "missing_position", 3: "missing_moves", 4: "missing_position"}


def test_source_families(spark):
    schema = "given string, source string, site string, event string, annotator string, file string"
    rows = spark.createDataFrame([
        ("My Own!", "s", None, None, None, None), (None, "waterhorse_annotated_pgn_1", "https://www.chess.example/1", None, None, None), (None, "waterhorse_annotated_pgn", "?", "My Open 2020", None, "f.pgn"),
        (None, "waterhorse_annotated_pgn", None, "?", None, None), (None, "s", "https://x.org", None, None, "a/b/Games 1.jsonl"), ("", "mate_dataset_Tactic", "", None, None, "f.zip"), ("", "s", "", None, None, ""), (None, None, None, None, None, None)], schema)
    found = [r[0] for r in rows.select(sidecars.source_family("given", "source", "site", "event", "annotator", "file")).collect()]
    assert found == ["my_own", "chess.example", "waterhorse::my_open_2020", "waterhorse::unknown", "games_1", "mate_dataset_tactic", "s", "unknown"]


def test_game_rules(spark):
    games = spark.createDataFrame([("Standard", "yes", "x", 40), (None, "", "Rated Blitz", 40), ("From Position ", "1", "", 40), ("CHESS", "true", "", 2), ("Atomic", "1", "", 40), ("", "no", "casual", 40), ("standard", "1", "", 400)], "v string, r string, e string, n int")
    found = [tuple(r) for r in games.select(sidecars.game_reasons(F.col("v"), sidecars.rated_game(F.col("r"), F.col("e")), F.col("n"), 4, 300), sidecars.standard_annotated_game(F.col("v"))).collect()]
    assert found == [(None, True), (None, True), (None, False), ("too_short_game", False), ("non_standard_variant", False), ("unrated_game", True), ("too_long_game", False)]


def test_gates(spark):
    gate = lambda *x: one(spark, scoring.verification_gate(*map(F.lit, x)))
    assert [gate(1, 0, 0), gate(0, 1, 0), gate(0, 0, 1), gate(0, 0, 0)] == ["NOT_VERIFIED", "NOT_VERIFIED", "VERIFIED_BUT_NEEDS_SANITY_AUDIT", "VERIFIED_GOOD"]
    ready = lambda a, b, c, r, leak: one(spark, scoring.readiness({"train": F.lit(a), "val": F.lit(b), "test": F.lit(c)}, {"val": F.lit(r), "test": F.lit(r)}, F.lit(leak)))
    assert [ready(100, 25, 25, 1, 0), ready(99, 25, 25, 1, 0), ready(100, 25, 25, 0, 0), ready(100, 25, 25, 1, 1)] == ["ready", "partially_ready", "not_ready", "not_ready"]


def test_epochs(spark):
    rows = spark.createDataFrame([("a", 1, 0.5, 0.2), ("a", 2, 0.5, 0.9), ("a", 3, 0.7, 0.9)], "run string, epoch int, nll double, g double")
    r = runs.best_epochs(rows, "run", "epoch", "nll", ["g"]).first()
    assert (r["policy_epoch"], r["grounding_epoch"], r["same_epoch"]) == (1, 2, False)
    with pytest.raises(Exception, match="lacks a metric"):
        runs.best_epochs(rows.withColumn("g", F.when(F.col("epoch") < 3, F.col("g"))), "run", "epoch", "nll", ["g"]).collect()


def test_places_of_hot_groups_with_nulls(spark):
    rows = spark.createDataFrame([("hot", i % 7, i) for i in range(500)] + [(None, 1, 900), (None, 0, 901)], "g string, v int, id int")
    found = {r["id"]: r["place"] for r in ranking.placed(rows, "g", [F.desc("v"), F.col("id")]).collect()}
    want = {x[1]: i for i, x in enumerate(sorted((-(i % 7), i) for i in range(500)))} | {900: 0, 901: 1}
    assert found == want
    assert ranking.placed(rows.limit(0), (), [F.col("id")]).count() == 0


def test_average_precision_without_groups_and_with_null_ones(spark):
    rows = spark.createDataFrame([(None, 0.9, 1, 1), (None, 0.8, 0, 2), (None, 0.7, 1, 3), ("none", 0.1, 0, 4)], "g string, s double, hit int, id int")
    assert {r["g"]: (r["positives"], r["ap"]) for r in retrieval.average_precision(rows, "g", "s", "hit", "id").collect()} == {None: (2, 0.833333), "none": (0, 0.0)}
    assert retrieval.average_precision(rows, (), "s", "hit", "id").first()["positives"] == 2


def test_permutation_is_one_to_one(spark):
    rows = spark.range(200)
    found = ranking.permutation(rows, "id", "x").collect()
    assert sorted(r["id"] for r in found) == sorted(r["partner"] for r in found) == list(range(200))
    assert sum(r["id"] == r["partner"] for r in found) < 10


def test_reports_of_empty_tables(spark):
    empty = spark.createDataFrame([], "id long, text string, split string, labels array<string>, g string")
    assert {r["support"] for r in reports.keyword_support(empty, "text", "id").collect()} == {0}
    assert reports.split_strategy(empty, "g").first()["fallback_reason"] == "no_group_keys"
    assert reports.label_coverage(empty, "labels", "split").count() == 0
    assert reports.repeated_identities(empty, "id").first()["n"] == 0
    assert reports.comment_report(empty, "g", "text", [], "split").count() == 0


def test_verified_counts_what_is_missing(spark):
    want = spark.createDataFrame([("a", 1), ("b", 2), ("c", None)], "k string, n int")
    r = reports.verified(want, spark.createDataFrame([("a", 2), ("c", None)], "k string, n int"), ["k"], "n").first()
    assert (r["artifacts"], r["missing"], r["mismatched"], r["gate"]) == (3, 1, 1, "NOT_VERIFIED")


def test_duplicates_by_bucket_score_each_text_once(spark, counted):
    of, read = counted
    rows = spark.createDataFrame([("Same one!", "low"), ("same  one", "high"), ("same one", "high"), ("own", "low"), ("", "low"), ("?", "low"), (None, "high")], "text string, kind string")
    found = reports.duplicates_by_bucket(rows.select("text", of("kind").alias("bucket")), "text", "bucket").collect()
    assert {tuple(r) for r in found} == {("low", 4, 1.5, 0.25), ("high", 3, 2.333333, 0.666667)} and read() == 7
