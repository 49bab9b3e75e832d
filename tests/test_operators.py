"""Small cases of functions and operators: nulls, ties, hot groups, empty tables."""

import bz2
import json
import lzma
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandmill.functions import scoring, text as t
from strandmill.functions.hashing import SplitConfig
from strandmill.operators import alignment, boards, chat, dedup, ranking, retrieval, stats
from strandmill.sources import readers, sinks
from strandmill.streaming import flows


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_normalised_views(spark):
    text = F.lit("Attack!!   $1")
    assert [one(spark, t.normalize(text, m)) for m in ("lower_ws", "punct_light", "nag_stripped")] == ["attack!! $1", "attack 1", "attack"]
    assert one(spark, t.normalize(F.lit(None).cast("string"), "raw")) == ""
    with pytest.raises(ValueError):
        t.normalize(text, "other")


def test_small_text_functions(spark):
    assert one(spark, t.split_list(F.lit("a, b,,c d"))) == ["a", "b", "c", "d"]
    assert one(spark, t.split_list(F.lit("a,b c,".replace(" ", "")))) == ["a", "bc"]
    assert one(spark, t.option_map(F.lit("A: x || B: y || A: z"))) == {"B": "y", "A": "z"}
    assert one(spark, t.slug(F.lit("  Two  Words!! "))) == "two_words"
    assert one(spark, t.slug(F.lit("!!"))) == "unknown"
    assert one(spark, t.domain(F.lit("https://www.Example.org/a?b"))) == "example.org"
    assert one(spark, t.domain(F.lit("no domain"))) is None
    assert [one(spark, t.domain(F.lit(x))) for x in ("a.org?x", "https://b.org?x", "www.c.org/p", "nohost", "x://")] == ["a.org?x", "b.org", "c.org", None, None]
    assert one(spark, t.clip(F.lit("abcdef ghi"), 8)) == "abcde..."
    assert one(spark, t.spaced_tag(F.lit("discoveredAttack_now"))) == "discovered attack now"
    assert one(spark, t.between(F.lit("a START b END c"), "START", ["END"])).strip() == "b"


def test_scoring_rules(spark):
    sizes = spark.createDataFrame([(n,) for n in (150, 437, 500, 1000)], "n long")
    assert [r[0] for r in sizes.orderBy("n").select(scoring.pool_class(F.col("n"))).collect()] == ["exploratory_only", "secondary_shared", "primary_shared", "strong_primary"]
    rows = spark.createDataFrame([(1, "[%eval 0.3]"), (2, "1-0"), (3, "!?"), (4, "Inaccuracy. Nf3 was best."), (5, None), (6, "A plain remark on the position")], "id long, text string")
    found = {r["id"]: r["categories"] for r in scoring.boilerplate(rows.withColumn("n", F.lit(1)), "text", "n").collect()}
    assert found == {1: ["markup_only", "pgn_markup_heavy"], 2: ["result_comment"], 3: ["symbol_only"], 4: ["engine_template"], 5: [], 6: []}


def test_percentiles_round_half_even(spark):
    rows = spark.createDataFrame([("a", v) for v in (1, 2, 3, 4)] + [("b", None)], "g string, v int")
    found = stats.distribution(rows, "g", "v", (0.5,)).collect()
    assert [(r["g"], r["n"], r["p50"]) for r in found] == [("a", 4, 3)]  # 1.5 rounds to 2, the third value


def test_caps_and_quotas(spark):
    rows = spark.createDataFrame([("hot", i) for i in range(3000)] + [("few", i) for i in range(3)], "g string, i long")
    order = [F.col("i")]
    assert ranking.cap(rows, "g", order, 0).count() == 3003
    assert ranking.cap(rows, "g", order, 1500).count() == 1503  # the salted way
    assert ranking.cap_with_minimum(rows, "g", order, 1, 2).count() == 4
    sizes = spark.createDataFrame([("t", "a", 5), ("t", "b", 3), ("t", "c", 2)], "split string, s string, n long")
    assert {r["s"]: r["quota"] for r in ranking.quotas(sizes, "split", "s", 4).collect()} == {"a": 2, "b": 1, "c": 1}
    assert {r["quota"] for r in ranking.quotas(sizes, "split", "s", 0).collect()} == {0}
    assert sum(r["quota"] for r in ranking.quotas(sizes, "split", "s", 100).collect()) == 10


def test_best_of_ties_is_the_first(spark):
    rows = spark.createDataFrame([("k", 5, 1, "first"), ("k", 5, 2, "second"), ("k", 3, 0, "less")], "k string, depth int, o int, p string")
    assert ranking.best_by(rows, "k", ["depth"], "o", ["p"]).first()["p"] == "first"


def test_dedup_of_empty_texts_and_ties(spark):
    rows = spark.createDataFrame([(1, "x"), (2, "x"), (3, ""), (4, ""), (5, None)], "id long, t string").withColumn("key", dedup.digest(t.text_of("t")))
    kept = dedup.dedup(rows, F.col("key"), [], "id", 1, "s")
    assert sorted(r["cluster_size"] for r in kept.collect()) == [1, 1, 1, 2]
    assert dedup.duplicate_summary(rows, "key").first()["duplicate_rows"] == 1
    assert dedup.duplicate_summary(rows.limit(0), "key").count() <= 1


def test_alignment_cascade(spark):
    base = spark.createDataFrame([(1, "f1", "l1", "m1", "train"), (2, "f1", "l1", "m2", "val"), (3, "f3", "l3", "m1", "train")], "id long, e string, l string, x string, split string")
    rows = spark.createDataFrame([("a", "f1", "l1", None), ("b", "f1", "l1", "m2"), ("c", "zz", "l3", None), ("d", "zz", "zz", None)], "r string, e string, l string, x string")
    found = {r["r"]: (r["alignment_type"], r["matched_id"], r["note"]) for r in alignment.align(rows, base, "e", "l", "x", "split", ["id"]).collect()}
    assert found == {"a": ("unmatched", None, "cross_split_ambiguity"), "b": ("exact_extra", 2, None), "c": ("loose", 3, None), "d": ("unmatched", None, "no_base_match")}


def test_hygiene_and_shared_keys(spark):
    rows = spark.createDataFrame([(1, "g", "train"), (2, "g", "test"), (3, "h", "test")], "id long, g string, split string")
    assert [r["g"] for r in alignment.split_hygiene(rows, "g", "split").collect()] == ["g"]
    kept = alignment.restrict_test(rows, spark.createDataFrame([(3,)], "id long"), "id", "split")
    assert sorted(r["id"] for r in kept.collect()) == [1, 3]


def test_derangement(spark):
    rows = spark.createDataFrame([(i, i % 3) for i in range(9)], "id long, label int")
    partner = {r["id"]: r["partner"] for r in ranking.derangement(rows, "label", [F.col("id")], "id").collect()}
    assert sorted(partner.values()) == list(range(9)) and all(a % 3 != b % 3 for a, b in partner.items())
    with pytest.raises(ValueError):
        ranking.derangement(rows.withColumn("label", F.lit(1)), "label", [F.col("id")], "id")


def test_ranks_with_ties(spark):
    q = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "id long, v array<double>")
    k = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [1.0, 0.0])], "id long, v array<double>")
    assert sorted(tuple(r) for r in retrieval.ranks(q, k).collect()) == [(1, 1, 2, 2), (2, 1, 1, 1)]
    import math

    for z in (0.0, 0.1, 0.5, 1.0, 1.959964, 3.0, 5.0):
        assert abs(one(spark, retrieval.sign_p(F.lit(z), F.lit(9))) - math.erfc(z / math.sqrt(2))) < 2e-7
    assert one(spark, retrieval.sign_p(F.lit(0.0), F.lit(0))) == 1.0
    signs = spark.createDataFrame([(1.0,), (-1.0,), (0.0,)], "d double")
    assert retrieval.sign_statistics(signs, "d").first()["z"] == round(0.5 / math.sqrt(2 / 4), 6)


def test_boards(spark):
    corners = spark.createDataFrame([(s,) for s in (0, 7, 56, 63)], "s int")
    assert [tuple(r) for r in corners.orderBy("s").select(boards.square_row(F.col("s")), boards.square_column(F.col("s"))).collect()] == [(7, 0), (7, 7), (0, 0), (0, 7)]
    assert one(spark, boards.position_key(F.lit("8/8 w - - 0 1"))) == "8/8 w - -"
    assert one(spark, boards.position_key(F.lit("8/8 w"))) is None
    assert one(spark, boards.move_parts(F.lit("e2"))) is None


def test_chat(spark):
    rows = spark.createDataFrame([(1, 0, "human", " hi "), (1, 1, "gpt", "yo"), (2, 0, "user", " ")], "c long, n long, role string, text string")
    found = {r["c"]: r["messages"] for r in chat.conversations(rows, "c", "n", "role", "text").collect()}
    assert [(m["role"], m["content"]) for m in found[1]] == [("user", "hi"), ("assistant", "yo")] and found[2] is None
    assert one(spark, chat.flatten_text(F.lit("a"), F.lit(None).cast("string"), F.lit(" b "))) == "a\nb"


def test_readers(spark, tmp_path):
    lines = '{"a": 1}\n\n{"a": 2}\n'
    (tmp_path / "x.jsonl").write_text(lines)
    (tmp_path / "x.jsonl.xz").write_bytes(lzma.compress(lines.encode()))
    (tmp_path / "x.jsonl.bz2").write_bytes(bz2.compress(lines.encode()))
    (tmp_path / "x.json").write_text(json.dumps({"records": [{"a": 1}, {"a": 2}]}))
    (tmp_path / "x.csv").write_text("a,b\n1,2\n2,3\n")
    with zipfile.ZipFile(tmp_path / "x.zip", "w") as z:
        z.writestr("in/x.jsonl", lines)
        z.writestr("__MACOSX/._x.jsonl", "junk")
    for name in ("x.jsonl", "x.jsonl.xz", "x.jsonl.bz2", "x.json", "x.csv", "x.zip"):
        assert sorted(int(r["a"]) for r in readers.read_rows(spark, str(tmp_path / name), "a long").collect()) == [1, 2], name
    with pytest.raises(ValueError):
        readers.read_rows(spark, "x.pkl", "a long")
    assert readers.file_catalog(spark, str(tmp_path), "*.csv").count() == 1


def test_split_sets_and_sinks(spark, tmp_path):
    root = tmp_path / "set"
    root.mkdir()
    (root / "train.jsonl").write_text('{"a": 1, "b": null}\n')
    with pytest.raises(Exception):
        readers.read_split_set(spark, str(root), "a long, b long").collect()
    rows = readers.read_split_set(spark, str(root), "a long, b long, split string", lenient=True)
    assert [r["split"] for r in rows.collect()] == ["train"]
    assert sinks.write_jsonl(rows, str(tmp_path / "out")) == 1
    assert '"b":null' in "".join(p.read_text() for p in (tmp_path / "out").glob("part*"))
    assert sinks.write_variants({"v": rows}, rows.select("a"), str(tmp_path / "tree"), "v") == {"v": 1}
    sinks.write_report(rows.select(F.struct("a").alias("s")), str(tmp_path / "report"), "T")
    assert (tmp_path / "report" / "md").exists()


def test_games(spark, tmp_path):
    (tmp_path / "g.pgn").write_text('[Event "A"]\n[Site "x"]\n\n1. e4 e5 1-0\n\n[Event "B"]\n\n1. d4 *\n')
    found = readers.read_games(spark, str(tmp_path / "g.pgn")).collect()
    assert sorted(r["headers"]["Event"] for r in found) == ["A", "B"] and {r["moves"] for r in found} == {"1. e4 e5 1-0", "1. d4 *"}


def test_settings():
    assert readers.merge_settings({"a": {"b": 1, "c": [1]}}, {"a": {"c": [2]}, "d": 0}) == {"a": {"b": 1, "c": [2]}, "d": 0}
    with pytest.raises(ValueError):
        SplitConfig(0.9, 0.2)


def test_stream_first_arrivals(spark, tmp_path):
    rows = spark.createDataFrame([("Same text", "2024-01-01 00:00:00"), ("same  TEXT!", "2024-01-01 00:10:00"), ("other", "2024-01-01 00:20:00")], "text string, at string")
    rows.withColumn("at", F.col("at").cast("timestamp")).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = flows.stream_table(spark, str(tmp_path / "in"), "*.parquet")
    flows.run_available(flows.first_arrivals(stream, "text", "at"), "arrived", str(tmp_path / "state"))
    assert spark.table("arrived").count() == 2


def test_similarity_in_several_blocks_loses_no_query(spark):
    """Over 2,048 queries, so that several blocks are asked, and shuffle partitions that are not put together."""
    rng = np.random.default_rng(5)
    a, b = rng.normal(size=(2, 2100, 4))
    b[1000:1010] = b[0]
    a, b = (x / np.linalg.norm(x, axis=1, keepdims=True) for x in (a, b))
    frame = lambda x: spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>")
    scores = np.round(a @ b.T, 9)
    own = np.diag(scores)[:, None]
    above, ties = (scores > own).sum(1), (np.abs(scores - own) <= 1e-6 + 1e-6 * np.abs(own)).sum(1)
    best = {(i, j + 1): k for i, row in enumerate(scores) for j, k in enumerate([k for k in np.argsort(-row, kind="stable")[:4] if k != i][:3])}
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    try:
        assert {r["id"]: (r["rank"], r["strict_rank"], r["ties"]) for r in retrieval.ranks(frame(a), frame(b)).collect()} == {i: (1 + above[i], above[i] + ties[i], ties[i]) for i in range(len(a))}
        assert {(r["query_id"], r["rank"]): r["key_id"] for r in retrieval.top_pairs(frame(a), frame(b), 3).collect()} == best
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_nine_decimals_as_the_sql_rounds(spark):
    assert retrieval.nine(np.array([0.1234567885, -0.1234567885, 1e-10, 0.5])).tolist() == [0.123456789, -0.123456789, 0.0, 0.5]
    assert [one(spark, F.round(F.lit(x) * 1e6) / 1e6) for x in (0.5053945, 0.5053946)] == [0.505394, 0.505395]


def test_stream_of_a_table_in_one_file_or_many(spark, tmp_path):
    from strandmill.plans import catalog

    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows.repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    query = catalog.queries()["stream_splits"]
    many, single = (sorted(map(tuple, query(spark, d).collect())) for d in (str(tmp_path), "/root/testdata/sf0.001"))
    assert many == single and len(many) == rows.count()


def test_caps_keep_the_first_rows_by_the_order_given(spark):
    """Copies differ in source and length, so which three stay shows."""
    from strandmill.operators import audits

    rows = spark.createDataFrame([(i, "train", f"s{i}", "a word of the " + " " * i + "wise and other words " + "!" * i) for i in range(8)], "id long, split string, source string, text string")
    found = audits.before_and_after(rows, "text", "id", "split", "source", order=[F.col("id")])
    assert sorted(r["value"] for r in found.where("variant = 'template_capped' and scope = 'source'").collect()) == ["s0", "s1", "s2"]


def test_permutation_is_the_one_of_a_walk_in_one_piece(spark):
    """Walks of four steps and then of the rest take the places that walks of 96 steps took."""
    from strandmill.operators import controls

    places = [r["to"] for r in spark.range(33).select("id", controls.feistel(F.col("id"), 33, F.lit(18)).alias("to")).orderBy("id").collect()]
    assert sorted(places) == list(range(33)) and places == [3, 25, 16, 1, 7, 30, 31, 11, 2, 24, 20, 32, 0, 12, 15, 27, 8, 21, 28, 17, 5, 23, 29, 14, 26, 4, 22, 10, 9, 19, 6, 13, 18]


def test_running_cap_over_hours_and_groups(spark, tmp_path):
    """Rows of several hours are due at once; a null group stays null, and the last hours stay open."""
    from strandmill.streaming import stateful

    rows = [(g, 10 * h + i, f"2024-01-01 {h:02d}:{10 * i:02d}:00", 9.0 if i else 1.0) for g in ("a", None) for h in range(4) for i in range(3)] + [("z", 99, "2024-01-01 06:30:00", 9.0)]
    spark.createDataFrame(rows, "group string, id long, at string, value double").selectExpr("group", "id", "cast(at as timestamp) ts", "value").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = flows.stream_table(spark, str(tmp_path / "in"))
    flows.append_files(stateful.running_cap(stream, 5.0, 2, 2, parts=2), str(tmp_path / "out"), str(tmp_path / "state"))
    outcomes = {0: "below_least", 1: "kept", 2: "off_stride", 10: "below_least", 11: "kept", 12: "off_stride", 20: "below_least", 21: "over_cap", 22: "off_stride", 30: "below_least", 31: "over_cap", 32: "off_stride"}
    found = spark.read.parquet(str(tmp_path / "out")).collect()
    assert len(found) == 24 and {(r["group"], r["id"], r["outcome"]) for r in found} == {(g, i, o) for g in ("a", None) for i, o in outcomes.items()}


def test_distribution_works_out_its_values_once(spark, counted):
    """As a filter of the value is pushed below the projection, nulls were left out at the price of a second pass over texts."""
    of, read = counted
    rows = spark.createDataFrame([("a", "1"), ("a", "3"), ("a", None), ("b", None), (None, "2")], "g string, text string")
    found = stats.distribution(rows.select("g", of("text").cast("double").alias("v")), "g", "v", (0.5,)).collect()
    assert {r["g"]: tuple(r)[1:] for r in found} == {"a": (2, 2.0, 3.0, 1.0), None: (1, 2.0, 2.0, 2.0)} and read() == 5
    weighted = spark.createDataFrame([("a", 1.0, 2), ("a", 2.0, 1), ("a", None, 9)], "g string, v double, w long")
    assert [tuple(r) for r in stats.distribution(weighted, "g", "v", (0.5,), "w").collect()] == [("a", 3, 1.333333, 2.0, 1.0)]


def test_symbols_are_counted_by_characters(spark):
    rows = spark.createDataFrame([("\U0001F600 ab, \U0001D400\u00e9 1!\u00a0?",), ("abc",), ("",), (None,)], "text string")
    assert [r["symbol_ratio"] for r in scoring.informativeness(rows, "text").select("symbol_ratio").collect()] == [4 / 13, 0.0, 0.0, 0.0]
