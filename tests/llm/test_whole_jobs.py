"""Jobs done in full: pairs between the bounds of the contract and the stage, values and groups of any length."""

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from strandmill.llm import language, ngram_join, secrets


def grouped(texts, size, percent):
    """Components by brute force: the smallest key of each."""
    words = {i: t.lower().split() for i, t in texts}
    sets = {i: {tuple(w[k:k + min(size, len(w))]) for k in range(len(w) - min(size, len(w)) + 1)} for i, w in words.items()}
    root = {i: i for i in sets}

    def find(x):
        return x if root[x] == x else find(root[x])

    for a in sets:
        for b in sets:
            if a < b and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: find(i) for i in sets}


def between_bounds():
    """Texts of many lengths, each with copies that have text appended or words changed one by one."""
    out, key = [], 0
    for n in (8, 20, 47, 130, 400, 1500, 4000):
        for copy in range(3):
            words = [f"w{n}x{copy}x{i}" for i in range(n)]
            out.append((key, " ".join(words)))
            for j, extra in enumerate((0.1, 0.16, 0.24, 0.3)):
                out.append((key + 1 + j, " ".join(words + [f"new{key}x{i}" for i in range(int(n * extra))])))
            for j, every in enumerate((80, 50, 46, 30)):
                out.append((key + 5 + j, " ".join(f"c{key}x{i}" if i % every == every // 2 else w for i, w in enumerate(words))))
            key += 10
    return out


def test_stage_of_near_copies_takes_five_words_and_four_fifths(spark):
    import corpus_pipeline

    texts = between_bounds()
    frame = spark.createDataFrame(texts, "doc_id long, text string")
    wanted = grouped(texts, 5, 80)
    assert len(set(wanted.values())) < len(set(grouped(texts, 3, 90).values()))
    kept = corpus_pipeline.ngram_join(spark, frame, "").collect()
    assert sorted(r["doc_id"] for r in kept) == sorted(set(wanted.values()))


@pytest.mark.parametrize("percent", [60, 80, 85, 90])
def test_linked_sets_share_a_block(percent):
    import numpy as np

    rng, bounds = np.random.default_rng(percent), ngram_join.Bounds(percent)
    for n in [*range(4, 60), 200, 900, 3000] * 4:
        grams = rng.integers(0, 2**64, n, np.uint64)
        for _ in range(8):
            gone = int(rng.integers(0, n * (100 - percent) // 100 + 1))
            most = 100 * (n - gone) // percent - n  # so many new ones leave the Jaccard at the bound
            other = np.unique(np.concatenate((grams[gone:], rng.integers(0, 2**64, max(0, most), np.uint64))))
            one = np.unique(grams)
            if not np.array_equal(one, other):
                assert len(np.intersect1d(bounds.blocks(one), bounds.blocks(other)))


def values(text):
    return [text[a:b] for a, _, k, b, _ in secrets.find_secrets(text) if k == "literal"]


@pytest.mark.parametrize("line, value", [
    ("aws_secret_access_key = wJalrXUtnFEMI/K7MDENG/bPxRfiCYEXAMPLEKEY", "wJalrXUtnFEMI/K7MDENG/bPxRfiCYEXAMPLEKEY"),
    ("DB_PASSPHRASE=ab1cd-efgh-9999-zzzz", "ab1cd-efgh-9999-zzzz"), ("signing_key=abcd1234efgh+tail==", "abcd1234efgh+tail=="),
    ("a = b = signing_key = hunter2x9/q", "hunter2x9/q"), ("run = tool-signing_key=abc123def456", "abc123def456"),
])
def test_unquoted_values_are_whole(line, value):
    assert values(f"x\n{line}\ny\n") == [value]
    spans = secrets.find_secrets(line)
    assert value not in secrets.redacted(line, spans) and secrets.redacted(line, spans).endswith("[REDACTED]")


def test_names_and_calls_are_no_literals():
    assert values('KEY_A = "x9f3kq81mzt7"\nsigning_key = KEY_A.\n') == ["x9f3kq81mzt7"]
    assert values('KEY_A = "x9f3kq81mzt7"\nsigning_key=KEY_A+tail0123\n') == ["x9f3kq81mzt7", "KEY_A+tail0123"]
    assert values('passphrase = config.get("x")\nsigning_key = other_name\n') == []


@pytest.mark.parametrize("quote", ['"', "'", ""])
def test_long_literals_are_whole(quote):
    value = "aB3/" * 2_500
    text = f"private_key = {quote}{value}{quote}\nend"
    assert values(text) == [value] and secrets.redacted(text, secrets.find_secrets(text)) == f"private_key = {quote}[REDACTED]{quote}\nend"


@pytest.mark.parametrize("name", ["DB_PASS_WORD", "pass-phrase", "pass_wd", "p.w.d", "to_ken", "API_k_e_y"])
def test_parted_names_are_seen(name):
    assert secrets.name_weight(name) > 0 and values(f'{name} = "x9f3kq81mzt7"') == ["x9f3kq81mzt7"]


def test_every_labelled_language_is_learned(spark):
    rows = [(i, "some plain words of a common tongue", "en") for i in range(3000)] + [(i, "ein paar einfache Worte", "de") for i in range(3000, 3400)]
    rows += [(3400 + i, "несколько простых слов", f"rare{i}") for i in range(6)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    names, profiles = language.fit_profiles(frame, max_docs=60)
    assert names == ["de", "en", *(f"rare{i}" for i in range(6))] and profiles.shape[0] == 8
    assert language.equal_shares({"a": 1000, "b": 3, "c": 50}, 60) == {"b": 3, "c": 28, "a": 29}
    assert language.equal_shares({"a": 5, "b": 5}, 1) == {"a": 1, "b": 1}


def test_join_without_broadcasts_and_the_session_keeps_its_batches(spark):
    words = [f"w{i}" for i in range(102)]
    texts = [" ".join(words), " ".join(words), " ".join(words[:100]), " ".join(reversed(words)), "", None, "a b"]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    found = {r["doc_id"]: r["component_id"] for r in ngram_join.near_components(frame, broadcast_rows=0).collect()}
    assert found == {0: 0, 1: 0, 2: 0, 3: 3, 4: 4, 5: 5, 6: 6} and spark.conf.get(key) == before


def test_pipeline_stages_bound_their_arrow_batches(spark):
    """What a stage returns is planned after it has returned: the bound holds then too, and a smaller one of the session stays."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    docs = spark.range(2500).select(F.col("id").alias("doc_id"), F.lit("a few plain words").alias("text")).coalesce(1)

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"n": pa.array([batch.num_rows], pa.int64())})

    before = spark.conf.get(key)
    try:
        for held, most in (("10000", 1000), ("0", 1000), ("300", 300)):
            spark.conf.set(key, held)
            clean = corpus_pipeline.secret_scan(spark, docs, "")
            assert max(r["n"] for r in clean.select("doc_id").mapInArrow(sizes, "n long").collect()) == most
    finally:
        spark.conf.set(key, before)
