"""Fill-in-the-middle, importance resampling and BPE: SQL, brute force and the tokenizers library."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from strandmill.llm import bpe, catalog, infill, resample

SMALL = "/root/testdata/sf0.001"
FILE = public_tokenizers.path("byte_bpe_50k.json")
ODD = [None, "", " ", "a", "é", "<P>", "a<S>b", "<<M>", "<P", "<p>", "P>", "aé漢\U0001F600b c", "<" * 5, "ab" * 3000, "\n\n<M >\n", "P<S<M", "x<endoftext|>", "<|endoftext|>", "  a<|endoftext|>  ",
       "ֈ࢏ z", " " * 900 + "x" + " " * 7, "a" * 5000, "l'été d'ici it's we'll 123 1234567890"]


def long_text(seed):
    rnd = random.Random(seed)
    return "".join(rnd.choice(["ab", " ", "é", "<", "P", ">", "\n", "Zx", "漢", "7", "\U0001F600"]) for _ in range(rnd.choice([40, 4000])))


TEXTS = [*ODD, *(long_text(i) for i in range(150)), "word " * 400_000]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i if i % 7 else None, t, "keep", 1.5) for i, t in enumerate(TEXTS)] + [(1, TEXTS[1], "keep", 1.5)]
    return spark.createDataFrame(rows, "doc_id long, text string, n string, word double").repartition(5)


def brute_cut(key, text):
    text = text or ""
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    digest = hashlib.sha256(f"1:{'' if key is None else key}".encode()).hexdigest()
    h = [int(digest[8 * i:8 * i + 8], 16) for i in range(4)]
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return len(units), "plain", None, None, text
    if h[3] % 100 < 20:
        return len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def test_infill_against_brute_force(odd):
    made = infill.fill_in_middle(odd).withColumn("back", infill.restored(F.col("output"), F.col("form"))).collect()
    keyed = odd.collect()
    want = Counter((r["doc_id"], *brute_cut(r["doc_id"], r["text"]), r["text"] or "") for r in keyed)
    assert Counter((r["doc_id"], r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"], r["back"]) for r in made) == want
    assert {r["form"] for r in made} == {"plain", "psm", "spm"}
    assert infill.fill_in_middle(odd.limit(0)).collect() == []


@pytest.mark.parametrize("lane", [1, 2, 3, 7, 64, 5000])
def test_scan_is_one_automaton_whatever_the_lanes(lane):
    """Lanes emit what one automaton emits that reads byte after byte from each text's start."""
    texts = [t.encode() for t in TEXTS[1:120] if t is not None]
    offsets = np.cumsum([0, *map(len, texts)])
    want = []
    for t in texts:
        state = 0
        for byte in t:
            c = infill.CLASSES[byte]
            want.append(infill.EMITS[state, c])
            state = infill.MOVES[state, c]
    assert infill.scan(np.frombuffer(b"".join(texts), np.uint8), offsets[:-1], lane).tolist() == want


def brute_sample(docs, target, orders, buckets, least=20, percent=10):
    def runs(text):
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
        return len(words), [zlib.crc32(" ".join(words[i:i + k]).encode()) % buckets for k in range(1, orders + 1) for i in range(len(words) - k + 1)]

    s = Counter(b for _, t in docs for b in runs(t)[1])
    t = Counter(b for x in target for b in runs(x)[1])
    S, T, rows = sum(s.values()), sum(t.values()), []
    for key, text in docs:
        n, found = runs(text)
        gains = [math.floor(1000 * math.log((t[b] + 1) * float(S + buckets) / ((s[b] + 1) * float(T + buckets)))) for b in found]
        weight = sum(gains) // len(gains) if gains else 0
        h = int(hashlib.sha256(f"2024:{'' if key is None else key}".encode()).hexdigest()[:8], 16)
        rows.append([key, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n])
    able = sorted((r for r in rows if r[4] >= least), key=lambda r: (-r[3], r[0] is not None, r[0] or 0, -r[2], -r[1]))
    ranks = {id(r): i + 1 for i, r in enumerate(able[:percent * len(able) // 100])}
    return Counter((*r[:4], ranks.get(id(r))) for r in rows)


@pytest.mark.parametrize("orders,buckets", [(1, 10_000), (3, 997)])
def test_resampling_against_brute_force(spark, odd, orders, buckets):
    docs = odd.where(F.length("text") < 100_000).union(odd.where("text is null")).union(
        spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text", F.lit("x"), F.lit(0.0)))
    target = spark.read.parquet(f"{SMALL}/benchmark.parquet")
    made = resample.resample(docs, target, orders=orders, buckets=buckets).collect()
    want = brute_sample([(r["doc_id"], r["text"]) for r in docs.collect()], [r["text"] for r in target.collect()], orders, buckets)
    assert Counter((r["doc_id"], r["n_features"], r["weight"], r["score"], r["rank"]) for r in made) == want
    assert sum(r["rank"] is not None for r in made) > 10


def test_resampling_of_empty_tables(spark, odd):
    target = spark.createDataFrame([], "text string")
    assert resample.resample(odd.limit(0), target).collect() == []
    assert {r["doc_id"] for r in resample.resample(odd, target).collect()} == {r["doc_id"] for r in odd.collect()}


def test_resampling_plan(spark):
    """One order moves no words: gains are broadcast, and only sums of rows and buckets are shuffled."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    gain = spark.createDataFrame([(1, 2)], "bucket int, gain long")
    plan = resample.weigh(docs, gain)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Window" not in plan and "BroadcastHashJoin" in plan


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(FILE)


def test_bpe_against_the_library(odd, library):
    rows = bpe.encode_documents(odd).withColumn("back", bpe.decode(F.col("ids"))).collect()
    assert len(rows) == len(TEXTS) + 1
    for r in rows:
        ids = library.encode(r["text"] or "", add_special_tokens=False).ids
        assert np.frombuffer(r["ids"], "<u4").tolist() == ids
        assert r["back"] == library.decode(ids, skip_special_tokens=False)
        assert (r["n"], r["word"]) == ("keep", 1.5)
    assert bpe.encode_documents(odd.limit(0)).collect() == []


def test_bpe_of_tables(spark, library):
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    for r in catalog.queries()["op13_bpe"](spark, SMALL).collect():
        ids = library.encode(texts[r["doc_id"]], add_special_tokens=False).ids
        packed = np.array(ids, "<u4").tobytes()
        text = library.decode(ids, skip_special_tokens=False)
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), hashlib.sha256(packed).hexdigest(), hashlib.sha256(text.encode()).hexdigest())


def test_bpe_of_strings_of_tokens(library, monkeypatch):
    """Random strings of tokens and bytes, in tries of few words and with a small memory as well."""
    rnd = random.Random(3)
    encoder = bpe.Encoder(FILE)
    spelled = [b.decode() for b in encoder.vocabulary.bytes_of.values() if b.isascii()]
    texts = ["".join(rnd.choices(spelled, k=rnd.randint(1, 6))).replace(" ", rnd.choice([" ", ""])) for _ in range(20_000)]
    texts += ["".join(chr(rnd.choice([rnd.randint(1, 126), rnd.randint(0xA0, 0x2FFF), rnd.randint(0x10000, 0x1FFFF)])) for _ in range(40)) for _ in range(2_000)]
    want = [np.array(x.ids, "<u4").tobytes() for x in library.encode_batch(texts, add_special_tokens=False)]
    assert encoder.encode(texts) == want
    monkeypatch.setattr(bpe, "WORDS", 50)
    monkeypatch.setattr(bpe, "REMEMBERED", 300)
    assert bpe.Encoder(FILE).encode(texts[:3000]) == want[:3000]


def test_bpe_splits_all_characters_as_the_library(library):
    encoder = bpe.Encoder(FILE)
    texts = [" ".join(f"a{chr(c)}1 {chr(c)}" for c in range(start, start + 64) if not 0xD800 <= c < 0xE000) for start in range(0, 0x110000, 64) if start < 0x3400 or start > 0x1F000 or start % 4096 == 0]
    assert encoder.encode(texts) == [np.array(x.ids, "<u4").tobytes() for x in library.encode_batch(texts, add_special_tokens=False)]


def test_bpe_decodes_bytes_that_are_no_text(spark, library):
    lists = [[162, 254], [50256, 64], [250], []]
    rows = spark.createDataFrame([(i, bytearray(np.array(x, "<u4").tobytes())) for i, x in enumerate(lists)], "i int, ids binary")
    got = {r["i"]: r["t"] for r in rows.select("i", bpe.decode(F.col("ids")).alias("t")).collect()}
    assert got == {i: library.decode(x, skip_special_tokens=False) for i, x in enumerate(lists)}


def test_bpe_refuses_other_files():
    with pytest.raises(ValueError):
        bpe.Vocabulary(public_tokenizers.path("word_bpe_49k.json"))


@pytest.mark.parametrize("name", ["op11_fill_in_middle", "op12_importance_resampling"])
def test_oracle(same, name):
    same(catalog.queries()[name], catalog.oracle_sql()[name])
