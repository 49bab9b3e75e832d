"""Nearest neighbours by multi-index hashing: learned rotated binary codes, pigeonhole probing of substrings, float reranking.

A code is cut into m substrings of s bits. Two codes within Hamming distance (t + 1) * m - 1 agree in one substring but
for t bits (pigeonhole), so probing every substring's keys within t bits retrieves all of them. Rows and probes meet by
substring and key prefix in a shuffle; nothing is compared outside its keys.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations
from math import comb, log2

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from strandmill.llm.common import materialize


def lifted(x: np.ndarray, longest: float) -> np.ndarray:
    """Unit vectors, by one more dimension, whose inner products order like those of ``x`` with any one query."""
    y = x / longest
    return np.concatenate((y, np.sqrt(np.maximum(0, 1 - (y**2).sum(1, keepdims=True)))), 1)


def as_query(x: np.ndarray) -> np.ndarray:
    """A query's place among lifted vectors: its direction, without a part in the dimension that was added."""
    return np.concatenate((x / np.linalg.norm(x, axis=1, keepdims=True), np.zeros((len(x), 1))), 1)


def learn_rotations(sample: np.ndarray, bits: int, rounds: int = 6, seed: int = 5) -> np.ndarray:
    """Dimensions x bits: orthonormal blocks, turned until the signs lie as near to the data as they get."""
    rng, width = np.random.default_rng(seed), min(64, sample.shape[1])
    blocks = []
    for _ in range(-(-bits // width)):
        turn = np.linalg.qr(rng.standard_normal((sample.shape[1], width)))[0]
        for _ in range(rounds):
            u, _, v = np.linalg.svd(sample.T @ np.where(sample @ turn > 0, 1.0, -1.0), full_matrices=False)
            turn = u @ v
        blocks.append(turn)
    return np.concatenate(blocks, 1)[:, :bits]


@dataclass(frozen=True)
class Plan:
    """Substrings of ``s`` bits, ``m`` of them, keys within ``t`` bits probed, codes within ``radius`` reranked."""

    s: int
    m: int
    t: int
    radius: int
    share: float  # of all rows, that a query's probes retrieve on average
    recall: float  # of the true neighbours that the plan was fitted on

    @property
    def probes(self) -> int:
        return sum(comb(self.s, i) for i in range(self.t + 1))


def substrings(signs: np.ndarray, s: int) -> np.ndarray:
    """Keys (rows x m) of sign bits (rows x m * s)."""
    parts = signs.reshape(len(signs), -1, s)
    return parts.astype(np.int32) @ (1 << np.arange(s, dtype=np.int32))


def masks(bits: int, reach: int) -> np.ndarray:
    """All numbers of ``bits`` bits with at most ``reach`` ones."""
    return np.array([sum(1 << b for b in c) for n in range(min(reach, bits) + 1) for c in combinations(range(bits), n)], np.int64)


def fit_plan(asked: np.ndarray, there: np.ndarray, rows: int, queries: int, recall: float, most_bits: int) -> Plan:
    """The cheapest plan that retrieves ``recall`` of known neighbours, given the signs of both sides of each pair.

    Costs are those of shuffled rows (m each), of probes and of retrieved codes, in rows of about a microsecond.
    """
    apart, best, cost = asked != there, None, float("inf")
    for s in range(8, 25, 2):
        if 1 << s > 4 * max(rows, 64):
            break
        within = np.minimum.accumulate(apart[:, :most_bits // s * s].reshape(len(apart), -1, s).sum(2), 1)
        for t in range(0, 5):
            hits = (within <= t).mean(0) if len(within) else np.ones(within.shape[1])
            probes = sum(comb(s, i) for i in range(t + 1))
            fits = np.flatnonzero(hits >= recall)
            m = int(fits[0]) + 1 if len(fits) else within.shape[1]
            m = max(m, -(-128 // s))  # enough bits for distances to tell
            price = m * (rows + queries * probes * (0.02 + 0.1 * rows / (1 << s))) * (1 if len(fits) else 1e6)
            if price < cost:
                distances = apart[:, :m * s].sum(1)
                radius = int(np.quantile(distances, 1 - (1 - recall) / 3)) if len(distances) else m * s
                best, cost = Plan(s, m, t, radius, min(1.0, m * probes / (1 << s)), float(np.mean((within[:, m - 1] <= t) & (distances <= radius))) if len(distances) else 1.0), price
    return best


def usable(vector: Column) -> Column:
    """Not null, not zero, without null or non-finite components."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & (F.size(vector) > 0) & ~F.coalesce(bad, F.lit(False)) & F.exists(vector, lambda x: x != 0)


def matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()) if len(column) else np.zeros((0, 0))


def nearest_of_few(rows: DataFrame, few: np.ndarray, k: int) -> DataFrame:
    """``(q, cid, score)``: exact neighbours of few vectors among all rows, a bounded list for each task."""
    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cids, scores = np.zeros(0, np.int64), np.zeros((len(few), 0))
        for batch in batches:
            if len(batch):
                cids = np.concatenate((np.broadcast_to(cids, (len(few), len(cids))) if cids.ndim == 1 else cids, np.broadcast_to(batch["cid"].to_numpy(), (len(few), len(batch)))), 1)
                scores = np.concatenate((scores, few @ matrix(batch["v"]).T), 1)
                top = np.argsort(-scores, 1, kind="stable")[:, :k]
                cids, scores = np.take_along_axis(cids, top, 1), np.take_along_axis(scores, top, 1)
        if scores.size:
            yield pd.DataFrame({"q": np.repeat(np.arange(len(few)), cids.shape[1]), "cid": cids.ravel(), "score": scores.ravel()})

    found = rows.select("cid", "v").mapInPandas(scan, "q long, cid long, score double")
    place = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "cid"))
    return found.withColumn("_p", place).where(F.col("_p") <= k).drop("_p")


def probe_blocks(plan: Plan, prefix: int, turns: np.ndarray, longest: float, queries: bool):
    """Rows to (substring, key prefix, cid, code): one for each substring, or, of queries, for each prefix they probe."""
    reach = masks(prefix, plan.t)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for start in range(0, len(batch), 2048):
                part = batch.iloc[start:start + 2048]
                x = matrix(part["v"])
                signs = (as_query(x) if queries else lifted(x, longest)) @ turns > 0
                heads = substrings(signs, plan.s) >> (plan.s - prefix)
                codes = [r.tobytes() for r in np.packbits(signs, 1)]
                for j in range(plan.m):
                    blocks = (heads[:, j, None] ^ reach[None, :]) if queries else heads[:, j, None]
                    again = blocks.shape[1]
                    yield pd.DataFrame({"j": j, "block": blocks.ravel(), "cid": np.repeat(part["cid"].to_numpy(), again), "code": np.repeat(np.array(codes, object), again)})

    return run, "j int, block long, cid long, code binary"


def signs_of(codes: pd.Series, bits: int) -> np.ndarray:
    packed = np.frombuffer(b"".join(codes), np.uint8).reshape(len(codes), -1)
    return np.unpackbits(packed, 1, bits).astype(bool)


def meet(plan: Plan, chunk: int = 1 << 21):
    """Pairs of one substring and prefix: keys within ``t`` bits, codes within ``radius``, each pair in its first substring."""
    bits, flips = plan.m * plan.s, masks(plan.s, plan.t)

    def search(key, ask: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(ask) and len(rows):
            j = int(key[0])
            q, r = signs_of(ask["code"], bits), signs_of(rows["code"], bits)
            qk, rk = substrings(q, plan.s), substrings(r, plan.s)
            words = -(-bits // 64) * 64
            pack = lambda x: np.packbits(np.pad(x, ((0, 0), (0, words - bits))), 1).view(np.uint64)
            qw, rw = pack(q), pack(r)
            order = np.argsort(rk[:, j], kind="stable")
            keys, first, size = np.unique(rk[order, j], return_index=True, return_counts=True)
            qid, rid = ask["cid"].to_numpy(), rows["cid"].to_numpy()
            for a in range(0, len(q), max(1, chunk // max(len(flips), len(rows)))):
                b = a + max(1, chunk // max(len(flips), len(rows)))
                wanted = qk[a:b, j, None] ^ flips[None, :]
                at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
                of, place = np.nonzero(keys[at] == wanted)
                at = at[of, place]
                n = size[at]
                mine = np.repeat(of + a, n)
                found = order[np.repeat(first[at] - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())]
                near = np.bitwise_count(qw[mine] ^ rw[found]).sum(1, dtype=np.int32) <= plan.radius
                mine, found = mine[near], found[near]
                if j:
                    earlier = (np.bitwise_count(qk[mine, :j] ^ rk[found, :j]) <= plan.t).any(1)
                    mine, found = mine[~earlier], found[~earlier]
                out.append(pd.DataFrame({"q": qid[mine], "cid": rid[found]}))
        return pd.concat(out) if out else pd.DataFrame({"q": pd.Series(dtype="int64"), "cid": pd.Series(dtype="int64")})

    return search


def inner_product(a: str, b: str) -> Column:
    @arrow_udf("double")
    def of(x: pa.Array, y: pa.Array) -> pa.Array:
        if not len(x):
            return pa.array([], pa.float64())
        left, right = (z.flatten().to_numpy(zero_copy_only=False).reshape(len(z), -1) for z in (x, y))
        return pa.array((left * right).sum(1))

    return of(a, b)


def retrieve(rows: DataFrame, asks: DataFrame, plan: Plan, turns: np.ndarray, longest: float, n: int, block_rows: int) -> DataFrame:
    """``(q, cid)``: the rows that the plan retrieves for each query; blocks above ``block_rows`` are dealt to salts."""
    prefix = max(0, min(plan.s, int(log2(max(1, n / block_rows)) + 0.5)))
    spread = {}
    for name, side, queries in (("rows", rows, False), ("asks", asks, True)):
        run, schema = probe_blocks(plan, prefix, turns, longest, queries)
        spread[name] = side.select("cid", "v").mapInPandas(run, schema)
    sizes = materialize(spread["rows"].groupBy("j", "block").agg(F.ceil(F.count("*") / (2 * block_rows)).alias("salts")), "mih-sizes")  # at most m << prefix rows
    salted = spread["rows"].join(F.broadcast(sizes), ["j", "block"]).withColumn("salt", F.pmod(F.xxhash64("cid"), F.col("salts"))).drop("salts")
    probes = spread["asks"].join(F.broadcast(sizes), ["j", "block"]).withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).drop("salts")
    return probes.groupBy("j", "block", "salt").cogroup(salted.groupBy("j", "block", "salt")).applyInPandas(meet(plan), "q long, cid long")


def nearest(vectors: DataFrame, queries: Column, key: str = "vec_id", vector: str = "embedding", k: int = 20, recall: float = 0.95,
            sample_rows: int = 8192, sample_queries: int = 256, most_bits: int = 1024, block_rows: int = 32768, plans: list | None = None) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the rows of largest inner product for every row where ``queries`` holds.

    Rotations are learned on at most about ``sample_rows`` rows; the plan is fitted on the true neighbours, among all
    rows, of at most ``sample_queries`` queries, so that their ``recall`` is retrieved at the least cost. Every row is
    indexed. Equal vectors are one row of the index with their k + 1 smallest keys, which is all that a rank can need.
    Candidates are reranked in double precision; queries that retrieve fewer than k rows are searched exactly in blocks.
    A query's own key is no candidate. Ties go to the smaller key, repeated rows count once. Null, zero, non-finite
    vectors, those of another than the most common length, and rows without a key take no part. ``plans`` receives the
    plan that was used.
    """
    spark, none = vectors.sparkSession, "query_id long, rank int, vec_id long, score double"
    rows = vectors.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"), F.coalesce(queries, F.lit(False)).alias("asks")).where(F.col("id").isNotNull() & usable(F.col("v")))
    common = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    if common is None:
        return spark.createDataFrame([], none)
    rows = rows.where(F.size("v") == common["n"])
    first = F.dense_rank().over(Window.partitionBy("v").orderBy("id"))
    kept = rows.withColumn("_p", first).where(F.col("_p") <= k + 1)
    classes = materialize(kept.groupBy("v").agg(F.array_sort(F.collect_set("id")).alias("ids")).withColumn("cid", F.monotonically_increasing_id()), "mih-classes")
    askers = materialize(rows.where("asks").select("id", "v").distinct().join(classes.select("v", "cid"), "v").select(F.col("cid").alias("q"), "id"), "mih-askers")
    asks = classes.join(askers.select(F.col("q").alias("cid")).distinct(), "cid", "left_semi")
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
    about = classes.agg(F.count("*").alias("n"), F.max(norm).alias("longest")).first()
    n, longest, many = about["n"], about["longest"], asks.count()
    if not many:
        return spark.createDataFrame([], none)

    part = lambda df, size, most: df.where(F.pmod(F.xxhash64("cid"), F.lit(1 << 20)) < int(most / size * (1 << 20)) + 1) if size > most else df
    sample = matrix(part(classes, n, sample_rows).select("v").limit(2 * sample_rows).toPandas()["v"])
    some = matrix(part(asks, many, sample_queries).select("v").limit(2 * sample_queries).toPandas()["v"])
    turns = learn_rotations(lifted(sample, longest), most_bits)
    truth = nearest_of_few(classes, some, k + 1).join(classes.select("cid", "v"), "cid").select("q", "v").toPandas()  # (k + 1) * sample_queries rows
    there = matrix(truth["v"])
    other = ~(there == some[truth["q"].to_numpy()]).all(1)
    plan = fit_plan(as_query(some[truth["q"].to_numpy()[other]]) @ turns > 0, lifted(there[other], longest) @ turns > 0, n, many, recall, most_bits)
    if plans is not None:
        plans.append(plan)
    turns = turns[:, :plan.m * plan.s]

    # a query's own class may hold neighbours too, at any distance from its code
    pairs = retrieve(classes, asks, plan, turns, longest, n, block_rows).union(asks.select(F.col("cid").alias("q"), "cid")).distinct()
    joined = pairs.join(classes, "cid").join(asks.select(F.col("cid").alias("q"), F.col("v").alias("w")), "q").select("q", "cid", "ids", inner_product("v", "w").alias("score"))
    order = Window.partitionBy("q").orderBy(F.desc("score"), F.col("ids")[0], "cid")
    best = materialize(joined.withColumn("_p", F.row_number().over(order)).where(F.col("_p") <= k + 1).select("q", "ids", "score"), "mih-best")
    # the own key takes one place among the candidates
    short = asks.select(F.col("cid").alias("q"), "v").join(best.groupBy("q").agg(F.sum(F.size("ids")).alias("n")), "q").where(F.col("n") < k + 1).drop("n")
    if not short.isEmpty():
        best = best.join(short.select("q"), "q", "left_anti").union(exact(classes, short, k + 1))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    ranked = best.select("q", "score", F.explode("ids").alias("vec_id")).join(askers.withColumnRenamed("id", "query_id"), "q").where("vec_id <> query_id")
    once = ranked.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    return once.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def exact(classes: DataFrame, few: DataFrame, k: int, query_rows: int = 2048, index_rows: int = 32768) -> DataFrame:
    """``(q, ids, score)``: the ``k`` nearest classes of each of ``few(q, v)``; blocks of queries meet blocks of rows."""
    total, asked = classes.count(), few.count()
    rows, groups = -(-total // index_rows), max(1, -(-asked // query_rows))
    every = lambda n, name: F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias(name)
    here = few.select(F.col("q").alias("id"), F.col("v").alias("w"), F.pmod(F.xxhash64("q"), F.lit(groups)).alias("g"), every(rows, "r"))
    there = classes.select("cid", "v", "ids", F.pmod(F.xxhash64("cid"), F.lit(rows)).cast("int").alias("r"), every(groups, "g")).withColumn("g", F.col("g").cast("long"))

    def scan(ask: pd.DataFrame, block: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({"q": pd.Series(dtype="int64"), "ids": pd.Series(dtype="object"), "score": pd.Series(dtype="float64")})]
        if len(ask) and len(block):
            x, ids = matrix(block["v"]), block["ids"].to_numpy()
            smallest = np.array([i[0] for i in ids])
            for q, v in zip(ask["id"], ask["w"]):
                scores = (x * v).sum(1)
                top = np.lexsort((smallest, -scores))[:k]
                out.append(pd.DataFrame({"q": q, "ids": ids[top], "score": scores[top]}))
        return pd.concat(out)

    found = here.groupBy("g", "r").cogroup(there.groupBy("g", "r")).applyInPandas(scan, "q long, ids array<long>, score double")
    order = Window.partitionBy("q").orderBy(F.desc("score"), F.col("ids")[0])
    return found.withColumn("_p", F.row_number().over(order)).where(F.col("_p") <= k).drop("_p")


def op10_multi_index_hashing(spark, sf_dir):
    from strandmill.llm.common import table

    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)
