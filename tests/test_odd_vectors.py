"""Queries over embeddings against their SQL, on rows that a table may hold but the test tables do not."""

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from conftest import comparable

from strandmill.operators import builders
from strandmill.plans import catalog

RANKED = ["rank_failures", "rank_histogram", "rank_metrics", "rank_quality", "rank_diagnostics", "family_breakdown", "sanity_gate", "cosine_pairs_topk"]


def table(folder, rows):
    columns = {"vec_id": pa.int64(), "embedding": pa.list_(pa.float32()), "label": pa.int32()}
    pq.write_table(pa.table({c: pa.array([r[i] for r in rows], kind) for i, (c, kind) in enumerate(columns.items())}), f"{folder}/embeddings.parquet")
    return str(folder)


@pytest.fixture(scope="module")
def plain():
    rng = np.random.default_rng(3)
    return [(i, rng.normal(size=64).astype("f4").tolist(), i % 10) for i in range(120)]


@pytest.fixture(scope="module")
def odd(tmp_path_factory, plain):
    """By kind: no vector, no id, ids found twice, vectors shorter than the least norm, NaN in a half, zeros, negative ids, all of these."""
    v = [row[1] for row in plain]
    kinds = {
        "null": [(200, None, 1), (201, None, 2)], "no_id": [(None, v[3], 1)], "twice": [(5, v[3], 5), (5, v[9], 5), (7, v[7], 7)],
        "short": [(202, (np.array(v[1]) * 1e-9).tolist(), 1), (203, (np.array(v[2]) * 1e-12).tolist(), 1)],
        "nan": [(204, [float("nan"), *v[1][1:]], 1), (205, [*v[1][:63], float("nan")], 1)], "zero": [(206, [0.0] * 64, 1)], "negative": [(-i, v[i], 3) for i in range(1, 9)],
    }
    kinds["all"] = [row for rows in kinds.values() for row in rows]
    return {kind: table(tmp_path_factory.mktemp(kind), plain + rows) for kind, rows in kinds.items()} | {"empty": table(tmp_path_factory.mktemp("empty"), [])}


def held(spark, folder, name):
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{folder}/embeddings.parquet')")
    assert comparable(catalog.queries()[name](spark, folder).toPandas()) == comparable(con.execute(catalog.oracle_sql()[name]).df())


@pytest.mark.parametrize("name", RANKED)
def test_odd_vectors(spark, odd, name):
    for kind in ("null", "twice", "short", "nan", "all"):
        held(spark, odd[kind], name)


@pytest.mark.parametrize("name", ["rank_histogram", "sanity_gate"])
def test_no_vectors(spark, odd, name):
    held(spark, odd["empty"], name)


@pytest.mark.parametrize("name", ["rank_metrics", "rank_quality", "family_breakdown"])
def test_shares_halfway(spark, tmp_path, name):
    """41 of 640 queries find their key first: the share, 0.0640625, lies halfway between six decimals, and in doubles below."""
    one, other = [1.0] + [0.0] * 31, [-1.0] + [0.0] * 31
    folder = table(tmp_path, [(i, one + (one if i < 41 else other), 0) for i in range(640)])
    held(spark, folder, name)


def test_mean_tied_halfway(spark):
    rows = spark.range(640).selectExpr("1 + id AS rank", "2 + id AS strict_rank", "IF(id < 41, 2, 1) AS ties")
    assert builders.rank_diagnostics(rows).first()["mean_tied"] == 0.064062
