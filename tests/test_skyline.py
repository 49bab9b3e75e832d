"""Skylines of rows that come out otherwise each time, of repeated keys, and of values that doubles order oddly."""

import numpy as np
import pandas as pd
import pytest
from conftest import comparable

from strandmill.operators import ranking
from strandmill.plans import catalog

NAN, INF = float("nan"), float("inf")


def test_rows_are_worked_out_once(spark):
    """Sums of doubles depend on the order in which parts arrive; here every evaluation has its own values."""
    def drawn(batches):
        for batch in batches:
            yield pd.DataFrame({"id": batch["id"], "a": np.random.random(len(batch)), "b": np.random.random(len(batch))})

    found = ranking.skyline(spark.range(400).mapInPandas(drawn, "id long, a double, b double"), "id", ["a"], ["b"]).toPandas().sort_values("a")
    assert found["b"].is_monotonic_increasing  # what costs more holds more


@pytest.mark.parametrize("block_rows", [8192, 2])
def test_odd_values(spark, block_rows):
    rows = [(1, 0.5, 1.0), (1, 0.5, 2.0), (2, 0.5, 2.0), (3, None, 0.0), (4, 0.0, -INF), (5, -0.0, 1.0), (6, 1.0, NAN), (7, 2.0, NAN), (8, NAN, INF), (9, -INF, -1e300), (10, 1e300, None)]
    found = ranking.skyline(spark.createDataFrame(rows, "id long, a double, b double").repartition(3), "id", ["a"], ["b"], block_rows).collect()
    assert sorted((r["id"], str(r["a"]), str(r["b"])) for r in found) == sorted(
        (i, str(a), str(b)) for i, a, b in [(1, 0.5, 2.0), (2, 0.5, 2.0), (3, None, 0.0), (5, -0.0, 1.0), (6, 1.0, NAN), (9, -INF, -1e300), (10, 1e300, None)])


def test_sums_that_tie():
    """2 ** 60 swallows a difference of one; the row that dominates comes after the other."""
    assert ranking.undominated(np.array([[2.0**60, 1.0], [2.0**60, 2.0]])).tolist() == [False, True]


def test_suppliers_found_twice(spark, tmp_path):
    """Suppliers that are found twice meet all lines twice, as in the SQL; others share their key only. A mean lies halfway between six decimals."""
    import duckdb

    con = duckdb.connect()
    con.execute(f"COPY (SELECT s_suppkey, s_acctbal::DOUBLE AS s_acctbal FROM (VALUES (1, 5.0), (1, 5.0), (1, 7.0), (2, 6.0), (2, 1.0), (3, NULL), (4, 9.0)) t(s_suppkey, s_acctbal)) TO '{tmp_path}/supplier.parquet' (FORMAT parquet)")
    con.execute(f"""COPY (SELECT l_suppkey, l_discount::DOUBLE AS l_discount, l_quantity::DOUBLE AS l_quantity FROM (VALUES (1, 0.05, 3.0), (1, 0.02, 4.0), (2, 0.03, 9.0), (3, 0.1, 1.0), (3, NULL, NULL), (NULL, 0.0, 99.0)) t(l_suppkey, l_discount, l_quantity)
        UNION ALL SELECT 4, CASE WHEN i < 41 THEN 1e0 ELSE 0e0 END, 1e0 FROM range(640) r(i)) TO '{tmp_path}/lineitem.parquet' (FORMAT parquet)""")
    for name in ("supplier", "lineitem"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet'")
    found = catalog.queries()["pareto_skyline"](spark, str(tmp_path)).toPandas()
    assert comparable(found) == comparable(con.execute(catalog.oracle_sql()["pareto_skyline"]).df())
    assert 0.064062 in set(found["discount"])
