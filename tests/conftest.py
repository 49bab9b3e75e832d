import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
SMALL = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    scratch = tmp_path_factory.mktemp("spark")
    session = (
        SparkSession.builder.master("local[8]").config("spark.driver.memory", "4g").config("spark.sql.shuffle.partitions", "4").config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false").config("spark.local.dir", str(scratch)).config("spark.checkpoint.dir", f"file://{scratch}/shared")
        .config("spark.sql.warehouse.dir", f"{scratch}/warehouse").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    import __spark_entry__  # noqa: F401  Python workers get the package by value

    yield session
    session.stop()


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{SMALL}/{name}.parquet')")
    return con


def comparable(frame):
    """Rows as sorted tuples of plain values, columns by name."""
    import pandas as pd

    def plain(x):
        if pd.api.types.is_scalar(x) and pd.isna(x):
            return ""
        if hasattr(x, "item") and not hasattr(x, "isoformat"):
            x = x.item()
        return f"{round(x, 6) + 0.0:.6f}" if isinstance(x, (int, float)) and not isinstance(x, bool) else str(x)

    frame = frame[sorted(frame.columns)]
    return list(frame.columns), sorted(tuple(map(plain, row)) for row in frame.itertuples(index=False, name=None))


@pytest.fixture(scope="session")
def same(spark, duck):
    def check(query, sql):
        assert comparable(query(spark, SMALL).toPandas()) == comparable(duck.execute(sql).df())

    return check


@pytest.fixture
def counted(spark):
    """A column function that returns its texts, and how many rows it has read."""
    read = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def of(x):
        read.add(1)
        return x

    return of, lambda: read.value
