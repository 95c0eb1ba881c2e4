import os
import sys
import tempfile

import pandas as pd
import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    session = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "2").config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "6g").config("spark.local.dir", folder).config("spark.sql.warehouse.dir", f"{folder}/warehouse")
        .config("spark.checkpoint.dir", f"file://{folder}/checkpoints").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    for name in os.listdir(SF):
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{name}'")
    return con


def plain(value):
    if value is None or value is pd.NA or value is pd.NaT or value != value:
        return "null"
    return f"{value:.9g}" if isinstance(value, float) else str(value)


def rows(pdf, columns):
    return sorted(tuple(plain(v) for v in r) for r in pdf[columns].itertuples(index=False, name=None))


def assert_same(df, expected):
    """A Spark and a pandas table with the same columns and rows, in any order."""
    got, columns = df.toPandas().astype(object), sorted(df.columns)
    assert columns == sorted(expected.columns)
    assert rows(got, columns) == rows(expected.astype(object), columns)
