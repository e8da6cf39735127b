"""One local session for all tests, and the comparison of a query with its SQL."""

from __future__ import annotations

import decimal
import glob
import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import DataFrame, SparkSession  # noqa: E402

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark(tmp_path_factory) -> SparkSession:
    conf = {
        "spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.sql.session.timeZone": "UTC", "spark.driver.memory": "4g",
        "spark.checkpoint.dir": str(tmp_path_factory.mktemp("checkpoints")), "spark.sql.warehouse.dir": str(tmp_path_factory.mktemp("warehouse")), "spark.ui.showConsoleProgress": "false",
    }
    session = SparkSession.builder.master("local[4]").config(map=conf).getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def _plain(v):
    if isinstance(v, decimal.Decimal):
        return int(v) if v == int(v) else float(v)
    return v if isinstance(v, (int, bool, type(None))) else round(v, 6) if isinstance(v, float) else str(v)


def rows(df: DataFrame) -> list[tuple]:
    cols = sorted(df.columns)
    return sorted((tuple(_plain(r[c]) for c in cols) for r in df.collect()), key=repr)


def oracle_rows(sql: str, sf_dir: str = SF) -> tuple[list[str], list[tuple]]:
    import duckdb

    db = duckdb.connect()
    for p in glob.glob(f"{sf_dir}/*.parquet"):
        db.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM read_parquet('{p}')")
    r = db.execute(sql)
    cols = [d[0] for d in r.description]
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted(cols), sorted((tuple(_plain(x[i]) for i in order) for x in r.fetchall()), key=repr)


@pytest.fixture(scope="session")
def sf() -> str:
    return SF


@pytest.fixture(scope="session")
def same_as_sql():
    def check(df: DataFrame, sql: str) -> None:
        cols, want = oracle_rows(sql)
        assert sorted(df.columns) == cols
        assert rows(df) == want

    return check
