"""One session for all tests, and the comparison of Spark's rows with DuckDB's."""

from __future__ import annotations

import datetime
import math
import os
import sys
from decimal import Decimal
from pathlib import Path

import pytest
from pyspark.sql import Row, SparkSession

REPO = str(Path(__file__).resolve().parents[1])
if REPO not in sys.path:
    sys.path.insert(0, REPO)
os.environ["PYTHONPATH"] = os.pathsep.join([REPO, os.environ.get("PYTHONPATH", "")])
DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master(os.environ.get("TEST_MASTER", "local[4]"))
        .config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "4g").config("spark.driver.host", "127.0.0.1").getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def plain(v):
    """A value that is the same whichever engine made it."""
    if v is None or type(v).__name__ in ("NAType", "NaTType"):
        return None
    if isinstance(v, Row):
        return tuple(plain(x) for x in v)
    if isinstance(v, dict):
        return tuple(plain(x) for x in v.values())
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if isinstance(v, bool):
        return v
    if isinstance(v, (int, float, Decimal)):
        f = float(v)
        return None if math.isnan(f) else f + 0.0
    if isinstance(v, datetime.datetime):
        return v.isoformat()
    if isinstance(v, datetime.date):
        return datetime.datetime(v.year, v.month, v.day).isoformat()
    return v


def multiset(rows):
    return sorted((plain(r) for r in rows), key=repr)


@pytest.fixture(scope="session")
def oracle():
    import duckdb

    con = duckdb.connect()
    con.execute("SET threads = 4")
    for f in Path(DATA).iterdir():
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")

    def run(sql):
        cur = con.execute(sql)
        return [d[0] for d in cur.description], cur.fetchall()

    return run
