import os
import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

ROOT = str(Path(__file__).resolve().parents[1])
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join([ROOT, *filter(None, [os.environ.get("PYTHONPATH")])])


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "6g").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


SF = "/root/testdata/sf0.001"


def oracle_rows(sql: str, sf_dir: str = SF):
    """Columns and rows of DuckDB's answer."""
    import duckdb

    con = duckdb.connect()
    for path in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    found = con.execute(sql)
    return [c[0] for c in found.description], found.fetchall()


def same_rows(frame, sql: str, sf_dir: str = SF) -> None:
    columns, want = oracle_rows(sql, sf_dir)
    assert sorted(frame.columns) == sorted(columns)
    order = sorted(columns)
    key = lambda names: lambda row: tuple(repr(row[names.index(c)]) for c in order)
    assert sorted(map(key(frame.columns), map(list, frame.collect()))) == sorted(map(key(columns), want))
