import os
import sys
from pathlib import Path

import pytest

ROOT = str(Path(__file__).resolve().parent.parent)
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join(filter(None, (ROOT, os.environ.get("PYTHONPATH"))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false").config("spark.driver.memory", "6g").config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", f"file://{tmp_path_factory.mktemp('shared')}").config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse"))).getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def oracle():
    """Compares a query with its SQL in DuckDB over tables of one size."""
    import duckdb

    def check(df, sql, sf="sf0.001"):
        con = duckdb.connect()
        for path in sorted(Path(f"/root/testdata/{sf}").glob("*.parquet")):
            con.sql(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path}')")
        want = con.sql(sql)
        cols = sorted(df.columns)
        assert sorted(want.columns) == cols
        order = [want.columns.index(c) for c in cols]
        assert sorted((tuple(r) for r in df.select(*cols).collect()), key=repr) == sorted((tuple(r[i] for i in order) for r in want.fetchall()), key=repr)

    return check
