import os
import sys
from pathlib import Path

import pytest

REPO = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(REPO))
DATA = Path(os.environ.get("TESTDATA", "/root/testdata"))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]").appName("tests").config("spark.sql.shuffle.partitions", "2").config("spark.driver.memory", "4g")
        .config("spark.ui.enabled", "false").config("spark.sql.codegen.wholeStage", os.environ.get("TEST_CODEGEN", "true")).config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared"))).getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def tiny():
    return str(DATA / "sf0.001")


@pytest.fixture(scope="session")
def small():
    return str(DATA / "sf0.01")


def plain(v):
    """A value that compares alike from either engine."""
    if hasattr(v, "asDict"):
        v = list(v)
    if isinstance(v, float):
        return "nan" if v != v else round(v, 9)
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return v


@pytest.fixture(scope="session")
def compare(spark):
    """Runs a query and its SQL over the same tables and compares all rows."""
    import duckdb

    def run(name, query, sql, sf_dir):
        con = duckdb.connect()
        for p in Path(sf_dir).glob("*.parquet"):
            con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
        df = query(spark, sf_dir)
        result = con.execute(sql)
        columns = [c[0] for c in result.description]
        assert sorted(columns) == sorted(df.columns), name
        order = sorted(columns)
        want = sorted((tuple(plain(r[columns.index(c)]) for c in order) for r in result.fetchall()), key=repr)
        got = sorted((tuple(plain(r[c]) for c in order) for r in df.collect()), key=repr)
        assert got == want, name

    return run
