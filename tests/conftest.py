import os
import sys

import pytest

os.environ.setdefault("OMP_NUM_THREADS", "1")
os.environ.setdefault("TZ", "UTC")
sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    s = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.driver.memory", "4g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def sf():
    if not os.path.isdir(SF):
        pytest.skip("no test data")
    return SF


@pytest.fixture(scope="session")
def duck(sf):
    import glob

    import duckdb

    c = duckdb.connect()
    for p in glob.glob(f"{sf}/*.parquet"):
        c.sql(f"create view {os.path.basename(p)[:-8]} as select * from read_parquet('{p}')")
    return c


def comparable(frame):
    """Rows with columns by name and values in a common form."""
    import numpy as np
    import pandas as pd

    def plain(x):
        if x is None or x is pd.NA or x is pd.NaT:
            return None
        if isinstance(x, (list, tuple, np.ndarray)):
            return str([plain(y) for y in x])
        if isinstance(x, (float, np.floating)):
            return None if np.isnan(x) else round(float(x), 6) + 0.0
        if isinstance(x, (int, np.integer)) and not isinstance(x, (bool, np.bool_)):
            return float(x)
        return str(x)

    columns = [[plain(x) for x in frame[c]] for c in sorted(frame.columns)]
    return sorted(zip(*columns, strict=True), key=str)


@pytest.fixture(scope="session")
def same():
    return comparable
