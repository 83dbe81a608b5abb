import glob
import os

import pytest
from pyspark.sql import SparkSession

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[4]").appName("tests").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "4g").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    session.sparkContext.setLogLevel("OFF")
    return session


@pytest.fixture(scope="session")
def sf():
    if not os.path.isdir(SF):
        pytest.skip("no test tables here")
    return SF


@pytest.fixture(scope="session")
def duck(sf):
    import duckdb

    con = duckdb.connect()
    for f in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM read_parquet('{f}')")
    return con


def plain(x):
    """A value in a form that both engines share; whole numbers stay exact."""
    import decimal

    if x is None or type(x).__name__ in ("NAType", "NaTType") or isinstance(x, float) and x != x:
        return None
    if isinstance(x, bool) or type(x).__name__ in ("bool_", "bool"):
        return bool(x)
    if isinstance(x, str):
        return x
    if isinstance(x, decimal.Decimal) and x == x.to_integral_value() or not hasattr(x, "is_integer") and hasattr(x, "__index__"):
        return int(x)
    if hasattr(x, "__index__"):
        return int(x)
    number = round(float(x), 9)
    return int(number) if number.is_integer() and abs(number) < 1 << 53 else number


def listed(frame):
    """Rows of a pandas frame, as they come."""
    return [tuple(plain(v) for v in row) for row in frame[sorted(frame.columns)].astype(object).itertuples(index=False)]


def rows_of(frame):
    """Rows of a pandas frame in an order that both engines share."""
    return sorted(listed(frame), key=repr)
