import datetime as dt
import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "4g")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("staging")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def series(spark):
    """Build a minute series from ``[(day, minute of session, value), ...]``."""

    def build(rows, value="x", kind="double"):
        start = dt.date(2024, 3, 1)
        data = [(start + dt.timedelta(days=d), 30600 + 60 * m, v) for d, m, v in rows]
        return spark.createDataFrame(data, f"index_date date, index_time int, {value} {kind}")

    return build


def in_order(df, *columns):
    rows = df.orderBy("index_date", "index_time").select(*columns).collect()
    return [tuple(r) if len(columns) > 1 else r[0] for r in rows]
