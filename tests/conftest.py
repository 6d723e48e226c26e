import datetime as dt
import os
import sys
from decimal import Decimal

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from shelfcast.session import get_spark
    s = get_spark(master="local[4]", shuffle_partitions=4)
    yield s
    s.stop()


def _d(x):
    return x if isinstance(x, dt.date) else dt.date.fromisoformat(x)


@pytest.fixture
def make_sales(spark):
    """Canonical sales rows: (store, date, article, model, segment, price, qty, amount)."""
    from shelfcast.sources.sales import SALES_SCHEMA

    def build(rows):
        data = [(r[0], _d(r[1]), r[2], "desc", r[3], r[4], float(r[5]),
                 Decimal(str(r[6])), None if r[7] is None else Decimal(str(r[7]))) for r in rows]
        return spark.createDataFrame(data, SALES_SCHEMA)
    return build


@pytest.fixture
def make_daily(spark):
    """Daily rows (store, segment, ds, y) with amount = y and one line per day."""
    from pyspark.sql import functions as F

    def build(values, start="2024-01-01", store="S", segment="G"):
        base = _d(start)
        data = [(store, segment, base + dt.timedelta(days=i), float(v)) for i, v in enumerate(values)]
        df = spark.createDataFrame(data, "store string, segment string, ds date, y double")
        return df.withColumn("amount", F.col("y").cast("decimal(28,2)")).withColumn("lines", F.lit(1).cast("long"))
    return build
