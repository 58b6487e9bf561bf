import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
sys.path.insert(0, os.path.join(ROOT, "tests"))

SF_SMALL = "/root/testdata/sf0.001"
SF_ORACLE = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from candela.session import get_session
    s = get_session(master="local[4]", shuffle_partitions=4)
    yield s


def bars_frame(spark, closes, volumes=None, start="2020-01-01", ticker="T", opens=None):
    """A bar series from explicit closes (High/Low bracket Open and Close)."""
    import datetime as dt
    d0 = dt.date.fromisoformat(start)
    rows = []
    for i, c in enumerate(closes):
        o = opens[i] if opens else c
        v = volumes[i] if volumes else 1000
        rows.append((ticker, d0 + dt.timedelta(days=i), float(o), float(max(o, c)) + 1.0,
                     float(min(o, c)) - 1.0, float(c), int(v)))
    from candela.schema import BAR
    return spark.createDataFrame(rows, BAR)
