import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from tidegauge.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session("tests", 4)
    yield session
    session.stop()


def frame(spark, ddl, rows):
    return spark.createDataFrame(rows, ddl)


def values(df, column, order="trade_date"):
    return [r[column] for r in df.orderBy(order).collect()]
