import sys
import tempfile
from datetime import UTC, datetime
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from stopwise.params import Params  # noqa: E402
from stopwise.session import get_spark  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = get_spark(
        "local[8]",
        **{
            "spark.sql.shuffle.partitions": "8",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.driver.memory": "8g",
            "spark.sql.warehouse.dir": tempfile.mkdtemp(prefix="run-warehouse-"),
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture
def folder():
    return tempfile.mkdtemp(prefix="run-")


@pytest.fixture
def params():
    return Params(as_of=datetime(2025, 1, 15, 12, tzinfo=UTC), weather_station=None)


def utc(text: str) -> datetime:
    return datetime.fromisoformat(text).replace(tzinfo=UTC)


def ordered(tuples):
    return sorted((tuple(t) for t in tuples), key=lambda t: tuple(map(str, t)))


def rows(df, *columns):
    picked = df.select(*columns) if columns else df
    return ordered(picked.collect())
