from __future__ import annotations

import datetime as dt
import sys
from pathlib import Path

import pytest

sys.path[:0] = [str(Path(__file__).resolve().parents[1]), str(Path(__file__).resolve().parent)]

from ebbtide.session import build_session, reach_workers  # noqa: E402

TESTDATA = Path("/root/testdata")


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "tests",
        "local[*]",
        **{"spark.sql.shuffle.partitions": "8", "spark.ui.showConsoleProgress": "false"},
    )
    session.sparkContext.setLogLevel("ERROR")
    yield reach_workers(session)
    session.stop()


@pytest.fixture(scope="session")
def facts(spark):
    """Builds k, d, amount from (k, 'yyyy-mm-dd') or (k, 'yyyy-mm-dd', amount) rows."""

    def build(*rows):
        full = [(r[0], dt.date.fromisoformat(r[1]), float(r[2]) if len(r) > 2 else 1.0) for r in rows]
        return spark.createDataFrame(full, "k bigint, d date, amount double")

    return build


def as_set(df, *columns):
    return {tuple(r) for r in (df.select(*columns) if columns else df).collect()}
