from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path[:0] = [str(Path(__file__).resolve().parents[1]), str(Path(__file__).resolve().parent)]

from toy import SCHEMA, toy_rows, with_groups  # noqa: E402

from foldspark.operators import splits  # noqa: E402
from foldspark.session import local_session, materialize  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, shuffle_partitions=4)
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def toy(spark):
    return materialize(spark.createDataFrame(with_groups(toy_rows()), SCHEMA), "toy")


@pytest.fixture(scope="session")
def uses(toy):
    return splits.fold_uses(toy)


@pytest.fixture(scope="session")
def assigned(toy, uses):
    return materialize(splits.assign(toy, uses), "assigned")
