import pathlib
import sys

import pytest

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parents[1]))

from framequarry.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, "4g", "framequarry-tests")
    session.conf.set("spark.sql.shuffle.partitions", "4")
    yield session
    session.stop()
