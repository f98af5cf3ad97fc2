import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))


@pytest.fixture(scope="session")
def spark():
    from wardpanel.session import build_session

    session = build_session("tests", "local[8]", 8)
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture()
def ranged(spark):
    """Forces the form for groups of any size."""
    spark.conf.set("wardpanel.group.rows", "3")
    yield
    spark.conf.unset("wardpanel.group.rows")
