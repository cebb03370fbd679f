import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tidemark.session import local_session, tune  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(cores=8, app="tests")
    tune(session)
    yield session
    session.stop()


@pytest.fixture
def conf(spark):
    """Set session options for one test and put the old ones back."""
    old = {}

    def put(**options):
        for name, value in options.items():
            key = name.replace("__", ".")
            old.setdefault(key, spark.conf.get(key, None))
            spark.conf.set(key, str(value))

    yield put
    for key, value in old.items():
        spark.conf.unset(key) if value is None else spark.conf.set(key, value)
