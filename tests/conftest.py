import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from evirank.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, "evirank-tests")
    session.sparkContext.setLogLevel("ERROR")
    yield session


@pytest.fixture
def by(spark):
    """Rows of a DataFrame as {key: row dict}; composite keys become tuples."""

    def collect(df, *keys):
        out = {}
        for r in df.collect():
            k = tuple(r[c] for c in keys) if len(keys) > 1 else r[keys[0]]
            assert k not in out, f"key {k} is not unique"
            out[k] = r.asDict(recursive=True)
        return out

    return collect
