import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from evidar.session import local_session  # noqa: E402
from evidar.streaming.runner import with_rocksdb  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session("4", "evidar-tests")
    session.conf.set("spark.sql.shuffle.partitions", "4")
    with_rocksdb(session)
    yield session
    session.stop()
