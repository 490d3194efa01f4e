import os, sys
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from millrace.session import local_session

    session = local_session(4, shuffle_partitions=4, memory="4g", **{"spark.ui.showConsoleProgress": "false", "spark.sql.files.maxPartitionBytes": "64k", "spark.sql.adaptive.coalescePartitions.enabled": "false"})
    yield session
    session.stop()
