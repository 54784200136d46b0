import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
if ROOT not in sys.path:
    sys.path.insert(0, ROOT)


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from segspark import get_spark

    session = get_spark(
        "tests", "local[8]",
        **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "6g",
           "spark.checkpoint.dir": f"file:{tmp_path_factory.mktemp('scratch')}"},
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
