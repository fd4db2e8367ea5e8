import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
for path in (ROOT, os.path.join(ROOT, "tests")):
    if path not in sys.path:
        sys.path.insert(0, path)


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from leafmill.session import get_session

    session = get_session(
        "leafmill-tests",
        **{
            "spark.master": "local[8]",
            "spark.ui.enabled": "false",
            "spark.driver.memory": "8g",
            "spark.sql.shuffle.partitions": "8",
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture()
def new_folder(spark):
    """A new path below the shared folder of the session."""
    from leafmill.session import scratch_path

    return scratch_path(spark, "test")
