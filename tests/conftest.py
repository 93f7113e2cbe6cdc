import sys
import tempfile
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark():
    from pitwise.session import session

    found = session(
        "local[4]",
        **{
            "spark.sql.shuffle.partitions": "4",
            "spark.ui.enabled": "false",
            "spark.driver.memory": "4g",
            "spark.checkpoint.dir": "file://" + tempfile.mkdtemp(prefix="pitwise-test-"),
        },
    )
    found.sparkContext.setLogLevel("ERROR")
    yield found
    found.stop()
