import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
from skyloom.session import get_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = get_session(
        "local[4]", "tests",
        **{"spark.sql.shuffle.partitions": "4", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "4g", "spark.sql.sources.partitionOverwriteMode": "dynamic", "spark.default.parallelism": "4"},
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
