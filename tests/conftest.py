"""A local session for all tests."""

from __future__ import annotations

import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
os.environ.setdefault("PYSPARK_PYTHON", sys.executable)
os.environ["PYTHONPATH"] = os.pathsep.join([str(ROOT), *filter(None, [os.environ.get("PYTHONPATH")])])


@pytest.fixture(scope="session")
def spark():
    from tabloom.session import session

    found = session(
        f"local[{os.environ.get('TEST_CPUS', 8)}]", "tests",
        **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "6g", "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false"},
    )
    found.sparkContext.setLogLevel("ERROR")
    yield found
    found.stop()
