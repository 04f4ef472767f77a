import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
os.environ["PYTHONPATH"] = f"{sys.path[0]}:{os.environ.get('PYTHONPATH', '')}"

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from foldspark.session import spark_session

    shared = tmp_path_factory.mktemp("shared")
    session = spark_session("local[4]", 4, spark__driver__memory="3g", spark__checkpoint__dir=f"file://{shared}")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
