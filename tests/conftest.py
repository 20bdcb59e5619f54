import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from foliospark.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    return local_session(8, "tests", memory="6g")


@pytest.fixture(scope="session")
def docs(spark):
    """Documents from JSON texts: ``docs([{...}, ...])``."""
    import json

    from pyspark.sql import functions as F

    def make(values):
        rows = [(str(i), v if isinstance(v, str) else json.dumps(v)) for i, v in enumerate(values)]
        return spark.createDataFrame(rows, "_id string, doc string").withColumn("v", F.try_parse_json("doc"))

    return make
