import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark():
    from strata.session import get_spark

    session = get_spark("tests", 4, **{"spark.sql.shuffle.partitions": "4", "spark.default.parallelism": "4", "spark.driver.memory": "3g"})
    session.sparkContext.setLogLevel("ERROR")
    return session
