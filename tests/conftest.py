import pytest

from siftline.session import session


@pytest.fixture(scope="session")
def spark():
    s = session("tests", 4, **{"spark.sql.shuffle.partitions": "4", "spark.ui.showConsoleProgress": "false"})
    s.sparkContext.setLogLevel("ERROR")
    yield s
