import pytest

from turnwright.session import build_session


@pytest.fixture(scope="session")
def spark():
    s = build_session("tests", master="local[4]", cores=4)
    s.sparkContext.setLogLevel("ERROR")
    s.conf.set("spark.sql.shuffle.partitions", "2")
    yield s
    s.stop()


TINY = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def tiny():
    return TINY
