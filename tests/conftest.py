import pytest

from loomline.session import get_spark


@pytest.fixture(scope="session")
def spark():
    session = get_spark("tests")
    session.sparkContext.setLogLevel("ERROR")
    return session
