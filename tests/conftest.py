import pytest

from passagelake.session import local


@pytest.fixture(scope="session")
def spark():
    return local(4, "4g", **{"spark.sql.shuffle.partitions": "4"})
