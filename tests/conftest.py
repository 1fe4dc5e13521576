import pytest

from seriesmill.session import build_session


@pytest.fixture(scope="session")
def spark():
    return build_session("local[4]", "tests", **{"spark.sql.shuffle.partitions": "4", "spark.driver.memory": "4g", "spark.sql.warehouse.dir": "/tmp/seriesmill-warehouse"})
