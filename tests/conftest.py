import pytest

from commitlake.session import build_session, ship


@pytest.fixture(scope="session")
def spark():
    session = build_session("local[4]", **{"spark.sql.shuffle.partitions": "4", "spark.driver.memory": "4g"})
    session.sparkContext.setLogLevel("ERROR")
    ship(session)
    yield session
    session.stop()
