import pytest


@pytest.fixture(scope="session", autouse=True)
def quiet(spark):
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    yield
