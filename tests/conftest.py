import pytest

from lexmill.session import local_session


@pytest.fixture(scope="session")
def spark():
    session = local_session("lexmill-tests", "4", spark__sql__shuffle__partitions="4")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"


@pytest.fixture
def apply(spark):
    """Run a Column builder over a list of strings."""

    def run(fn, values):
        from pyspark.sql import functions as F

        df = spark.createDataFrame(list(enumerate(values)), "i int, t string").coalesce(1)
        rows = df.select("i", fn(F.col("t")).alias("o")).orderBy("i").collect()
        return [r["o"] for r in rows]

    return run
