import pytest
from pyspark.sql import SparkSession

from corvane.session import configured


@pytest.fixture(scope="session")
def spark():
    session = configured(SparkSession.builder.master("local[4]").appName("tests")).config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.driver.memory", "6g").getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return "/root/testdata/sf0.001"
