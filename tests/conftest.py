import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[4]").appName("tests").config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "4g").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    session.sparkContext.setLogLevel("OFF")
    yield session


@pytest.fixture
def files(spark):
    """File rows from a dict of path to text."""
    from pyspark.sql import functions as F

    from vigilake.sources.files import files_from_table

    def make(contents):
        df = spark.createDataFrame(list(contents.items()), "p string, t string")
        return files_from_table(df, path=F.col("p"), text=F.col("t"))

    return make
