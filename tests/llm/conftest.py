import os

import pytest
from pyspark.sql import SparkSession

from vigilake.session import read_table

DIR = "/root/testdata/sf0.01"
DOCS = "doc_id long, text string"


@pytest.fixture(scope="session")
def tables(spark):
    if not os.path.isdir(DIR):
        pytest.skip("no test tables")
    return lambda name: read_table(spark, DIR, name)


@pytest.fixture
def docs(spark):
    """Documents from texts, in order of doc_id, with columns whose names clash with the operators' own."""

    def make(texts, first=0):
        rows = [(first + i, t, "kept", 5, "x") for i, t in enumerate(texts)]
        return SparkSession.getActiveSession().createDataFrame(rows, f"{DOCS}, kept string, size int, fp string")

    return make


ODD_TEXTS = [None, "", " ", "\n", "\n\n", "a", "A", "a b c", "a b c", "é è", "x" * 50_000, "word " * 20_000, "\t\x0b\x0c\r ", "a\x00b", "😀 " * 300]
