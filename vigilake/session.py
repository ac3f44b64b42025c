"""Session helpers: durable cut points and skew-safe joins."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write the rows to a table in the shared scratch folder and go on from there.

    The rows are computed once, which a checkpoint would do twice, and lost executors cost no recomputation.
    """
    folder = scratch_folder(df.sparkSession, "cut")
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


#: Inputs of at most so many partitions are samples on one machine.
FEW_FILES = 4


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Spread a sample that lies in one or a few files over all cores. An input of more partitions is never shuffled."""
    context = df.sparkSession.sparkContext
    if df.rdd.getNumPartitions() > min(FEW_FILES, context.defaultParallelism - 1):
        return df
    return df.repartition(context.defaultParallelism, *keys)


#: Rows of a narrow table that make one task, where a row on disk is little and the work on it much.
ROWS_PER_TASK = 50_000


def spread_rows(df: DataFrame, *keys: str) -> DataFrame:
    """Deal narrow rows that are much work each: the number of tasks follows the number of rows, not of bytes.

    The rows of Parquet files are counted from their footers.
    """
    tasks = -(-df.count() // ROWS_PER_TASK)
    return df.repartition(max(tasks, df.sparkSession.sparkContext.defaultParallelism), *keys)


#: Rows of one key from which a join deals them to several tasks.
HOT_ROWS = 100_000


def join_tasks(spark: SparkSession) -> int:
    """Tasks of a shuffle as configured, and one per core at least."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


def salted_join(
    big: DataFrame, small: DataFrame, on: Sequence[str], spread_by: Sequence[str], how: str = "inner", salts: int = 16,
    hot_rows: int | None = None,
) -> DataFrame:
    """Equi join in which the rows of one hot key of ``big`` are dealt to ``salts`` tasks.

    ``small`` is copied once per salt. No size is assumed: Spark broadcasts the copy if its statistics allow it and
    shuffles both sides otherwise, and then no key holds more than a sixteenth of its rows in one task. With
    ``hot_rows`` only keys with more rows than that are dealt and copied; there are few of them, whatever the size.
    """
    salt = F.pmod(F.xxhash64(*[F.col(c) for c in spread_by]), F.lit(salts)).cast("int")
    every = F.array(*[F.lit(i) for i in range(salts)])
    if hot_rows is not None:
        hot = F.broadcast(big.groupBy(*on).agg(F.count("*").alias("_n")).where(F.col("_n") > hot_rows).select(*on, F.lit(True).alias("_hot")))
        big, small = big.join(hot, [*on], "left"), small.join(hot, [*on], "left")
        salt, every = F.when(F.col("_hot"), salt).otherwise(0), F.when(F.col("_hot"), every).otherwise(F.array(F.lit(0)))
    left = big.withColumn("_salt", salt).drop("_hot")
    right = small.withColumn("_salt", F.explode(every)).drop("_hot")
    return left.join(right, [*on, "_salt"], how).drop("_salt")


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def any_of(tests: Sequence[Column]) -> Column:
    out = tests[0]
    for test in tests[1:]:
        out = out | test
    return out


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A new folder for intermediate files: below the shared checkpoint folder, or a temporary one on a single machine."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if shared:
        return f"{shared.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    return tempfile.mkdtemp(prefix=f"vigilake-{name}-") + "/data"


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession, *folders: str) -> None:
    """Make Python packages importable on the executors, once per application. Without folders this package is sent."""
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    target = os.path.join(tempfile.mkdtemp(prefix="vigilake-ship-"), "vigilake_packages.zip")
    with zipfile.ZipFile(target, "w") as archive:
        for folder in folders or (os.path.dirname(os.path.abspath(__file__)),):
            base = os.path.dirname(os.path.abspath(folder))
            for place, _, names in os.walk(folder):
                for name in names:
                    if name.endswith(".py"):
                        full = os.path.join(place, name)
                        archive.write(full, os.path.relpath(full, base))
    context.addPyFile(target)
    _SHIPPED.add(context.applicationId)
