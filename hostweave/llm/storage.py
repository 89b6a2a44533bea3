"""Tables and folders that the stages of one operator hand on, in storage that all executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hostweave.operators.scale import checkpoint_folder


# Rows that go to Python together, where the session does not say.
BATCH_ROWS = 2_000


def small_batches(df: DataFrame) -> DataFrame:
    """The table itself, in a session that hands few long texts to Python at a time."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    spark = df.sparkSession
    if not spark.sparkContext.getConf().contains(name) and int(spark.conf.get(name)) == 10_000:
        spark.conf.set(name, str(BATCH_ROWS))
    return df


def new_folder(spark: SparkSession, name: str) -> str:
    """Address of a new folder under ``spark.checkpoint.dir``."""
    return f"{checkpoint_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str = "table") -> DataFrame:
    """Write the table and read it back: cuts lineage, and its size is then known to the planner."""
    spark = df.sparkSession
    path = new_folder(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table_bytes(df: DataFrame, column: str = "text") -> int:
    """Size of the table as the planner knows it (for files, their size), else that of the column's texts."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if size < 1 << 60:
        return size
    return df.agg(F.sum(F.octet_length(column))).first()[0] or 0
