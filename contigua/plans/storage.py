"""Where iterative plans cut their lineage: written tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


class Rounds:
    """What the rounds of an iterative plan add, each written to one folder: read as one table, however many there are."""

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark, self.path, self.n, self.schema = spark, new_path(spark, name), 0, None

    def add(self, df: DataFrame) -> DataFrame:
        """Writes df as the next round; returns it, read again."""
        path = f"{self.path}/r{self.n:05d}"
        df.write.parquet(path)
        self.n, self.schema = self.n + 1, df.schema
        return self.spark.read.schema(df.schema).parquet(path)

    def all(self) -> DataFrame:
        return self.spark.read.schema(self.schema).option("recursiveFileLookup", "true").parquet(self.path)


def new_path(spark: SparkSession, name: str) -> str:
    """A new folder under spark.checkpoint.dir; unset, a temporary one serves, in local mode alone."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = f"file://{tempfile.gettempdir()}/contigua-shared"
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """df, written to the shared folder and read again."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
