"""Tables between the steps of a loop: written, read again, and removed together."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


class Stages:
    """Writes tables below `base`, by default the folder in spark.checkpoint.dir that all executors share; a local master may do without one.

    What is written survives lost executors and cuts the plan. The session's settings stay as they are.
    """

    def __init__(self, spark: SparkSession, base: str | None = None):
        base = base or spark.conf.get("spark.checkpoint.dir", None)
        if not base:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir names no folder that all executors share")
            base = os.path.join(tempfile.gettempdir(), "seriesforge-stages")
        self.spark, self.path = spark, f"{base.rstrip('/')}/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"

    def __call__(self, df: DataFrame) -> DataFrame:
        path = f"{self.path}/{uuid.uuid4().hex}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def clear(self) -> None:
        """Removes all tables of this object; results that still read them must be written first."""
        p = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)
