"""Tables written under the session's shared checkpoint folder to cut lineage."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from pairlab.config import state_path


class Run:
    """The scratch tables of one call; a lost executor costs a reread, never a recomputation.

    ``drop`` deletes tables that no later plan reads. What the returned DataFrame reads
    stays until the owner of the checkpoint folder cleans it.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = state_path(spark, "llm", f"{name}-{uuid.uuid4().hex}")

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        path = self.path(name)
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        jvm = self.spark.sparkContext._jvm
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(self.path(name))
            path.getFileSystem(conf).delete(path, True)
