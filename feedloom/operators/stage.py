"""Tables between the jobs of an iterative operator: written to the folder that driver and executors share, then removed."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a local session that has none gets a temporary folder, a cluster must set it."""
    sc = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not root:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="spark-shared-")
        sc.setCheckpointDir(root)
    return root.rstrip("/")


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder that this library wrote."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


class Stage:
    """Written tables by name; a table that is written again replaces the one before, which is then deleted."""

    def __init__(self, spark: SparkSession):
        self.spark, self.root, self.paths = spark, f"{shared_folder(spark)}/stage-{uuid.uuid4().hex}", {}

    def write(self, df: DataFrame, name: str, by: str | None = None) -> DataFrame:
        """``df`` written and read back: lineage ends here, and lost executors cost nothing. ``by``: a folder for each value."""
        path, before = f"{self.root}/{name}-{uuid.uuid4().hex}", self.paths.get(name)
        (df.write.partitionBy(by) if by else df.write).parquet(path)
        self.paths[name] = path
        if before:
            remove(self.spark, before)
        return self.spark.read.schema(df.schema).parquet(path)

    def close(self) -> None:
        """Delete all that is left."""
        remove(self.spark, self.root)
