"""Tables that cut an iteration's lineage: written to the folder that driver and executors share, so that a lost executor costs one step."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where unset, a folder of its own for a local session, and an error on a cluster, whose executors would write to their own disks."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="trialwise-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


class Steps:
    """The tables of one run. Those that no later step reads are dropped as it goes on."""

    def __init__(self, spark: SparkSession, tag: str):
        self.spark, self.root, self.paths = spark, f"{shared_folder(spark)}/{tag}-{uuid.uuid4().hex}", []

    def write(self, df: DataFrame) -> DataFrame:
        path = f"{self.root}/{len(self.paths)}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths.append((out, path))
        return out

    def drop(self, df: DataFrame | None) -> None:
        for own, path in self.paths:
            if own is df:
                self._delete(path)

    def remove(self) -> None:
        """Deletes all tables: what was made of them must have been written or collected."""
        self._delete(self.root)

    def _delete(self, path: str) -> None:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)
