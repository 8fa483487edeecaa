"""Tables between two passes of one operator, in the folder that all executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``. Where it is unset, a session of one process makes a local
    folder; on a cluster that is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not re.match(r"local($|\[)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="tallymill-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def hadoop_path(spark: SparkSession, path: str):
    """The path and its file system, as Spark's own readers see them."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


class Staging:
    """Tables of one operator's run. ``keep`` writes and reads back, which cuts the
    lineage; ``clear`` removes all but the tables named."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, {}

    def keep(self, df: DataFrame, tag: str) -> DataFrame:
        path = f"{shared_folder(self.spark)}/staged/{tag}-{uuid.uuid4().hex}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = (path, out)
        return out

    def drop(self, df: DataFrame | None) -> None:
        if id(df) in self.paths:
            at, files = hadoop_path(self.spark, self.paths.pop(id(df))[0])
            files.delete(at, True)

    def clear(self, *but: DataFrame) -> None:
        for _, df in list(self.paths.values()):
            if all(df is not x for x in but):
                self.drop(df)
