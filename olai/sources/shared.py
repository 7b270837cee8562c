"""Tables in the folder that driver and executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where it is unset, a folder in the warehouse, or a temporary one if all runs in one process."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        local = re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master)
        found = "file://" + tempfile.mkdtemp(prefix="olai-shared-") if local else spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_olai-shared"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts the lineage at a table that survives the loss of executors. The
    folder goes when the session ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(target)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """Deal the rows of a scan out anew where it has far fewer files than there are cores.

    A table in one small file is one task otherwise. Tables of many files are
    left as they are; select the columns first, as they are what is shuffled.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if len(df.inputFiles()) * 2 <= cores else df
