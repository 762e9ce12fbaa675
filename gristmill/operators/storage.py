"""Tables that are written once and read again, where recomputing would be slow or could differ."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names; a folder of our own only where none is set (local tests)."""
    found = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if found is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("Set spark.checkpoint.dir to a folder that the driver and all executors share.")
        found = tempfile.mkdtemp(prefix="spark-checkpoint-")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(found)
    return found


def saved(df: DataFrame, *folders: str) -> DataFrame:
    """Write ``df`` once to the shared checkpoint folder, by ``folders`` (columns) if given, and read it back: the lineage is
    cut, and lost executors cost nothing because the files are in the shared store."""
    spark = df.sparkSession
    path = os.path.join(ensure_checkpoint_dir(spark), f"table-{uuid.uuid4().hex}")
    (df.write.partitionBy(*folders) if folders else df.write).parquet(path)
    return spark.read.schema(df.schema).parquet(path)
