"""Tables written between the steps of a job, in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_written: dict[str, SparkSession] = {}


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only in local mode, where all share one disk, may the setting be absent; a folder is made then.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if not root:
        if not context.master.startswith("local[") and context.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if context.getCheckpointDir() is None:
            context.setCheckpointDir(tempfile.mkdtemp(prefix="porewise-"))
        root = os.path.dirname(context.getCheckpointDir())
    elif context.getCheckpointDir() is None:
        context.setCheckpointDir(root)
    return root.rstrip("/")


@atexit.register
def remove_written() -> None:
    """Delete what this application has written between steps; runs when the driver ends."""
    while _written:
        folder, spark = _written.popitem()
        try:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
        except Exception:  # noqa: BLE001 - the JVM may be gone already; the folder is named after the application
            continue


def new_folder(spark: SparkSession, name: str) -> str:
    """A path of its own in the application's folder under the shared root; nothing is created yet."""
    own = f"{shared_root(spark)}/porewise-{spark.sparkContext.applicationId}"
    _written.setdefault(own, spark)
    return f"{own}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write ``df`` as Parquet in the shared folder and read it again."""
    spark, schema = df.sparkSession, df.schema
    path = new_folder(spark, name)
    df.write.parquet(path)
    return spark.read.schema(schema).parquet(path)
