"""Tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_path(spark: SparkSession, label: str) -> str:
    """A new path in the session's ``spark.checkpoint.dir``; only where none is set and the
    master is local (tests, a laptop), in a temporary folder."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = f"file://{tempfile.mkdtemp(prefix='hashloom-')}"
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/hashloom-{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str, **options) -> DataFrame:
    """The frame as a table in the shared folder: a cut of the lineage that survives the
    loss of any executor.  ``options`` are those of the writer."""
    path = shared_path(df.sparkSession, label)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def forget(df: DataFrame) -> None:
    """Deletes the files of a frame that :func:`written` made, once nothing reads it."""
    spark = df.sparkSession
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if "/hashloom-" in folder:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
