"""Tables that must outlive a task, in the folder that every executor sees."""

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder that the cluster names. Where none is named, a new one, for local sessions only: on a cluster
    a machine's own folder would be another one for each executor, so that is an error."""
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if named is None:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="lintel-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(named)
    return named


def settled(df: DataFrame) -> DataFrame:
    """The frame computed once, its lineage cut by a reliable checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def write_table(df: DataFrame, name: str, options: dict[str, str] | None = None) -> str:
    """The path of a new Parquet table in the shared folder that holds the frame; options are the Parquet writer's."""
    path = f"{shared_folder(df.sparkSession).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").options(**(options or {})).parquet(path)
    return path


def remove_table(spark: SparkSession, path: str) -> None:
    """Deletes a table that no frame reads any more."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
