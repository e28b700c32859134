"""Cutting lineage through the folder that driver and executors share.

Tables saved there live as long as they are needed: ``discard`` drops one whose
successor is written, and what is left goes when the application ends.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the session names it.

    Only a session on this machine alone (``local``, as in tests) that names
    none gets a temporary folder; on a cluster that would be a different folder
    on each machine, so it is an error.
    """
    context = spark.sparkContext
    current = context._jsc.sc().getCheckpointDir()
    path = spark.conf.get("spark.checkpoint.dir", None) or (current.get() if current.isDefined() else None)
    if not path:
        if context.master.partition("[")[0] != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        path = tempfile.mkdtemp(prefix="spark-checkpoint-")
        delete_at_end(spark, path)
    if not current.isDefined():
        context.setCheckpointDir(path)
        delete_at_end(spark, context._jsc.sc().getCheckpointDir().get())
    return path


def _files(spark: SparkSession, path: str):
    """(file system, path) on the JVM's side, so that any store Spark knows will do."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), at


def delete_at_end(spark: SparkSession, path: str) -> None:
    files, at = _files(spark, path)
    files.deleteOnExit(at)


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` computed once, its partitions kept as they are, in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def saved(df: DataFrame) -> DataFrame:
    """``df`` computed once, as a Parquet table in the shared folder."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/saved-{uuid.uuid4().hex}"
    delete_at_end(spark, path)
    df.write.option("compression", "zstd").parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table._saved_at = path
    return table


def discard(*tables: DataFrame | None) -> None:
    """Deletes tables made by ``saved`` that no table still to be computed reads."""
    for table in tables:
        if path := getattr(table, "_saved_at", None):
            files, at = _files(table.sparkSession, path)
            files.delete(at, True)
