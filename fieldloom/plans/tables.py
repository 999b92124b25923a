"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from the session's settings.

    Only on a local master, and where neither ``spark.checkpoint.dir`` nor a checkpoint folder is
    set (tests on one machine), a temporary one is made.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        folder = tempfile.mkdtemp(prefix="fieldloom-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def save(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it again: the lineage ends there, and a lost
    executor costs no more than the rows' second reading."""
    path = new_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def file_system(spark: SparkSession, path: str) -> tuple:
    """The file system of a path, and the path as it takes it."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), place


def delete(spark: SparkSession, path: str) -> None:
    """Delete a file or folder, if it is there."""
    files, place = file_system(spark, path)
    files.delete(place, True)


def remove(df: DataFrame) -> None:
    """Delete the files of a table that ``save`` made and nothing reads any more."""
    for name in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        delete(df.sparkSession, name)


def read_text(spark: SparkSession, path: str) -> str | None:
    """The text of a small file, such as a manifest; none if it isn't there."""
    files, place = file_system(spark, path)
    if not files.exists(place):
        return None
    stream = files.open(place)
    try:
        return bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode("utf-8")
    finally:
        stream.close()


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Write a small file beside its place and move it there."""
    files, place = file_system(spark, path)
    beside = file_system(spark, f"{path}.{uuid.uuid4().hex}")[1]
    stream = files.create(beside)
    try:
        stream.write(bytearray(text.encode("utf-8")))
    finally:
        stream.close()
    files.delete(place, False)
    files.rename(beside, place)
