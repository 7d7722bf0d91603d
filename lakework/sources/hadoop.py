"""Small files through the file system API that Spark itself uses, so any store works."""

from __future__ import annotations

from pyspark.sql import SparkSession


def _open_fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    hadoop_path = jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), hadoop_path


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _open_fs(spark, path)
    return fs.exists(p)


def list_names(spark: SparkSession, path: str) -> list[str]:
    """Names of the entries of a folder; a missing folder is empty."""
    fs, p = _open_fs(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []


def read_text(spark: SparkSession, path: str) -> str:
    fs, p = _open_fs(spark, path)
    stream = fs.open(p)
    try:
        return bytes(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode("utf-8")
    finally:
        stream.close()


def write_text_once(spark: SparkSession, path: str, text: str) -> None:
    """Write a file that readers see whole or not at all; an existing one is not replaced."""
    fs, p = _open_fs(spark, path)
    _, part = _open_fs(spark, f"{path}.part")
    stream = fs.create(part, True)
    try:
        stream.write(bytearray(text.encode("utf-8")))
    finally:
        stream.close()
    if fs.exists(p) or not fs.rename(part, p):
        raise FileExistsError(path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder that this library wrote."""
    fs, p = _open_fs(spark, path)
    fs.delete(p, True)
