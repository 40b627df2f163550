"""Small files and folders by Spark's own file system, so that any store works that Spark reads."""

from __future__ import annotations

from pyspark.sql import SparkSession


def place(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def exists(spark: SparkSession, path: str) -> bool:
    fs, where = place(spark, path)
    return fs.exists(where)


def remove(spark: SparkSession, path: str) -> None:
    fs, where = place(spark, path)
    fs.delete(where, True)


def names(spark: SparkSession, path: str) -> list[str]:
    fs, where = place(spark, path)
    return sorted(x.getPath().getName() for x in fs.listStatus(where)) if fs.exists(where) else []


def read_text(spark: SparkSession, path: str) -> str | None:
    fs, where = place(spark, path)
    if not fs.exists(where):
        return None
    stream = fs.open(where)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Written beside its place and then renamed, so a reader sees the old text or the new one."""
    fs, where = place(spark, path)
    _, beside = place(spark, path + ".new")
    stream = fs.create(beside, True)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()
    fs.delete(where, False)
    if not fs.rename(beside, where):
        raise OSError(f"could not rename {path}.new")
