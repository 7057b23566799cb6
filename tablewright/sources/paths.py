"""Path checks through Hadoop's file system, so they hold for every storage Spark can reach."""

from __future__ import annotations

from pyspark.sql import SparkSession


def _fs_and_path(spark: SparkSession, path: str):
    jvm = spark._jvm
    hpath = jvm.org.apache.hadoop.fs.Path(path)
    return hpath.getFileSystem(spark._jsc.hadoopConfiguration()), hpath


def qualified(spark: SparkSession, path: str) -> str:
    """The path with its file system named, so that tasks open it where the driver means it."""
    fs, hpath = _fs_and_path(spark, path)
    return fs.makeQualified(hpath).toString()


def path_exists(spark: SparkSession, path: str) -> bool:
    fs, hpath = _fs_and_path(spark, path)
    return fs.exists(hpath)


def child_names(spark: SparkSession, path: str) -> list[str]:
    """Names directly below ``path``; empty when the path does not exist."""
    fs, hpath = _fs_and_path(spark, path)
    if not fs.exists(hpath):
        return []
    return sorted(status.getPath().getName() for status in fs.listStatus(hpath))


def delete_path(spark: SparkSession, path: str) -> bool:
    fs, hpath = _fs_and_path(spark, path)
    return fs.delete(hpath, True)


def tree_size(spark: SparkSession, path: str) -> int:
    """Bytes below ``path``."""
    fs, hpath = _fs_and_path(spark, path)
    return fs.getContentSummary(hpath).getLength() if fs.exists(hpath) else 0


def claim(spark: SparkSession, path: str) -> bool:
    """Make an empty file; false when it is there already."""
    fs, hpath = _fs_and_path(spark, path)
    fs.mkdirs(hpath.getParent())
    return fs.createNewFile(hpath)


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file of metadata, written from the driver."""
    fs, hpath = _fs_and_path(spark, path)
    out = fs.create(hpath, True)
    try:
        out.write(bytearray(text.encode("utf-8")))
    finally:
        out.close()
