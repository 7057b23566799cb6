"""File inventory and file heads."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from tablewright.functions import files as ff
from tablewright.functions.text import human_size

HEAD_BYTES = 1 << 16


def open_path(path: str):
    """(file system, path inside it) for any location Arrow can reach; used inside tasks."""
    from pyarrow import fs

    if path.startswith("file:/") and not path.startswith("file://"):
        path = "file://" + path[len("file:"):]
    if "://" not in path:
        return fs.LocalFileSystem(), path
    if path.startswith("file://"):
        return fs.LocalFileSystem(), path[len("file://"):]
    return fs.FileSystem.from_uri(path)


def same_path(c):
    """One spelling for local paths, whatever part of Spark reports them."""
    return F.regexp_replace(c, "^(file:)?/+", "file:///")


def list_files(spark: SparkSession, paths: list[str] | str) -> DataFrame:
    """(path, name, size, modified) of files and of everything below folders; contents are not read."""
    listed = (spark.read.format("binaryFile").option("recursiveFileLookup", True)
              .load(paths if isinstance(paths, list) else [paths]))
    return listed.select(same_path(F.col("path")).alias("path"), ff.base_name(F.col("path")).alias("name"),
                         F.col("length").alias("size"), F.col("modificationTime").alias("modified"))


def with_heads(files: DataFrame, n: int = HEAD_BYTES, path_col: str = "path") -> DataFrame:
    """Add ``head``: the first n bytes of each file, read by the task that holds its row."""
    columns = files.columns

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            heads = []
            for path in batch[path_col]:
                system, inner = open_path(path)
                with system.open_input_stream(inner, compression=None) as stream:
                    heads.append(stream.read(n))
            yield batch.assign(head=heads)[[*columns, "head"]]

    schema = T.StructType([*files.schema.fields, T.StructField("head", T.BinaryType())])
    return files.mapInPandas(read, schema)


def typed(files: DataFrame) -> DataFrame:
    """Add extension, kind, mime, is_tabular and reader to a frame with ``name`` and ``head``."""
    name, head = F.col("name"), F.col("head")
    return files.select(
        *files.columns, ff.extension(name).alias("extension"), ff.file_kind(name, head).alias("kind"),
        ff.media_type(name, head).alias("mime"), ff.is_tabular(name, head).alias("is_tabular"),
        ff.reader_of(name, head).alias("reader"))


def inventory(spark: SparkSession, paths: list[str] | str) -> DataFrame:
    """(path, name, extension, mime, size, size_human) per file."""
    return typed(with_heads(list_files(spark, paths), 4096)).select(
        "path", "name", "extension", "mime", "size", human_size(F.col("size")).alias("size_human"))
