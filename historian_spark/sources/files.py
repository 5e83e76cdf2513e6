"""Small text files and folders on whatever file system a path names."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


def _at(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def exists(spark: SparkSession, path: str) -> bool:
    fs, where = _at(spark, path)
    return fs.exists(where)


def names(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder, sorted; none if there is no such folder."""
    fs, where = _at(spark, path)
    return sorted(x.getPath().getName() for x in fs.listStatus(where)) if fs.exists(where) else []


def usage(spark: SparkSession, path: str) -> tuple[int, int]:
    """Files and bytes below a path."""
    fs, where = _at(spark, path)
    if not fs.exists(where):
        return 0, 0
    found = fs.getContentSummary(where)
    return found.getFileCount(), found.getLength()


def delete(spark: SparkSession, path: str) -> None:
    fs, where = _at(spark, path)
    fs.delete(where, True)


def read_text(spark: SparkSession, path: str) -> str:
    fs, where = _at(spark, path)
    size = fs.getFileStatus(where).getLen()
    stream = fs.open(where)
    try:
        return bytes(stream.readNBytes(size)).decode()
    finally:
        stream.close()


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """The file appears whole: it is written under another name first."""
    fs, where = _at(spark, path)
    draft = spark._jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}.draft")
    stream = fs.create(draft, True)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()
    if not fs.rename(draft, where):
        raise OSError(f"{path} cannot be written")
