"""Small files of the shared file system, through Hadoop's file API: what a
writer needs to switch a table from one version to the next."""

from __future__ import annotations

import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


def _path(spark: SparkSession, path: str):
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return jvm, p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    _, p, fs = _path(spark, path)
    return fs.exists(p)


def names(spark: SparkSession, path: str) -> list[str]:
    """Names directly under a folder, sorted; none if there is no such folder."""
    _, p, fs = _path(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []


def fingerprint(spark: SparkSession, path: str) -> tuple:
    """Changes when files come, go or are written anew at ``path``: number of
    files, their length, and when the file or folder last changed."""
    _, p, fs = _path(spark, path)
    if not fs.exists(p):
        return ()
    total = fs.getContentSummary(p)
    return (total.getFileCount(), total.getLength(), fs.getFileStatus(p).getModificationTime())


def delete(spark: SparkSession, path: str) -> None:
    _, p, fs = _path(spark, path)
    fs.delete(p, True)


def read_text(spark: SparkSession, path: str) -> str | None:
    """Content of a small file; None if there is none.  Other errors are raised."""
    jvm, p, fs = _path(spark, path)
    if not fs.exists(p):
        return None
    stream = fs.open(p)
    try:
        return bytes(jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode("utf-8")
    finally:
        stream.close()


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Write a small file that must not exist yet."""
    _, p, fs = _path(spark, path)
    stream = fs.create(p, False)
    try:
        stream.write(bytearray(text.encode("utf-8")))
    finally:
        stream.close()


def replace_text(spark: SparkSession, path: str, text: str) -> None:
    """Give a small file new content at once: readers see the old or the new
    one.  Needs a store whose rename is atomic (HDFS, local disks)."""
    draft = f"{path}.{uuid.uuid4().hex[:12]}"
    write_text(spark, draft, text)
    jvm, p, _ = _path(spark, path)
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(
        p.toUri(), spark._jsc.hadoopConfiguration())
    rename = jvm.org.apache.hadoop.fs.Options.Rename
    how = spark.sparkContext._gateway.new_array(rename, 1)
    how[0] = rename.OVERWRITE
    try:
        context.rename(jvm.org.apache.hadoop.fs.Path(draft), p, how)
    except Py4JJavaError:
        delete(spark, draft)
        raise
