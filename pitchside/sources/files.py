"""Small control files on any file system Spark can reach.

Commit markers are a few bytes each; they go through Hadoop's file API, so that
they work wherever the tables are (``file:``, ``hdfs:``, object stores). A marker
is written aside under a hidden name and then renamed without overwriting: it is
there whole or not at all, and the first of two writers wins. The rename is
atomic on HDFS; where a file system only checks and then renames (local disks,
some object stores) one writer at a time is assumed.
"""

from __future__ import annotations

import re
import uuid
from urllib.parse import unquote

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


def _at(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(spark._jsc.hadoopConfiguration())
    return fs, fs.makeQualified(target)


def create_new(spark: SparkSession, path: str, text: str) -> bool:
    """Create ``path`` with ``text``; False if it is there already."""
    fs, target = _at(spark, path)
    if fs.exists(target):
        return False
    hadoop = spark._jvm.org.apache.hadoop.fs
    aside = hadoop.Path(target.getParent(), f".{target.getName()}.{uuid.uuid4().hex}")
    out = fs.create(aside, False)
    try:
        out.write(bytearray(text.encode("utf-8")))
    finally:
        out.close()
    keep = spark._sc._gateway.new_array(hadoop.Options.Rename, 1)
    keep[0] = hadoop.Options.Rename.NONE
    try:
        hadoop.FileContext.getFileContext(target.toUri(), spark._jsc.hadoopConfiguration()).rename(aside, target, keep)
    except Py4JJavaError as e:
        fs.delete(aside, False)
        if "AlreadyExists" in str(e.java_exception):
            return False
        raise
    return True


def exists(spark: SparkSession, path: str) -> bool:
    fs, target = _at(spark, path)
    return fs.exists(target)


def names(spark: SparkSession, folder: str) -> list[str]:
    """Names in a folder, sorted, without hidden ones (a file still being written
    is hidden); none where the folder does not exist. Any other failure is raised."""
    fs, target = _at(spark, folder)
    if not fs.exists(target):
        return []
    found = (s.getPath().getName() for s in fs.listStatus(target))
    return sorted(n for n in found if not n.startswith("."))


def read_text(spark: SparkSession, path: str) -> str:
    fs, target = _at(spark, path)
    stream = fs.open(target)
    try:
        size = fs.getFileStatus(target).getLen()
        return bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream, int(size))).decode("utf-8")
    finally:
        stream.close()


def delete(spark: SparkSession, path: str) -> None:
    fs, target = _at(spark, path)
    fs.delete(target, True)


def empty_files(spark: SparkSession, folders: str | list[str]) -> list[str]:
    """Files of no bytes under folders, hidden ones left out. Spark's readers plan
    no task for them, so only the listing knows of them: it is Spark's own, and has
    more files than are read where some are empty. Names come to the driver only then."""
    read = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folders).select("path")
    listed = read._jdf.inputFiles()
    if len(listed) == read.count():
        return []
    plain = lambda f: re.sub("^file:/+", "file:/", f)  # noqa: E731    both ways to write a local one
    return sorted({plain(unquote(f)) for f in listed} - {plain(r.path) for r in read.collect()})
