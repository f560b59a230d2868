"""Paths on whatever file system Spark reads them from."""

from __future__ import annotations

import os
import re

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from ..validate import require

_SCHEME = re.compile(r"^[A-Za-z][A-Za-z0-9+.-]*:/*")


def _resolve(spark: SparkSession, path: str):
    """The Hadoop path, absolute and without ``.`` or doubled slashes, and its file system.

    A relative local path counts from the working directory of the caller, not from that of the JVM.
    """
    hadoop = spark._jvm.org.apache.hadoop.fs
    conf = spark._jsc.hadoopConfiguration()
    if not _SCHEME.match(path) and not path.startswith("/") and hadoop.FileSystem.get(conf).getScheme() == "file":
        path = os.path.abspath(path)
    found = hadoop.Path(path)
    system = found.getFileSystem(conf)
    return system.makeQualified(found), system


def qualify(spark: SparkSession, path: str) -> str:
    """The full URI of ``path``."""
    return _resolve(spark, path)[0].toString()


def file_key(spark: SparkSession, path: str) -> str:
    """What :func:`read_key` gives for the rows of this file."""
    return _SCHEME.sub("/", _resolve(spark, path)[0].toUri().toString())


def read_key() -> Column:
    """The file a row comes from, in the encoded form of its URI, without the scheme."""
    return F.regexp_replace(F.col("_metadata.file_path"), "^[A-Za-z][A-Za-z0-9+.-]*:/*", "/")


def is_file(spark: SparkSession, path: str) -> bool:
    found, system = _resolve(spark, path)
    return system.exists(found) and system.getFileStatus(found).isFile()


def check_file(spark: SparkSession, path: str) -> str:
    require(is_file(spark, path), f"file does not exist or is not a file: {path}")
    return qualify(spark, path)


def check_directory(spark: SparkSession, path: str) -> str:
    found, system = _resolve(spark, path)
    require(system.exists(found) and system.getFileStatus(found).isDirectory(),
            f"directory does not exist or is not a directory: {path}")
    return qualify(spark, path)
