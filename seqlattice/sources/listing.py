"""File listings as tables."""

from __future__ import annotations

import os
from fnmatch import fnmatch

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqlattice.sources.text import sample_of


def absolute(path: str, base: str = ".") -> str:
    """``path`` itself if it is absolute or a URI, else below ``base``."""
    if path.startswith("/") or "://" in path or path.startswith("file:"):
        return path
    return f"{base.rstrip('/')}/{path}" if "://" in base or base.startswith("/") else os.path.abspath(os.path.join(base, path))


def store(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path and the path inside it."""
    return fs.FileSystem.from_uri(absolute(path))


def list_files(spark: SparkSession, folder: str, glob: str) -> DataFrame:
    """``path, bytes`` of the files below ``folder``, empty ones too.

    The planner lists file names the same way for any file source; Spark's own listing leaves out
    empty files, which here mean that a sample has no record.
    """
    system, root = store(folder)
    found = system.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True))
    listed = [(f.path, f.size) for f in found if f.type == fs.FileType.File and fnmatch(f.base_name, glob)]
    return spark.createDataFrame(listed, "path STRING, bytes BIGINT")


def sample_files(spark: SparkSession, folder: str, glob: str, suffix: str) -> DataFrame:
    """``sample, path, bytes`` with the sample taken from the file name."""
    return list_files(spark, folder, glob).select(sample_of(F.col("path"), suffix).alias("sample"), "path", "bytes")
