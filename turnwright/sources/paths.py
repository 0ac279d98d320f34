"""Paths of folders and files."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def resolve(base: str, path: str) -> str:
    """path itself if it is absolute or names a file system, else below base."""
    return path if "://" in path or os.path.isabs(path) else os.path.join(base, path)


def files_below(spark: SparkSession, folder: str, ending: str) -> list[str]:
    """Paths of the files below a folder, at any depth, whose names have the ending, in order; empty files aren't listed. For folders of results,
    whose files are few: the list comes to the driver."""
    d = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", f"*{ending}").load(folder)
    return sorted(r.path for r in d.select("path").collect())
