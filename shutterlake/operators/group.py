"""Files that make up one asset."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shutterlake.functions.paths import basename, dirname, stem


def _id(*parts) -> F.Column:
    return F.md5(F.concat_ws("\x00", *parts))


def group_takeout(rows: DataFrame) -> DataFrame:
    """rows(path, sidecar) with group_id: files of one side file are one asset, files without are assets of their own."""
    with_side = _id(F.lit("takeout"), F.lit("sidecar"), F.col("sidecar"))
    return rows.withColumn("group_id", F.when(F.col("sidecar").isNotNull(), with_side).otherwise(_id(F.lit("takeout"), F.lit("media"), F.col("path"))))


def group_archive(rows: DataFrame) -> DataFrame:
    """rows(path) with group_id: files of one directory and literal stem are one asset."""
    return rows.withColumn("group_id", _id(F.lit("archive"), dirname(F.col("path")), stem(basename(F.col("path")))))


def file_id(path: F.Column) -> F.Column:
    """A file's reproducible id of 32 hexadecimal digits."""
    return F.md5(path)
