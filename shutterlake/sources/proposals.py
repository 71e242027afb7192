"""The log of proposals of a library: a table that only grows, read as an overlay of the records.

A proposal is one small row, whatever the size of its group; no record file is rewritten. The last entry of a group
counts. Now and then the log is rewritten to one entry a group.
"""

from __future__ import annotations

import os
import shutil
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shutterlake.operators import albums
from shutterlake.options import META_DIR
from shutterlake.sources.contents import local_uri, read_records

FOLDER = "proposals"
DDL = "group_id string, value string, version long"
#: Files of the log from which on it is compacted.
MOST_FILES = 64


def _folder(home: str) -> str:
    """The log's folder; a compaction that was cut off between its two moves is ended."""
    at = os.path.join(home, META_DIR, FOLDER)
    if not os.path.isdir(at) and os.path.isdir(at + ".old"):
        os.replace(at + ".old", at)
    return at


def log(spark: SparkSession, home: str) -> DataFrame:
    """(group_id, value, version) of all entries; a null value clears."""
    at = _folder(home)
    return spark.read.schema(DDL).parquet(local_uri(at)) if os.path.isdir(at) else spark.createDataFrame([], DDL)


def append(spark: SparkSession, home: str, group_id: str, album: str | None) -> None:
    """One more entry, later than all others."""
    entries = log(spark, home)
    last = entries.agg(F.max("version")).first()[0] or 0
    row = albums.propose(spark.createDataFrame([], DDL), group_id, album, max(last + 1, time.time_ns()))
    row.coalesce(1).write.mode("append").parquet(local_uri(_folder(home)))
    if sum(n.endswith(".parquet") for n in os.listdir(_folder(home))) >= MOST_FILES:
        compact(spark, home)


def compact(spark: SparkSession, home: str) -> None:
    """Rewrites the log to the last entry of each group, versions kept."""
    at = _folder(home)
    last = log(spark, home).groupBy("group_id").agg(F.max_by("value", "version").alias("value"), F.max("version").alias("version"))
    last.coalesce(1).write.mode("overwrite").parquet(local_uri(at + ".new"))
    shutil.rmtree(at + ".old", ignore_errors=True)
    os.replace(at, at + ".old")
    os.replace(at + ".new", at)
    shutil.rmtree(at + ".old")


def records(spark: SparkSession, home: str) -> DataFrame:
    """The records of a library with the proposals in force; groups without an entry keep what their records say."""
    return albums.overlay(read_records(spark, home), log(spark, home))
