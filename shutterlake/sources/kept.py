"""Tables that a command computes once and reads again: written to the folder that driver and executors share."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; a temporary one for a session on one machine, where it isn't set."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="shutterlake-shared-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


#: Whether the files of a query's shuffles go as soon as it has ended, rather than with the driver's garbage.
_FREED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def kept(df: DataFrame, name: str, path: str | None = None, free: bool = False) -> DataFrame:
    """The frame, computed once: written as a table and read again, so that a lost executor costs no second computation.

    With `free`, what was shuffled for it leaves the disk once it is written.
    """
    spark = df.sparkSession
    path = path or f"{shared_folder(spark)}/shutterlake-{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(_FREED, None)
    if free:
        spark.conf.set(_FREED, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        if free and before is None:
            spark.conf.unset(_FREED)
        elif free:
            spark.conf.set(_FREED, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._kept_path = path
    return out


def dropped(df: DataFrame) -> None:
    """Deletes the table behind a kept() frame; only once nothing can read it any more."""
    if path := getattr(df, "_kept_path", None):
        spark = df.sparkSession
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
