"""Recursive file listing that hides nothing: names that begin with _ or . are files like others.

Folders are listed level by level: what a level's tasks find of folders is dealt anew for the next one, and a folder of
many entries is several tasks' work, so that no shape of a tree leaves it to one of them.
"""

from __future__ import annotations

import os
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shutterlake.functions.paths import basename
from shutterlake.session import ship_package
from shutterlake.sources.kept import kept, shared_folder

#: Entries of folders that one task lists at most; fewer while there are idle cores.
ENTRIES = 10_000
_FOUND = "path string, size long, modified timestamp, entries long"


def _entries(folder: str) -> int:
    """How many entries a folder has; none if it can't be read."""
    try:
        with os.scandir(folder) as found:
            return sum(1 for _ in found)
    except OSError:
        return 0


def _list(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Files and folders of a folder's slice: each name is in one slice. Folders come with the number of their entries."""
    for batch in batches:
        for folder, nth, slices, deep in zip(*(batch.column(c).to_pylist() for c in ("path", "nth", "slices", "deep")), strict=True):
            rows = []
            try:
                with os.scandir(folder) as found:
                    mine = [e for e in found if slices == 1 or zlib.crc32(os.fsencode(e.name)) % slices == nth]
            except OSError:
                mine = []
            for e in mine:
                if not e.is_dir():
                    try:
                        info = os.stat(e.path)
                        rows.append((e.path, info.st_size, info.st_mtime_ns // 1000, None))
                    except OSError:  # a link to nowhere
                        rows.append((e.path, None, None, None))
                elif deep and not e.is_symlink():
                    rows.append((e.path, None, None, _entries(e.path)))
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 4
            kinds = (pa.string(), pa.int64(), pa.timestamp("us", "UTC"), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(columns, kinds, strict=True)], names=["path", "size", "modified", "entries"])


def list_files(spark: SparkSession, root: str, flat: bool = False) -> DataFrame:
    """path, size and modified of every file below `root`; if flat, of those in it. The listing is made once and kept.

    A link to a folder isn't followed, one to nowhere has neither size nor time; a folder that can't be read is empty.
    """
    if not os.path.isdir(root):
        raise NotADirectoryError(root)
    ship_package(spark)
    cores = spark.sparkContext.defaultParallelism
    folders = spark.createDataFrame([(root, _entries(root))], "path string, entries long")
    at = f"{shared_folder(spark)}/shutterlake-listing-{uuid.uuid4().hex}"
    level = 0
    while True:
        total = folders.agg(F.sum("entries")).first()[0]
        if not total:
            break
        share = max(1, min(ENTRIES, -(-total // cores)))
        slices = F.greatest(F.lit(1), F.ceil(F.col("entries") / share)).cast("int")
        tasks = folders.select("path", slices.alias("slices")).select("path", "slices", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("nth"), F.lit(not flat).alias("deep"))
        found = kept(tasks.repartition(max(1, -(-total // share))).mapInArrow(_list, _FOUND), "listing", f"{at}/level={level}")
        if flat:
            break
        folders, level = found.where("entries IS NOT NULL").select("path", "entries"), level + 1
    if not level and not total:
        return spark.createDataFrame([], "path string, size long, modified timestamp")
    out = spark.read.schema(_FOUND).option("basePath", at).parquet(at).where("entries IS NULL").select("path", "size", "modified")
    out._kept_path = at
    return out


def list_library(spark: SparkSession, root: str) -> DataFrame:
    """filename of each file directly in a library."""
    return list_files(spark, root, flat=True).select(basename(F.col("path")).alias("filename"))


def library_home(path: str, meta_dir: str) -> str:
    """The library that a path lies in: the nearest folder upwards that has a record folder."""
    at = os.path.abspath(path)
    while True:
        if os.path.isdir(os.path.join(at, meta_dir)):
            return at
        up = os.path.dirname(at)
        if up == at:
            raise RuntimeError(f"{path} is in no library")
        at = up


def input_paths(arguments: list[str], stdin=None) -> list[str]:
    """Paths given as arguments, else as non-empty lines of a stream that isn't a terminal."""
    if arguments:
        return arguments
    if stdin is None or stdin.isatty():
        return []
    return [line.strip() for line in stdin if line.strip()]
