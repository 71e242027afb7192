"""What commands write: copies with their records, the report, vectors, the export tree."""

from __future__ import annotations

import contextlib
import os
import shutil
import subprocess
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shutterlake.functions.paths import basename, extension
from shutterlake.operators.group import file_id
from shutterlake.options import META_DIR, RECORD_END, REPORT_NAME
from shutterlake.progress import NO_COUNT, Counter
from shutterlake.sources.contents import EXIFTOOL_OPTIONS, dealt_by_bytes, local_uri
from shutterlake.sources.kept import dropped, kept
from shutterlake.sources.listing import list_files

APPLY = "struct<status:string,result:string,target_path:string,error:string>"


def exiftool_writer(path: str, tags: list[str]) -> None:
    """Writes tags into a file by the external exiftool."""
    run = subprocess.run(["exiftool", *EXIFTOOL_OPTIONS, "-overwrite_original", *(f"-{t}" for t in tags), path], capture_output=True, text=True, timeout=60)
    if run.returncode:
        raise RuntimeError(run.stderr)


#: Folder of an import that isn't finished, within the folder of records, and the mark of one that has made all its copies.
STAGING, MADE = ".import", "made"
#: Beginning of the names of copies that a task is at.
_OPEN = "open-"


def _stage(staging: str, writer: Callable[[str, list[str]], None], count: Counter):
    """Copies files and writes records into the staging folder; each appears there under its name once it is whole."""

    def stage(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        attempt = f"{_OPEN}{TaskContext.get().taskAttemptId()}-"
        for f in frames:
            out = []
            for r in f.itertuples(index=False):
                copy, record = (os.path.join(staging, attempt + n) for n in (r.name, r.name + RECORD_END))
                try:
                    shutil.copy2(r.media_path, copy)
                    if len(r.write_tags):
                        writer(copy, list(r.write_tags))
                    with open(record, "w", encoding="utf-8") as text:
                        text.write(r.record_json)
                    os.replace(record, os.path.join(staging, r.name + RECORD_END))
                    os.replace(copy, os.path.join(staging, r.name))
                    out.append((r.media_path, {"status": "processed", "result": "written" if len(r.write_tags) else "copied", "target_path": os.path.join(os.path.dirname(os.path.dirname(staging)), r.name), "error": None}))
                except Exception as e:
                    for path in (copy, record, os.path.join(staging, r.name + RECORD_END)):
                        with contextlib.suppress(OSError):
                            os.remove(path)
                    out.append((r.media_path, {"status": "error", "result": None, "target_path": None, "error": str(e)}))
            count.add(len(out))
            yield pd.DataFrame(out, columns=["media_path", "apply"])

    return stage


def _publish(destination: str):
    """Moves staged files to where they belong; one that was moved already is left there."""

    def move(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for path in f.path:
                name = os.path.basename(path)
                if name == MADE or name.startswith(_OPEN):
                    continue
                folder = os.path.join(destination, META_DIR) if name.endswith(RECORD_END) else destination
                try:
                    os.replace(path, os.path.join(folder, name))
                except FileNotFoundError:
                    if not os.path.exists(os.path.join(folder, name)):
                        raise
            yield f[["path"]]

    return move


def publish(spark: SparkSession, destination: str) -> None:
    """Ends an import that has made all its copies: they move into the library. It may be run again after a failure."""
    staging = os.path.join(destination, META_DIR, STAGING)
    staged = list_files(spark, staging, flat=True)
    staged.select("path").repartition(spark.sparkContext.defaultParallelism).mapInPandas(_publish(destination), "path string").count()
    dropped(staged)
    shutil.rmtree(staging, ignore_errors=True)


def recover(spark: SparkSession, destination: str) -> None:
    """What an import left that ended before its end: whole, it is published, else taken back."""
    staging = os.path.join(destination, META_DIR, STAGING)
    if os.path.exists(os.path.join(staging, MADE)):
        publish(spark, destination)
    elif os.path.isdir(staging):
        shutil.rmtree(staging)


def emit(manifest: DataFrame, destination: str, writer: Callable[[str, list[str]], None] = exiftool_writer, count: Counter = NO_COUNT) -> DataFrame:
    """Copies manifest(media_path, metadata, record_json, keep, size) to a library; (media_path, apply) tells what became of each.

    Only rows to keep with a handler are copied, those whose metadata failed included. Names are hashes of the source
    path with a small-letter extension, so a task that runs again writes the same files. Files must be reachable from
    the executors.

    An import is a transaction: copies and records are staged within the library, then a mark says that all are made,
    then they move into it. Whatever fails before the mark takes everything back; what fails after it is ended by the
    next import. One import at a time may write to a library.
    """
    spark = manifest.sparkSession
    recover(spark, destination)
    staging = os.path.join(destination, META_DIR, STAGING)
    os.makedirs(staging)
    name = F.concat(file_id(F.col("media_path")), F.lower(extension(basename(F.col("media_path")))))
    rows = manifest.where(F.col("keep") & (F.col("metadata.status") != "skipped"))
    rows = dealt_by_bytes(rows.select("media_path", "size", name.alias("name"), F.col("metadata.write_tags").alias("write_tags"), "record_json"), "media_path")
    try:
        # What became of each file is kept: the rows of the attempts that Spark counts, each file's once.
        done = kept(rows.drop("size").mapInPandas(_stage(staging, writer, count), f"media_path string, apply {APPLY}"), "outcomes")
        with open(os.path.join(staging, _OPEN + MADE), "wb") as mark:
            os.fsync(mark.fileno())
        os.replace(os.path.join(staging, _OPEN + MADE), os.path.join(staging, MADE))
    except BaseException:
        shutil.rmtree(staging, ignore_errors=True)
        raise
    finally:
        dropped(rows)
    publish(spark, destination)
    return done


def write_report(report: DataFrame, destination: str) -> str:
    """The report, in the order of its media, as one CSV file with a header.

    Tasks write sorted parts, which are then put together piece by piece.
    """
    folder = os.path.join(destination, META_DIR, REPORT_NAME + ".parts")
    report.orderBy("media").write.mode("overwrite").option("quote", '"').option("escape", '"').option("emptyValue", "").csv(local_uri(folder))
    target = os.path.join(destination, META_DIR, REPORT_NAME)
    with open(target + ".part", "wb") as whole:
        whole.write((",".join(report.columns) + "\n").encode())
        for name in sorted(n for n in os.listdir(folder) if n.startswith("part-")):
            with open(os.path.join(folder, name), "rb") as part:
                shutil.copyfileobj(part, whole)
    os.replace(target + ".part", target)
    shutil.rmtree(folder)
    return target


def write_embeddings(vectors: DataFrame, path: str) -> bool:
    """Replaces the stored vectors, unless there are none."""
    if vectors.isEmpty():
        return False
    vectors.write.mode("overwrite").parquet(local_uri(path))
    return True


def write_records(records: DataFrame, library: str) -> None:
    """Rewrites the record files of records(filename, json)."""

    def stage(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for r in f.itertuples(index=False):
                path = os.path.join(library, META_DIR, r.filename + RECORD_END)
                with open(path + ".part", "w", encoding="utf-8") as file:
                    file.write(r.json)
                os.replace(path + ".part", path)
            yield f[["filename"]]

    records.select("filename", "json").mapInPandas(stage, "filename string").count()


def export(planned: DataFrame, library: str, destination: str, force: bool, dry_run: bool) -> DataFrame:
    """Copies planned(filename, target) into the destination and returns the operations; a dry run writes nothing."""
    if os.path.isdir(destination) and os.listdir(destination):
        if not force:
            raise RuntimeError(f"{destination} is not empty")
        if not dry_run:
            shutil.rmtree(destination)
    if dry_run:
        return planned.select("filename", "target")

    def stage(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for r in f.itertuples(index=False):
                target = os.path.join(destination, r.target)
                os.makedirs(os.path.dirname(target), exist_ok=True)
                shutil.copy2(os.path.join(library, r.filename), target)
            yield f[["filename"]]

    planned.select("filename", "target").mapInPandas(stage, "filename string").count()
    return planned.select("filename", "target")
