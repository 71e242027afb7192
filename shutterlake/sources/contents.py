"""What files hold: hashes, side files, tags, records, vectors. Failures are per row."""

from __future__ import annotations

import hashlib
import json
import os
import shutil
import subprocess
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shutterlake.functions.geo import sidecar_geo
from shutterlake.operators import running
from shutterlake.operators.records import RECORD_DDL
from shutterlake.options import EMBEDDINGS, EMBEDDINGS_MATRIX, EMBEDDINGS_NAMES, META_DIR, RECORD_END
from shutterlake.progress import NO_COUNT, Counter
from shutterlake.sources.listing import list_files
from shutterlake.sources.matrix import read_matrix

TAG_BATCH = 512
# Options of the external tag tool. Without the first two, files of 4 GB and more have no tags.
EXIFTOOL_OPTIONS = ("-api", "largefilesupport=1")
_COORDINATES = "struct<latitude:double,longitude:double,altitude:double>"
SIDECAR_DDL = f"struct<photoTakenTime:struct<timestamp:string>,geoDataExif:{_COORDINATES},geoData:{_COORDINATES},__bad:string>"


#: Bytes of files that one task hashes or copies, while there are enough of them for all cores.
TASK_BYTES = 1 << 30


def dealt_by_bytes(files: DataFrame, key: str = "path") -> DataFrame:
    """files(size, ...) in as many tasks as there are cores, or more, of about equal bytes: at most the mean and one file more."""
    spark = files.sparkSession
    total = files.agg(F.sum("size")).first()[0] or 0
    return running.dealt_by_size(files, "size", [key], max(spark.sparkContext.defaultParallelism, -(-total // TASK_BYTES)))


def _hashes(count: Counter):
    def stage(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for path in f.path:
                try:
                    with open(path, "rb") as file:
                        out.append((path, hashlib.file_digest(file, "sha256").hexdigest(), "processed", None))
                except OSError as e:
                    out.append((path, None, "error", str(e)))
            count.add(len(out))
            yield pd.DataFrame(out, columns=["path", "hash", "status", "error"])

    return stage


def hash_files(files: DataFrame, count: Counter = NO_COUNT) -> DataFrame:
    """path, hash, status, error of each of files(path); bytes are read in pieces, by the tasks that files come in."""
    return files.select("path").mapInPandas(_hashes(count), "path string, hash string, status string, error string")


def _texts(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for f in frames:
        out = []
        for path in f.path:
            try:
                with open(path, encoding="utf-8") as file:
                    out.append((path, file.read(), None))
            except (OSError, UnicodeDecodeError) as e:
                out.append((path, None, str(e)))
        yield pd.DataFrame(out, columns=["path", "text", "error"])


def read_texts(files: DataFrame) -> DataFrame:
    return files.select("path").mapInPandas(_texts, "path string, text string, error string")


def read_sidecars(files: DataFrame) -> DataFrame:
    """path and side struct(timestamp, geo, error) of each side file of files(path)."""
    return parse_sidecars(read_texts(files))


def parse_sidecars(texts: DataFrame) -> DataFrame:
    """path and side of texts(path, text, error); a text that is no side file is an error of its row."""
    parsed = texts.withColumn("j", F.from_json("text", SIDECAR_DDL, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "__bad"}))
    error = F.coalesce("error", F.when(F.col("j.__bad").isNotNull() | F.col("j").isNull(), F.concat(F.lit("Not a side file: "), "path")))
    side = F.struct(F.col("j.photoTakenTime.timestamp").alias("timestamp"), sidecar_geo(F.col("j.geoDataExif"), F.col("j.geoData")).alias("geo"), error.alias("error"))
    return parsed.select("path", side.alias("side"))


def exiftool_reader(tags: list[str]) -> Callable[[list[str]], dict[str, dict]]:
    """Tags of a batch of files by the external exiftool; used only where that is installed."""

    def read(paths: list[str]) -> dict[str, dict]:
        run = subprocess.run(["exiftool", *EXIFTOOL_OPTIONS, "-json", "-n", "-G", "-fast", *(f"-{t}" for t in tags), "-@", "-"], input="\n".join(paths), capture_output=True, text=True, timeout=300)
        if run.returncode not in (0, 1):
            raise RuntimeError(run.stderr)
        return {os.path.normpath(row["SourceFile"]): row for row in json.loads(run.stdout or "[]")}

    return read


def read_tags(files: DataFrame, reader: Callable[[list[str]], dict[str, dict]], batch: int = TAG_BATCH, count: Counter = NO_COUNT) -> DataFrame:
    """path and tags map of files(path) by a pluggable reader, in batches; null for files that it doesn't report."""

    def stage(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for a in range(0, len(f), batch):
                paths = f.path.iloc[a : a + batch].tolist()
                found = reader(paths)
                rows = [found.get(os.path.normpath(p)) for p in paths]
                tags = [None if r is None else {k: str(v) for k, v in r.items() if v is not None} for r in rows]
                count.add(len(paths))
                yield pd.DataFrame({"path": paths, "tags": pd.Series(tags, dtype=object)})

    return files.select("path").mapInPandas(stage, "path string, tags map<string,string>")


def read_records(spark: SparkSession, library: str) -> DataFrame:
    """filename and fields of each record of a library; missing fields are null. One that can't be read fails the query."""
    folder = os.path.join(library, META_DIR)
    if not os.path.isdir(folder):
        raise RuntimeError(f"{library} has no records")
    return parse_records(read_texts(list_files(spark, folder, flat=True).where(F.col("path").endswith(RECORD_END))))


def parse_records(texts: DataFrame) -> DataFrame:
    """filename and fields of texts(path, text, error)."""
    error = lambda why: F.raise_error(F.concat(F.lit("the record "), F.col("path"), F.lit(" can't be read: "), why)).cast("string")
    text = F.when(F.col("error").isNotNull() | F.col("text").isNull(), error(F.coalesce("error", F.lit("no text")))).otherwise(F.col("text"))
    rows = texts.select("path", F.from_json(text, f"struct<{_fields()}>", {"mode": "FAILFAST"}).alias("r"))
    name = F.regexp_replace(F.regexp_extract("path", r"([^/]*)$", 1), RECORD_END.replace(".", r"\.") + "$", "")
    return rows.select(name.alias("filename"), "r.*")


def _fields() -> str:
    return ", ".join(f"{c.strip().split(' ', 1)[0]}:{c.strip().split(' ', 1)[1]}" for c in _split(RECORD_DDL))


def _split(ddl: str) -> list[str]:
    out, depth = [""], 0
    for c in ddl:
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            out.append("")
        else:
            out[-1] += c
    return out


def read_embeddings(spark: SparkSession, library: str, strict: bool = True) -> DataFrame | None:
    """The stored vectors of a library, (path, embedding); without any, an error or None.

    A library may have them as a numpy matrix beside a JSON list of names instead.
    """
    path, matrix, names = (os.path.join(library, META_DIR, n) for n in (EMBEDDINGS, EMBEDDINGS_MATRIX, EMBEDDINGS_NAMES))
    if os.path.exists(path):
        return spark.read.parquet(local_uri(path))
    have = [os.path.exists(p) for p in (matrix, names)]
    if all(have):
        return read_matrix(spark, matrix, names)
    if any(have):
        raise RuntimeError(f"{library} has only one of {EMBEDDINGS_MATRIX} and {EMBEDDINGS_NAMES}")
    if strict:
        raise RuntimeError(f"no embeddings in {library}")
    return None


def local_uri(path: str) -> str:
    """A library's path for Spark, whose own default may be another file system than the one that libraries are mounted in."""
    return "file://" + os.path.abspath(path)


def missing_tools(names: list[str]) -> list[str]:
    """Which of the external programs aren't installed."""
    return [n for n in names if shutil.which(n) is None]


def require_tools(names: list[str]) -> None:
    """Refuses to begin without the external programs that a command needs."""
    if absent := missing_tools(names):
        raise RuntimeError(f"not installed: {', '.join(absent)}")


# Fixed value: the first bytes of every JPEG.
JPEG = b"\xff\xd8\xff"


def capture_frames(path: str, times: list[float]) -> list[bytes]:
    """JPEG frames of a video at the given seconds, by the external ffmpeg.

    The place is sought after decoding has begun: slower, but right where a container's own index misleads.
    """
    out = []
    for t in times:
        run = subprocess.run(["ffmpeg", "-v", "error", "-i", path, "-ss", f"{t:.3f}", "-frames:v", "1", "-f", "image2pipe", "-c:v", "mjpeg", "-"], capture_output=True)
        if run.returncode or not run.stdout.startswith(JPEG):
            raise RuntimeError(run.stderr.decode(errors="replace") or f"{path} has no frame at {t:.3f}")
        out.append(run.stdout)
    return out


def video_frames(path: str, n: int) -> list[bytes]:
    """Frames at the middles of n equal parts of a video."""
    if n < 1:
        raise ValueError("at least one frame is needed")
    length = video_duration(path)
    if length <= 0:
        raise RuntimeError(f"{path} has no duration")
    return capture_frames(path, [length * (i + 0.5) / n for i in range(n)])


def video_duration(path: str) -> float:
    run = subprocess.run(["ffprobe", "-v", "error", "-show_entries", "format=duration", "-of", "csv=p=0", path], capture_output=True, text=True)
    if run.returncode:
        raise RuntimeError(run.stderr)
    try:
        return float(run.stdout)
    except ValueError:
        raise RuntimeError(f"{path} has no duration: {run.stdout!r}") from None
