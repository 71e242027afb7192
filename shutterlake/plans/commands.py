"""The commands: import, enrich, caption, similar, cluster, propose, check, export."""

from __future__ import annotations

import os
import sys
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.resource import ResourceProfile
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shutterlake.functions import handlers
from shutterlake.functions.dates import first_date
from shutterlake.functions.paths import extension
from shutterlake.operators import albums, dedupe, geocode, group, library, link, records, report, scan, similarity
from shutterlake.operators import export as exporting
from shutterlake.operators import reconcile as reconciling
from shutterlake.options import EMBEDDINGS, META_DIR, EnrichOptions, ExportOptions, IngestOptions
from shutterlake.progress import NO_COUNT, Counter, Progress, no_progress, ticking
from shutterlake.sources import contents, listing, models, proposals, sinks
from shutterlake.sources.kept import dropped, kept

Reader = Callable[[list[str]], dict[str, dict]]


@dataclass(frozen=True)
class Import:
    """An import up to its records, nothing written to the library. Its tables are kept: each file was hashed and its tags were read once."""

    files: DataFrame
    linked: DataFrame
    manifest: DataFrame

    def link_counts(self) -> tuple[DataFrame, DataFrame]:
        """Links per confidence, and the media and side files that no link has; of an archive all media have none."""
        media, side = (self.files.where(F.col("bucket") == b).select("path") for b in ("media", "sidecar"))
        return report.link_summary(self.linked), report.side_summary(link.unmatched(media, side, self.linked))


def ingest_plan(spark: SparkSession, options: IngestOptions, reader: Reader, progress: Progress = no_progress) -> Import:
    """Lists, links, hashes, resolves copies, reads tags and side files, and decides what each record says."""
    files = scan.classify(listing.list_files(spark, options.source))
    cores = spark.sparkContext.defaultParallelism
    media, side = files.where("bucket = 'media'").select("path", "size"), files.where("bucket = 'sidecar'").select("path")
    if options.mode == "takeout":
        linked = link.link(media, side, options.fuzzy, options.fuzzy_threshold)
        rows = link.label_takeout(linked, files.where("bucket = 'album_marker'").select("path"))
        rows = group.group_takeout(rows)
    else:
        rows = link.label_archive(media, os.path.normpath(options.source)).withColumn("sidecar", F.lit(None).cast("string")).withColumn("confidence", F.lit(None).cast("int"))
        rows = group.group_archive(rows)
    rows = linked = kept(rows, "linked")
    if options.skip_dedupe:
        rows = rows.withColumn("hash", F.lit(None).cast("string")).withColumn("status", F.lit("processed")).withColumn("error", F.lit(None).cast("string")).withColumn("result", F.lit("keep"))
    else:
        dealt = contents.dealt_by_bytes(media)
        with progress("Hashing", media.count()) as tick, ticking(spark, tick) as count:
            hashed = kept(contents.hash_files(dealt, count), "hashed")
        dropped(dealt)
        rows = dedupe.assured(dedupe.resolve(rows.join(hashed, "path"), options.prefer))
    rows = kept(rows.withColumn("keep", dedupe.can_keep()), "resolved")
    # Only what is kept is read by the tag tool; the filter stands before its Python stage.
    asked = rows.where("keep").select("path")
    n = asked.count()
    with progress("Tags", n) as tick, ticking(spark, tick) as count:
        tags = contents.read_tags(asked.repartition(max(1, min(n, cores), -(-n // (8 * contents.TAG_BATCH)))), reader, count=count)
        sides = rows.where("keep AND sidecar IS NOT NULL").select(F.col("sidecar").alias("path")).distinct()
        sides = contents.read_sidecars(sides.repartition(cores))
        rows = rows.join(tags, "path", "left").join(sides.withColumnRenamed("path", "sidecar"), "sidecar", "left")
        rows = reconciling.reconcile(rows, options.skip_metadata_write).withColumn("metadata", F.when(F.col("keep"), F.col("metadata")))
        manifest = kept(
            rows.select(
                F.col("path").alias("media_path"), "source", F.when(F.col("sidecar").isNotNull(), F.struct(F.col("sidecar").alias("path"), F.col("confidence"))).alias("sidecar"),
                F.struct("status", "result", "hash", "error").alias("dedupe"), "metadata", "group_id", "keep", "size",
            ),
            "manifest",
        )
    return Import(files, linked, records.with_json(manifest))


def takeout_hint(spark: SparkSession, source: str) -> str:
    """What to say to somebody who didn't say what the source is."""
    takeout = scan.looks_like_takeout(scan.classify(listing.list_files(spark, source)))
    return "the source has side files; is it a takeout?" if takeout else ""


def ingest(spark: SparkSession, options: IngestOptions, reader: Reader, writer=sinks.exiftool_writer, progress: Progress = no_progress) -> DataFrame:
    """Runs an import and returns its manifest with `apply`; a dry run stops before anything is written."""
    return apply_import(ingest_plan(spark, options, reader, progress), options, writer, progress)


def apply_import(planned: Import, options: IngestOptions, writer=sinks.exiftool_writer, progress: Progress = no_progress) -> DataFrame:
    """Writes a planned import, all of it or nothing, and its report; returns the manifest with `apply`."""
    manifest = planned.manifest
    if options.dry_run:
        return manifest.withColumn("apply", F.lit(None).cast(sinks.APPLY))
    with progress("Copying", manifest.where("keep").count()) as tick, ticking(manifest.sparkSession, tick) as count:
        done = sinks.emit(manifest, options.destination, writer, count)
    out = manifest.join(done, "media_path", "left")
    with progress("Report", 0):
        sinks.write_report(report.report(out, options.source), options.destination)
    return out


def paired_records(spark: SparkSession, home: str, proposed: bool = True) -> tuple[DataFrame, DataFrame]:
    """The records of a library that have media, and the pairing of all names; unless asked, without the log of proposals."""
    recs = proposals.records(spark, home) if proposed else contents.read_records(spark, home)
    pairs = library.pair(listing.list_library(spark, home), recs.select("filename"))
    return library.records_by_pairing(recs, pairs).where("pairing = 'paired'").drop("pairing"), pairs


def check(spark: SparkSession, home: str) -> dict:
    """Conflicts and invalid names among all records, those without media included."""
    return albums.check(proposals.records(spark, home))


def propose(spark: SparkSession, home: str, filename: str, album: str | None) -> list[str]:
    """Sets or clears the proposal of a record's whole group by an entry of the log; returns the names of the records."""
    recs = contents.read_records(spark, home)
    mine = recs.where(F.col("filename") == filename).select("group_id").first()
    if mine is None:
        raise RuntimeError(f"no record of {filename}")
    proposals.append(spark, home, mine.group_id, album)
    return [r.filename for r in recs.where(F.col("group_id") == mine.group_id).select("filename").orderBy("filename").collect()]


def export(spark: SparkSession, home: str, destination: str, options: ExportOptions = ExportOptions()) -> DataFrame:
    """Validates, plans, then copies; a failure before the copies leaves the destination as it was. Returns the operations."""
    recs, _ = paired_records(spark, home)
    albums.require_groups(recs)
    exporting.validate(recs)
    planned = exporting.plan(recs.withColumn("first_date", first_date(F.col("dates"))))
    planned.write.format("noop").mode("overwrite").save()  # a bad date fails here
    return sinks.export(planned, home, destination, options.force, options.dry_run)


Embedder = Callable[[list[bytes]], list[list[float] | Exception]]


def embed(spark: SparkSession, home: str, files: DataFrame, embed_images: Embedder, options: EnrichOptions = EnrichOptions(), count: Counter = NO_COUNT, profile: ResourceProfile | None = None) -> DataFrame:
    """filename, kind, status, embedding, error of files(filename): images in batches, videos as the mean of their frames.

    The model is a function from encoded pictures to unit vectors, an exception in place of those it can't decode;
    models.PerWorker() makes one in each worker. A batch that it fails on is asked again picture by picture. `profile`
    says what the stage's executors need, such as a GPU.
    """
    n, batch = options.video_frames, options.image_batch

    def unit(rows: list[list[float]]) -> list[float]:
        mean = [sum(c) / len(rows) for c in zip(*rows, strict=True)]
        size = sum(x * x for x in mean) ** 0.5 or 1.0
        return [x / size for x in mean]

    def stage(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            images = [x for x in f.filename if os.path.splitext(x)[1].lower() in handlers.IMAGES]
            for a in range(0, len(images), batch):
                names, data, bad = [], [], []
                for name in images[a : a + batch]:
                    try:
                        with open(os.path.join(home, name), "rb") as file:
                            data.append(file.read())
                        names.append(name)
                    except OSError as e:
                        bad.append((name, "image", "error", None, str(e)))
                found = models.each_alone(embed_images, data)
                out += bad + [(x, "image", "error", None, str(v)) if isinstance(v, Exception) else (x, "image", "processed", list(v), None) for x, v in zip(names, found, strict=True)]
            for name in f.filename:
                if os.path.splitext(name)[1].lower() in handlers.VIDEOS:
                    try:
                        path = os.path.join(home, name)
                        found = embed_images(contents.video_frames(path, n))
                        if any(isinstance(v, Exception) for v in found):
                            raise next(v for v in found if isinstance(v, Exception))
                        out.append((name, "video", "processed", unit([list(v) for v in found]), None))
                    except Exception as e:
                        out.append((name, "video", "error", None, str(e)))
            count.add(len(out))
            yield pd.DataFrame(out, columns=["filename", "kind", "status", "embedding", "error"])

    return files.select("filename").mapInPandas(stage, "filename string, kind string, status string, embedding array<float>, error string", profile=profile)


def enrich(spark: SparkSession, home: str, places: DataFrame, embed_images: Embedder, options: EnrichOptions = EnrichOptions(), progress: Progress = no_progress, profile: ResourceProfile | None = None) -> DataFrame:
    """Gives the paired records their places and the library its vectors; everything is computed anew.

    A dry run computes the same and writes nothing.
    """
    recs, _ = paired_records(spark, home, proposed=False)
    if not recs.where(handlers.is_video(extension(F.col("filename")))).limit(1).isEmpty():
        contents.require_tools(["ffmpeg", "ffprobe"])
    points = recs.select(F.col("filename").alias("key"), F.col("geo.latitude").alias("lat"), F.col("geo.longitude").alias("lon"))
    found = geocode.nearest(points, places).select(F.col("key").alias("filename"), F.col("location").alias("place"))
    located = recs.join(found, "filename", "left").withColumn("location", F.coalesce("place", "location")).drop("place")
    if not options.dry_run:
        with progress("Places", 0):
            sinks.write_records(located.where("location IS NOT NULL").select("filename", records.to_json().alias("json")), home)
    n = recs.count()
    # Some batches for each core; what the model gave is kept, so that no picture is asked for twice.
    files = recs.select("filename").repartition(max(1, min(-(-n // options.image_batch), 4 * spark.sparkContext.defaultParallelism)))
    with progress("Vectors", n) as tick, ticking(spark, tick) as count:
        vectors = kept(embed(spark, home, files, embed_images, options, count, profile), "embedded")
        if not options.dry_run:
            good = vectors.where("status = 'processed' AND embedding IS NOT NULL")
            sinks.write_embeddings(good.select(F.col("filename").alias("path"), "embedding"), os.path.join(home, META_DIR, EMBEDDINGS))
    return located.select("filename", "location").join(vectors.select("filename", "kind", F.col("status").alias("embed_status"), "error"), "filename", "left")


def caption(recs: DataFrame, describe: Callable[[str], str | None], force: bool = False) -> DataFrame:
    """recs(filename, caption, ...) with captions: those there are kept, `describe` is asked for the others alone.

    A failed description leaves its record as it was.
    """
    have = F.coalesce("caption", F.lit("")) != ""
    ask = recs if force else recs.where(~have)

    def stage(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for name in f.filename:
                try:
                    out.append(describe(name))
                except Exception:
                    out.append(None)
            yield pd.DataFrame({"filename": f.filename, "told": out})

    told = ask.select("filename").mapInPandas(stage, "filename string, told string")
    return recs.join(told, "filename", "left").withColumn("caption", F.coalesce("told", "caption")).drop("told")


def caption_file(spark: SparkSession, home: str, filename: str, describe: Callable[[str], str | None], force: bool = False) -> str | None:
    """The caption of one file, the one it has or a new one, which its record then keeps; None if none could be made."""
    recs = contents.read_records(spark, home).where(F.col("filename") == filename)
    before = recs.select("caption").first()
    if before is None:
        raise RuntimeError(f"no record of {filename}")
    if before.caption and not force:
        return before.caption
    try:
        told = describe(filename)
    except Exception as e:
        print(f"no caption of {filename}: {e}", file=sys.stderr)
        return None
    if not told:
        print(f"no caption of {filename}: the model gave none", file=sys.stderr)
        return None
    sinks.write_records(recs.withColumn("caption", F.lit(told)).select("filename", records.to_json().alias("json")), home)
    return told


def similar(spark: SparkSession, home: str, filename: str, k: int = 20) -> list[dict]:
    vectors = contents.read_embeddings(spark, home)
    return [r.asDict() for r in similarity.similar(vectors, os.path.basename(filename), k).collect()]


def cluster(spark: SparkSession, home: str, paths: list[str], min_cluster_size: int = 5) -> dict[str, list[str]]:
    """Paths per label, in the order and as often as they were given; those without a vector are told and left out."""
    if min_cluster_size < 2:
        raise ValueError("a cluster has at least 2 members")
    if not paths:
        return {}
    vectors = contents.read_embeddings(spark, home)
    names = [os.path.basename(p) for p in paths]
    asked = spark.createDataFrame([(n,) for n in sorted(set(names))], "path string")
    have = similarity.lookup(vectors, asked).where("embedding IS NOT NULL").persist()
    known = {r.path for r in have.select("path").collect()}
    for p, n in zip(paths, names, strict=True):
        if n not in known:
            print(f"cluster: {p} has no vector", file=sys.stderr)
    if not known:
        return {}
    labels = {r.path: r.label for r in similarity.cluster(have, min_cluster_size=min_cluster_size).collect()}
    have.unpersist()
    out: dict[str, list[str]] = {}
    for p, n in zip(paths, names, strict=True):
        if n in labels:
            out.setdefault(str(labels[n]), []).append(p)
    return out


def cluster_slice(spark: SparkSession, home: str, which: Callable[[DataFrame], DataFrame], min_cluster_size: int = 5) -> DataFrame:
    """(path, label) of the records that `which` selects, such as those of a region or of a time, and that have vectors."""
    names = which(contents.read_records(spark, home)).select(F.col("filename").alias("path"))
    return similarity.cluster(contents.read_embeddings(spark, home), names, min_cluster_size)
