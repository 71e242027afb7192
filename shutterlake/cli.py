"""python -m shutterlake.cli COMMAND ..."""

from __future__ import annotations

import argparse
import importlib
import json
import sys
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from shutterlake.functions.handlers import required_tags
from shutterlake.operators import report
from shutterlake.options import META_DIR, CaptionOptions, EnrichOptions, ExportOptions, IngestOptions
from shutterlake.plans import commands
from shutterlake.progress import job_progress
from shutterlake.session import local_session
from shutterlake.sources import captioner, contents, listing, models


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="shutterlake")
    sub = p.add_subparsers(dest="command", required=True)
    a = sub.add_parser("import")
    a.add_argument("source")
    a.add_argument("destination", nargs="?")
    a.add_argument("--to", dest="to", help="the destination, as an option")
    mode = a.add_mutually_exclusive_group()
    mode.add_argument("--takeout", "--from-takeout", dest="mode", action="store_const", const="takeout")
    mode.add_argument("--archive", "--from-archive", dest="mode", action="store_const", const="archive")
    for flag in ("--dry-run", "--skip-dedupe", "--skip-metadata-write"):
        a.add_argument(flag, action="store_true")
    a.add_argument("--no-fuzzy", dest="fuzzy", action="store_false")
    a.add_argument("--fuzzy-threshold", type=int, default=40)
    a.add_argument("--prefer", choices=("album", "loose"), default="album")
    a = sub.add_parser("enrich")
    a.add_argument("library")
    a.add_argument("--places", required=True, help="Parquet or CSV with place_id, lat, lon, name, admin1, cc")
    a.add_argument("--embedder", required=True, help="module:function from a list of encoded pictures to a list of unit vectors or exceptions")
    a.add_argument("--factory", action="store_true", help="the function named makes the embedder, once in each worker")
    a.add_argument("--video-frames", type=int, default=EnrichOptions.video_frames)
    a.add_argument("--dry-run", action="store_true")
    a = sub.add_parser("caption")
    a.add_argument("path")
    a.add_argument("--force", action="store_true")
    a.add_argument("--model", default=CaptionOptions.model)
    a.add_argument("--video-frames", type=int, default=CaptionOptions.video_frames)
    a.add_argument("--server", default=CaptionOptions.server)
    a = sub.add_parser("check")
    a.add_argument("library")
    a = sub.add_parser("propose")
    a.add_argument("path")
    what = a.add_mutually_exclusive_group(required=True)
    what.add_argument("album", nargs="?")
    what.add_argument("--clear", action="store_true")
    a = sub.add_parser("export")
    a.add_argument("library")
    a.add_argument("destination", nargs="?")
    a.add_argument("--to", dest="to", help="the destination, as an option")
    a.add_argument("--force", action="store_true")
    a.add_argument("--dry-run", action="store_true")
    a = sub.add_parser("similar")
    a.add_argument("path")
    a.add_argument("--library")
    a.add_argument("-k", "--k", type=int, default=20)
    a = sub.add_parser("cluster")
    a.add_argument("paths", nargs="*")
    a.add_argument("--library")
    a.add_argument("--min-cluster-size", type=int, default=5)
    return p


def read_places(spark: SparkSession, path: str) -> DataFrame:
    """The list of places as a file or folder, CSV with a header if it is named so, else Parquet."""
    ddl = "place_id long, lat double, lon double, name string, admin1 string, cc string"
    if path.endswith(".csv"):
        return spark.read.schema(ddl).option("header", True).option("enforceSchema", False).csv(path)
    return spark.read.parquet(path)


def plugged(name: str) -> Callable:
    """The function that module:function names."""
    module, _, function = name.partition(":")
    return getattr(importlib.import_module(module), function)


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    o = parser().parse_args(argv)
    home = lambda path: listing.library_home(path, META_DIR)
    name = lambda path: path.rsplit("/", 1)[-1]
    show = lambda df: print(json.dumps(df.first().asDict()))
    spark = spark or local_session()
    try:
        if o.command == "import":
            if o.mode is None:
                hint = commands.takeout_hint(spark, o.source)
                raise RuntimeError("say --takeout or --archive" + (f": {hint}" if hint else ""))
            contents.require_tools(["exiftool"])
            options = IngestOptions(o.source, o.destination or o.to, o.mode, o.dry_run, o.skip_dedupe, o.skip_metadata_write, o.fuzzy, o.fuzzy_threshold, o.prefer)
            progress = job_progress(spark, sys.stderr)
            planned = commands.ingest_plan(spark, options, contents.exiftool_reader(required_tags()), progress)
            done = commands.apply_import(planned, options, progress=progress)
            for summary in (*planned.link_counts(), report.dedupe_summary(done), report.reconcile_summary(done)):
                show(summary)
            if not o.dry_run:
                show(report.apply_summary(done))
            for r in report.errors(done).orderBy("media_path", "stage").toLocalIterator():
                print(r.media_path, r.stage, r.reason, sep="\t")
        elif o.command == "enrich":
            options = EnrichOptions(video_frames=o.video_frames, dry_run=o.dry_run)
            _, pairs = commands.paired_records(spark, o.library)
            done = commands.enrich(spark, o.library, read_places(spark, o.places), models.PerWorker(plugged(o.embedder)) if o.factory else plugged(o.embedder), options, job_progress(spark, sys.stderr))
            show(report.enrich_summary(done))
            show(report.gaps_summary(pairs))
            for r in report.first_failures(done).collect():
                print(r.filename, r.error, sep="\t")
        elif o.command == "caption":
            options = CaptionOptions(model=o.model, video_frames=o.video_frames, server=o.server)
            at = home(o.path)
            told = commands.caption_file(spark, at, name(o.path), _checked(captioner.describer(at, options), options), o.force)
            if told is None:
                return 1
            print(told)
        elif o.command == "check":
            found = commands.check(spark, o.library)
            print(json.dumps(found, indent=2))
            return 0 if found["ok"] else 1
        elif o.command == "propose":
            changed = commands.propose(spark, home(o.path), name(o.path), None if o.clear else o.album)
            print(f"{'cleared' if o.clear else o.album}: {len(changed)} files")
            print("\n".join(changed))
        elif o.command == "export":
            destination = o.destination or o.to
            if not destination:
                raise RuntimeError("say where to export to")
            done = commands.export(spark, o.library, destination, ExportOptions(o.force, o.dry_run))
            if o.dry_run:
                for r in done.orderBy("target").toLocalIterator():
                    print(r.filename, r.target, sep="\t")
            show(report.export_summary(done))
        elif o.command == "similar":
            print(json.dumps(commands.similar(spark, o.library or home(o.path), o.path, o.k), indent=2))
        else:
            paths = listing.input_paths([p for p in o.paths if p != "-"], sys.stdin)
            found = commands.cluster(spark, o.library or home(paths[0]), paths, o.min_cluster_size) if paths else {}
            print(json.dumps(found, indent=2))
    except (RuntimeError, ValueError, OSError) as e:
        print(f"shutterlake: {e}", file=sys.stderr)
        return 1
    return 0


def _checked(describe: Callable[[str], str | None], options: CaptionOptions) -> Callable[[str], str | None]:
    """The same, but for the model being looked for before it is asked."""

    def ask(filename: str) -> str | None:
        captioner.require_model(options)
        return describe(filename)

    return ask


if __name__ == "__main__":
    sys.exit(main())
