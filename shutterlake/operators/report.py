"""What became of each file, and summaries of the stages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shutterlake.functions.paths import relative_to


def _outcome(status: str, reason) -> F.Column:
    return F.struct(F.lit(status).alias("status"), F.coalesce(reason, F.lit("")).alias("reason"))


def status() -> F.Column:
    """struct(status, reason) from the stages' structs; the last stage that ended a file's way decides."""
    a, m, d, none = F.col("apply"), F.col("metadata"), F.col("dedupe"), F.lit("")
    return (
        F.when(a["result"] == "written", _outcome("written", none))
        .when(a["result"] == "copied", _outcome("copied", none))
        .when(a["status"] == "error", _outcome("error", a["error"]))
        .when(m["status"] == "skipped", _outcome("skipped", m["error"]))
        .when(d["result"] == "delete", _outcome("deleted", none))
        .when(d["status"] == "error", _outcome("error", d["error"]))
        .otherwise(_outcome("error", F.lit("Unknown state")))
    )


def report(manifest: DataFrame, source: str) -> DataFrame:
    """media, metadata, confidence, status, reason of each manifest row, paths below the source."""
    rows = manifest.withColumn("s", status())
    return rows.select(relative_to(F.col("media_path"), source).alias("media"), F.coalesce(relative_to(F.col("sidecar.path"), source), F.lit("")).alias("metadata"), F.coalesce(F.col("sidecar.confidence").cast("string"), F.lit("")).alias("confidence"), "s.status", "s.reason")


def link_summary(linked: DataFrame) -> DataFrame:
    """Files per confidence and without a side file, over link()'s rows."""
    return linked.agg(*[F.count_if(F.col("confidence") == c).alias(f"confidence_{c}") for c in (3, 2, 1)], F.count_if(F.col("confidence").isNull()).alias("unmatched"))


def dedupe_summary(manifest: DataFrame) -> DataFrame:
    d = F.col("dedupe")
    return manifest.agg(F.count_if(d["result"] == "keep").alias("keep"), F.count_if(d["result"] == "delete").alias("deleted"), F.count_if(d["status"] == "error").alias("failed"))


def reconcile_summary(manifest: DataFrame) -> DataFrame:
    """Among the files that are kept: to update, nothing to do, unsupported, failed."""
    d, m = F.col("dedupe"), F.col("metadata")
    kept = F.coalesce(d["result"] != "delete", F.lit(True)) & F.coalesce(d["status"] != "error", F.lit(True))
    done, n = m["status"] == "processed", F.coalesce(F.size(m["write_tags"]), F.lit(0))
    return manifest.where(kept).agg(F.count_if(done & (n > 0)).alias("to_update"), F.count_if(done & (n <= 0)).alias("noop"), F.count_if(m["status"] == "skipped").alias("unsupported"), F.count_if(m["status"] == "error").alias("failed"))


def apply_summary(manifest: DataFrame) -> DataFrame:
    a, d = F.col("apply"), F.col("dedupe")
    return manifest.agg(F.count_if(a["result"] == "written").alias("written"), F.count_if(a["result"] == "copied").alias("copied"), F.count_if(d["result"] == "delete").alias("skipped_duplicates"), F.count_if(a["status"] == "error").alias("failed"))


def errors(manifest: DataFrame) -> DataFrame:
    """(media_path, stage, reason): every stage's error of every file; tool output after " - /" is cut off."""
    stages = [("Hash", "dedupe"), ("Reconcile", "metadata"), ("Apply", "apply")]
    of = lambda name, c: F.struct(F.lit(name).alias("stage"), F.col(c)["status"].alias("status"), F.regexp_replace(F.coalesce(F.col(c)["error"], F.lit("")), r"(?s) - /.*", "").alias("reason"))
    rows = manifest.select("media_path", F.inline(F.array(*[of(n, c) for n, c in stages])))
    return rows.where(F.col("status") == "error").drop("status")


def side_summary(lone: DataFrame) -> DataFrame:
    """Media and side files that no link has, over link.unmatched()'s rows."""
    return lone.agg(F.count_if(F.col("kind") == "media").alias("unmatched_media"), F.count_if(F.col("kind") == "sidecar").alias("unmatched_sidecars"))


def gaps_summary(pairs: DataFrame) -> DataFrame:
    """What library.pair() left alone, by kind."""
    kinds = ("media_without_record", "record_without_media", "unsupported_media")
    return pairs.agg(*[F.count_if(F.col("pairing") == k).alias(k) for k in kinds])


def export_summary(planned: DataFrame) -> DataFrame:
    """Number of planned or executed copies."""
    return planned.agg(F.count(F.lit(1)).alias("operations"))


def first_failures(entries: DataFrame, n: int = 3) -> DataFrame:
    """The first failed entries by name."""
    return entries.where("embed_status = 'error'").orderBy("filename").limit(n)


def enrich_summary(entries: DataFrame) -> DataFrame:
    """Counts over enriched entries(filename, location, kind, embed_status)."""
    return entries.agg(
        F.count(F.lit(1)).alias("records"), F.count("location").alias("geocoded"), F.count_if(F.col("location").isNull()).alias("no_geo"),
        F.count_if((F.col("kind") == "image") & (F.col("embed_status") == "processed")).alias("images"),
        F.count_if((F.col("kind") == "video") & (F.col("embed_status") == "processed")).alias("videos"),
        F.count_if(F.col("embed_status") == "error").alias("failed"),
    )
