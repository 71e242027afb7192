"""Redundant copies by content hash."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shutterlake.operators.spread import known_of


def resolve(manifest: DataFrame, prefer: str = "album") -> DataFrame:
    """manifest(hash, source, ...) with result: of a hash held by preferred and other sources, the others go.

    Rows without a hash are kept out of every group and keep a null result. The groups meet as flags per hash, and only
    hashes held by both kinds are told to their rows; no hash, however many rows have it, is one task's.
    """
    known = manifest.where(F.col("hash").isNotNull())
    has = lambda of: F.coalesce(F.bool_or(of), F.lit(False))
    flags = known.groupBy("hash").agg(has(F.col("source.type") == prefer).alias("has_preferred"), has(F.col("source.type") != prefer).alias("has_other"), F.count(F.lit(1)).alias("__n"))
    both = flags.where("has_preferred AND has_other").select("hash", F.lit(True).alias("__both"), "__n")
    gone = F.col("__both") & (F.col("source.type") != prefer)
    result = F.when(F.col("hash").isNull(), F.lit(None).cast("string")).when(gone, "delete").otherwise("keep")
    return known_of(manifest, both, "hash", "__n").withColumn("result", result).drop("__both")


def assured(resolved: DataFrame) -> DataFrame:
    """The same rows; reading one that has no error and no result fails."""
    open_ = (F.col("status") != "error") & F.col("result").isNull()
    return resolved.withColumn("result", F.when(open_, F.raise_error(F.lit("a file without an error was not resolved")).cast("string")).otherwise(F.col("result")))


def can_keep(result: str = "result", status: str = "status"):
    """Rows that weren't deduplicated, or neither deleted nor failed."""
    return F.coalesce(F.col(result) != "delete", F.lit(True)) & F.coalesce(F.col(status) != "error", F.lit(True))
