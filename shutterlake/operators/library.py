"""Pairing of a library's media with its records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shutterlake.functions.handlers import SUPPORTED
from shutterlake.functions.paths import extension


def visible(files: DataFrame) -> DataFrame:
    """files(filename) without those whose name begins with a dot, and whether each is supported media."""
    ok = F.lower(extension(F.col("filename"))).isin(*SUPPORTED)
    return files.where(~F.col("filename").startswith(".")).withColumn("supported", ok)


def pair(files: DataFrame, records: DataFrame) -> DataFrame:
    """(filename, pairing): paired, unsupported_media, media_without_record or record_without_media.

    `files` and `records` have a unique filename each; hidden files don't count as files.
    """
    m = visible(files).select(F.col("filename").alias("m_name"), "supported")
    r = records.select(F.col("filename").alias("r_name"))
    both = m.join(r, (F.col("m_name") == F.col("r_name")) & F.col("supported"), "full_outer")
    label = (
        F.when(F.col("m_name").isNull(), "record_without_media")
        .when(~F.col("supported"), "unsupported_media")
        .when(F.col("r_name").isNull(), "media_without_record")
        .otherwise("paired")
    )
    return both.select(F.coalesce("m_name", "r_name").alias("filename"), label.alias("pairing"))


def records_by_pairing(records: DataFrame, pairs: DataFrame) -> DataFrame:
    """All records, those with media and those without, with their pairing."""
    return records.join(pairs.where(F.col("pairing").isin("paired", "record_without_media")), "filename")


def unmatched(pairs: DataFrame) -> DataFrame:
    """What pair() left alone, in the order of kinds and names."""
    return pairs.where("pairing <> 'paired'").orderBy("pairing", "filename")
