"""Classification of a file listing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shutterlake.functions.handlers import KNOWN
from shutterlake.functions.paths import basename, dirname, extension


def bucket(name: Column) -> Column:
    """album_marker, sidecar, media or other; the first rule that holds decides."""
    ext = F.lower(extension(name))
    return F.when(name == "metadata.json", "album_marker").when(ext == ".json", "sidecar").when(ext.isin(*KNOWN), "media").otherwise("other")


def classify(files: DataFrame) -> DataFrame:
    """files(path) with dir, filename, ext and bucket."""
    name = basename(F.col("path"))
    return files.select("*", dirname(F.col("path")).alias("dir"), name.alias("filename"), F.lower(extension(name)).alias("ext"), bucket(name).alias("bucket"))


def bucket_counts(classified: DataFrame) -> DataFrame:
    return classified.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))


def looks_like_takeout(classified: DataFrame) -> bool:
    """Whether the listing has any side file or album marker."""
    return not classified.where(F.col("bucket").isin("album_marker", "sidecar")).limit(1).isEmpty()
