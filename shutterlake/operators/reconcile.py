"""Dates, coordinates and tags to write, from the disk's tags and the side file."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shutterlake.functions.dates import epoch_to_exif, epoch_to_iso
from shutterlake.functions.handlers import by_handler, has_handler
from shutterlake.functions.paths import basename, extension

_NONE = "array<string>"
_GEO = "struct<latitude:double,longitude:double,altitude:double>"


def reconcile(rows: DataFrame, skip_write: bool = False) -> DataFrame:
    """Adds metadata struct(status, write_tags, dates, geo, error) to rows(path, tags, sidecar, side, ...).

    `tags` is the map that the tag reader gave, null if it gave none. `sidecar` is the side file's path or null;
    `side` its content struct(timestamp text, geo, error). The cases are tried in this order: no handler, no tags, no
    side file, a side file that can't be read or whose timestamp is no number (what the disk says is lost, too), else
    both are combined, the disk's values having precedence.
    """
    ext = F.lower(extension(basename(F.col("path"))))
    tags, side = F.col("tags"), F.col("side")
    disk_dates = F.coalesce(by_handler(ext, lambda h: h.dates(tags)), F.array().cast(_NONE))
    primary = by_handler(ext, lambda h: h.timestamp(tags))
    disk_geo = by_handler(ext, lambda h: h.geo(tags)).cast(_GEO)
    stamp = F.when(F.col("sidecar").isNotNull(), side["timestamp"])
    side_geo = F.when(F.col("sidecar").isNotNull(), side["geo"]).cast(_GEO)
    use_stamp = primary.isNull() & stamp.isNotNull() & (stamp != "")
    broken = F.col("sidecar").isNotNull() & (side["error"].isNotNull() | (use_stamp & stamp.try_cast("bigint").isNull()))
    write = F.concat(
        F.when(use_stamp, by_handler(ext, lambda h: h.write_timestamp(epoch_to_exif(stamp)))).otherwise(F.array().cast(_NONE)),
        F.when(disk_geo.isNull() & side_geo.isNotNull(), by_handler(ext, lambda h: h.write_geo(side_geo))).otherwise(F.array().cast(_NONE)),
    )
    none = F.array().cast(_NONE)
    value = lambda status, tags_, dates, geo, error: F.struct(F.lit(status).alias("status"), tags_.alias("write_tags"), dates.alias("dates"), geo.cast(_GEO).alias("geo"), error.cast("string").alias("error"))
    void = F.lit(None)
    metadata = (
        F.when(~has_handler(ext), value("skipped", none, none, void, F.concat(F.lit("No metadata handler for "), ext)))
        .when(tags.isNull(), value("error", none, none, void, F.concat(F.lit("The tag reader did not report on "), F.col("path"))))
        .when(broken, value("error", none, none, void, F.coalesce(side["error"], F.concat(F.lit("Not a timestamp: "), stamp))))
        .otherwise(
            value(
                "processed",
                none if skip_write else write,
                F.when(use_stamp, F.array_prepend(disk_dates, epoch_to_iso(stamp))).otherwise(disk_dates),
                F.coalesce(disk_geo, side_geo),
                void,
            )
        )
    )
    return rows.withColumn("metadata", metadata)
