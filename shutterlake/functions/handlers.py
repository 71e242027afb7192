"""Formats by extension, and what their tags mean: a registry of handlers that emit columns."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from shutterlake.functions.dates import normalize_disk_date
from shutterlake.functions.geo import disk_geo

# Formats, and tags in their order of priority.
IMAGES = (".jpg", ".jpeg", ".heic", ".png", ".mp")
VIDEOS = (".mp4", ".mov")
UNSUPPORTED = (".avi", ".mkv", ".wmv", ".flv")
SUPPORTED = IMAGES + VIDEOS
KNOWN = SUPPORTED + UNSUPPORTED
EXIF_DATES = ("EXIF:DateTimeOriginal", "EXIF:CreateDate", "Composite:GPSDateTime", "EXIF:ModifyDate", "File:FileCreateDate", "File:FileModifyDate")
QUICKTIME_DATES = ("QuickTime:CreationDate", "QuickTime:CreateDate", "QuickTime:GPSDateTime", "QuickTime:ModifyDate", "File:FileCreateDate", "File:FileModifyDate")
GEO_TAGS = ("Composite:GPSLatitude", "Composite:GPSLongitude", "Composite:GPSAltitude")


@dataclass(frozen=True)
class Handler:
    """A format family: its extensions, its date tags (the first is the primary one), its tag texts."""

    name: str
    extensions: tuple[str, ...]
    date_tags: tuple[str, ...]
    timestamp_tag: str

    def dates(self, tags: Column) -> Column:
        """All valid dates in order of priority, repeated ones kept."""
        return F.filter(F.array(*[normalize_disk_date(tags[t]) for t in self.date_tags]), lambda d: d.isNotNull())

    def timestamp(self, tags: Column) -> Column:
        return normalize_disk_date(tags[self.date_tags[0]])

    def geo(self, tags: Column) -> Column:
        return disk_geo(*[tags[t].try_cast("double") for t in GEO_TAGS])

    def write_timestamp(self, exif_text: Column) -> Column:
        return F.array(F.concat(F.lit(f"{self.timestamp_tag}="), exif_text))

    def write_geo(self, geo: Column) -> Column:
        raise NotImplementedError


class Exif(Handler):
    def write_geo(self, geo: Column) -> Column:
        text = {k: geo[k].cast("string") for k in ("latitude", "longitude", "altitude")}
        tags = F.array(
            F.concat(F.lit("Composite:GPSLatitude="), text["latitude"]),
            F.concat(F.lit("Composite:GPSLongitude="), text["longitude"]),
            F.concat(F.lit("GPSAltitude="), text["altitude"]),
            F.concat(F.lit("GPSAltitudeRef="), text["altitude"]),
        )
        return F.filter(tags, lambda t: t.isNotNull())  # nothing is written for a missing altitude


class QuickTime(Handler):
    def write_geo(self, geo: Column) -> Column:
        both = F.concat(F.lit("Keys:GPSCoordinates="), geo["latitude"].cast("string"), F.lit(", "), geo["longitude"].cast("string"))
        return F.array(F.concat(both, F.coalesce(F.concat(F.lit(", "), geo["altitude"].cast("string")), F.lit(""))))


REGISTRY: list[Handler] = [
    Exif("exif", IMAGES, EXIF_DATES, "SubSecDateTimeOriginal"),
    QuickTime("quicktime", VIDEOS, QUICKTIME_DATES, "CreationDate"),
]


def required_tags(registry: list[Handler] | None = None) -> list[str]:
    """Every tag that some handler reads, once."""
    return list(dict.fromkeys([t for h in registry or REGISTRY for t in h.date_tags] + list(GEO_TAGS)))


def by_handler(extension: Column, value, registry: list[Handler] | None = None) -> Column:
    """value(handler) for the extension's handler, null if it has none."""
    out = F.lit(None)
    for h in registry or REGISTRY:
        out = F.when(extension.isin(*h.extensions), value(h)).otherwise(out)
    return out


def has_handler(extension: Column, registry: list[Handler] | None = None) -> Column:
    return extension.isin(*[e for h in registry or REGISTRY for e in h.extensions])


def is_image(extension: Column) -> Column:
    return F.lower(extension).isin(*IMAGES)


def is_video(extension: Column) -> Column:
    return F.lower(extension).isin(*VIDEOS)
