"""Coordinates of side files and of tags, and the place that belongs to them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_KM = 6371.0088


def sidecar_geo(exif: Column, plain: Column) -> Column:
    """The embedded coordinates, else the plain ones; a zero or missing latitude or longitude makes either void."""

    def valid(g: Column) -> Column:
        ok = (g["latitude"] != 0) & (g["longitude"] != 0)
        return F.when(ok, F.struct(*[g[k].alias(k) for k in ("latitude", "longitude", "altitude")]))

    return F.coalesce(valid(exif), valid(plain))


def disk_geo(latitude: Column, longitude: Column, altitude: Column) -> Column:
    """Coordinates of the tags if both are there; zero is a place like others."""
    whole = F.struct(latitude.cast("double").alias("latitude"), longitude.cast("double").alias("longitude"), altitude.cast("double").alias("altitude"))
    return F.when(latitude.isNotNull() & longitude.isNotNull(), whole)


def place(name: Column, admin1: Column, cc: Column) -> Column:
    """struct(city, region, country), empty text where unknown."""
    return F.struct(F.coalesce(name, F.lit("")).alias("city"), F.coalesce(admin1, F.lit("")).alias("region"), F.coalesce(cc, F.lit("")).alias("country"))
