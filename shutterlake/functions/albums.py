"""Album names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def valid_album_name(name: Column) -> Column:
    """Not blank, without slashes and control characters."""
    return (F.regexp_replace(name, r"(?U)\s", "") != "") & ~name.rlike(r"[/\\\x00-\x1F]")


def valid_proposal(name: Column) -> Column:
    """A valid album name that isn't the word null."""
    return (F.lower(name) != "null") & valid_album_name(name)
