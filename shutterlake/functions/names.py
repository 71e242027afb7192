"""Media and side-file names, taken apart for matching."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from shutterlake.functions.paths import basename, extension, stem

# The naming conventions of the exported libraries.
DUPLICATE = r"(?U)\((\d+)\)$"
EDITED = r"(?:-edited|-edite|-edit|-edi|-ed|-e)$"
#: The first ".su" anywhere cuts the rest off; a mere ".s" counts at the end alone.
METADATA = r"(?s)\.su.*|\.s$"
#: The stricter reading: ".s" or more of ".supplemental-metadata" at the end.
METADATA_AT_END = "(?:" + "|".join(re.escape(".supplemental-metadata"[:n]) for n in range(len(".supplemental-metadata"), 1, -1)) + ")$"


def duplicate_marker(name: Column) -> Column:
    """The number of a trailing (N) as digits without leading zeros, or null."""
    digits = F.regexp_extract(name, DUPLICATE, 1)
    plain = F.regexp_replace(digits, r"^0+(?=.)", "")
    return F.when(digits != "", plain)


def parse_media(path: Column) -> Column:
    """struct(name, duplicate, extension): the stem without marker and edited suffix, each removed once."""
    base = basename(path)
    whole = stem(base)
    name = F.regexp_replace(F.regexp_replace(whole, DUPLICATE, ""), EDITED, "")
    return F.struct(name.alias("name"), duplicate_marker(whole).alias("duplicate"), F.lower(extension(base)).alias("extension"))


def parse_sidecar(path: Column, anchored: bool = False) -> Column:
    """struct(name, duplicate, extension) of the media file that a side file belongs to."""
    whole = stem(basename(path))
    rest = F.regexp_replace(F.regexp_replace(whole, DUPLICATE, ""), METADATA_AT_END if anchored else METADATA, "")
    return F.struct(stem(rest).alias("name"), duplicate_marker(whole).alias("duplicate"), F.lower(extension(rest)).alias("extension"))
