"""Path and file-name expressions. Every function takes and returns columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Leading dots never begin an extension; the last other dot does.
EXTENSION = r"(?s)^\.*[^.].*?(\.[^.]*)$"


def basename(path: Column) -> Column:
    return F.regexp_extract(path, r"(?s)([^/]*)$", 1)


def dirname(path: Column) -> Column:
    """What precedes the last slash; the root keeps its slash, a bare name has none."""
    cut = F.regexp_extract(path, r"(?s)^(.*)/[^/]*$", 1)
    return F.when((cut == "") & path.startswith("/"), "/").otherwise(F.regexp_replace(cut, r"(?<=[^/])/+$", ""))


def extension(name: Column) -> Column:
    """The extension with its dot, or the empty string."""
    return F.regexp_extract(name, EXTENSION, 1)


def stem(name: Column) -> Column:
    return F.substring(name, F.lit(1), F.length(name) - F.length(extension(name)))


def relative_to(path: Column, base: str) -> Column:
    """The path below `base`, with forward slashes."""
    plain = F.regexp_replace(path, r"\\", "/")
    root = base.replace("\\", "/").rstrip("/") + "/"
    return F.when(plain.startswith(root), F.substring(plain, F.lit(len(root) + 1), F.length(plain))).otherwise(plain)
