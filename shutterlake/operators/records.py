"""Records: their schema, their JSON form, and the queries over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shutterlake.operators.running import running

RECORD_DDL = (
    "dates array<string>, geo struct<latitude:double,longitude:double,altitude:double>, album string, group_id string, "
    "location struct<city:string,region:string,country:string>, caption string, proposed_album string"
)
CORE, OPTIONAL = ("dates", "geo", "album", "group_id"), ("location", "caption", "proposed_album")


def _fields() -> dict[str, Column]:
    """What a record has of its manifest row: an album only if the source is one."""
    album = F.when(F.col("source.type") == "album", F.col("source.name"))
    return {"dates": F.col("metadata.dates"), "geo": F.col("metadata.geo"), "album": album, "group_id": F.col("group_id")}


def from_manifest(manifest: DataFrame) -> DataFrame:
    """The record of each manifest row."""
    return manifest.select("media_path", *(c.alias(n) for n, c in _fields().items()))


def with_json(manifest: DataFrame) -> DataFrame:
    """The manifest with record_json, each row's record as it is written."""
    rows = manifest.select(F.struct(*manifest.columns).alias("__row"), *(c.alias(n) for n, c in _fields().items()))
    return rows.select("__row.*", to_json(list(CORE)).alias("record_json"))


def to_json(columns: list[str] | None = None) -> Column:
    """A record as JSON: core fields always, nulls included; optional ones only if they have a value."""
    have = set(columns or CORE + OPTIONAL)
    core = F.to_json(F.struct(*[c for c in CORE if c in have]), {"ignoreNullFields": "false"})
    rest = F.to_json(F.struct(*[c for c in OPTIONAL if c in have])) if have & set(OPTIONAL) else F.lit("{}")
    body = F.substring(core, F.lit(2), F.length(core) - 2)
    more = F.substring(rest, F.lit(2), F.length(rest) - 2)
    return F.concat(F.lit("{"), F.concat_ws(",", body, F.when(more != "", more)), F.lit("}"))


def in_region(records: DataFrame, region: str) -> DataFrame:
    return records.where(F.col("location.region") == region)


def dated_between(records: DataFrame, start: str, end: str) -> DataFrame:
    """Records whose first date lies in a half-open range of text."""
    d = F.get("dates", F.lit(0))
    return records.where((d >= start) & (d < end))


def undated(records: DataFrame) -> DataFrame:
    return records.where(F.coalesce(F.size("dates"), F.lit(0)) <= 0)


def uncaptioned(records: DataFrame) -> DataFrame:
    return records.where(F.coalesce("caption", F.lit("")) == "")


def proposed(records: DataFrame) -> DataFrame:
    return records.where(F.col("proposed_album").isNotNull())


def any_date_starts(records: DataFrame, prefix: str) -> DataFrame:
    return records.where(F.exists("dates", lambda d: d.startswith(prefix)))


def group_ids(records: DataFrame) -> DataFrame:
    return records.where(F.col("group_id").isNotNull()).select("group_id").distinct()


def siblings(records: DataFrame, which: Column) -> DataFrame:
    """All members of the groups of the records that `which` selects."""
    return records.join(records.where(which).select("group_id").distinct(), "group_id", "left_semi")


def sibling_listing(records: DataFrame, which: Column) -> DataFrame:
    """siblings() with `place`, each one's number from 0 within its group by filename."""
    return running(siblings(records, which), ["group_id"], ["filename"], "place")
