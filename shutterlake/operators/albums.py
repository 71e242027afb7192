"""Proposals, conflicts and target albums of groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shutterlake.functions.albums import valid_album_name
from shutterlake.operators.spread import known_of

_FULL = lambda c: F.col(c).isNotNull() & (F.col(c) != "")


def proposals(records: DataFrame) -> DataFrame:
    """(group_id, proposals): each group's distinct non-empty proposals, sorted."""
    full = records.where(_FULL("proposed_album"))
    return full.groupBy("group_id").agg(F.array_sort(F.collect_set("proposed_album")).alias("proposals"))


def conflicts(records: DataFrame) -> DataFrame:
    """The groups with more than one proposal."""
    return proposals(records).where(F.size("proposals") > 1)


def target_albums(records: DataFrame, *more: Column) -> DataFrame:
    """(group_id, target): the first non-empty proposal in file order, else the first non-empty import album, else null.

    `more` are aggregates over the group's records, each a column of its own.
    """
    first = lambda c: F.min(F.when(_FULL(c), F.struct("filename", F.col(c).alias("v"))))["v"]
    both = records.groupBy("group_id").agg(first("proposed_album").alias("p"), first("album").alias("a"), *more)
    return both.select("group_id", F.coalesce("p", "a").alias("target"), *both.columns[3:])


def _dated(records: DataFrame) -> Column:
    """The records' first_date; one without fails the query."""
    undated = F.raise_error(F.concat(F.lit("a record without a date is in group "), F.coalesce("group_id", F.lit("")))).cast(records.schema["first_date"].dataType)
    return F.coalesce("first_date", undated)


def min_dates(records: DataFrame) -> DataFrame:
    """(group_id, min_date) of records(group_id, first_date); a group with an undated member fails the query."""
    return records.groupBy("group_id").agg(F.min(_dated(records)).alias("min_date"))


def targets_with_dates(records: DataFrame, size: str) -> DataFrame:
    """(group_id, target, min_date, `size`): target_albums and min_dates at once, and each group's number of records."""
    return target_albums(records.where(F.col("group_id").isNotNull()), F.min(_dated(records)).alias("min_date"), F.count(F.lit(1)).alias(size))


def invalid_names(records: DataFrame, all_proposals: bool = True) -> DataFrame:
    """The distinct invalid album names: of all proposals, else of the fallback; or of the resolved targets alone."""
    names = target_albums(records).select(F.col("target").alias("name"))
    if all_proposals:
        told = records.where(_FULL("proposed_album")).select("group_id", F.col("proposed_album").alias("name"))
        rest = target_albums(records.withColumn("proposed_album", F.lit(None).cast("string")))
        rest = rest.join(told.select("group_id").distinct(), "group_id", "left_anti").select(F.col("target").alias("name"))
        names = told.select("name").unionByName(rest)
    return names.where(F.col("name").isNotNull() & ~valid_album_name(F.col("name"))).distinct()


def problems(records: DataFrame, all_proposals: bool = True) -> DataFrame:
    """(kind, what, proposals): each group whose proposals conflict, each invalid album name."""
    clash = conflicts(records).select(F.lit("conflict").alias("kind"), F.col("group_id").alias("what"), "proposals")
    wrong = invalid_names(records, all_proposals).select(F.lit("invalid_name").alias("kind"), F.col("name").alias("what"), F.lit(None).cast("array<string>").alias("proposals"))
    return clash.unionByName(wrong)


def check(records: DataFrame) -> dict:
    """The report of a library check; its two lists are what a person has to mend, and so is their length."""
    found = problems(records).orderBy("kind", "what").collect()
    clash = [{"group_id": r.what, "proposals": r.proposals} for r in found if r.kind == "conflict"]
    wrong = [r.what for r in found if r.kind == "invalid_name"]
    return {"ok": not clash and not wrong, "conflicts": clash, "invalid_album_names": wrong}


def propose(events: DataFrame, group_id: str, album: str | None, version: int) -> DataFrame:
    """The proposal log with one more entry; null clears."""
    if album is not None and (album.lower() == "null" or not album.strip() or any(c in "/\\" or ord(c) < 32 for c in album)):
        raise ValueError(f"not an album name: {album!r}")
    row = events.sparkSession.createDataFrame([(group_id, album, version)], "group_id string, value string, version long")
    return events.unionByName(row)


def overlay(records: DataFrame, events: DataFrame) -> DataFrame:
    """records with the last proposal of their group in force; groups without an entry keep what their records say."""
    last = events.groupBy("group_id").agg(F.max_by("value", "version").alias("value")).withColumn("told", F.lit(True))
    sizes = records.groupBy("group_id").agg(F.count(F.lit(1)).alias("__n"))
    joined = known_of(records, last.join(sizes, "group_id"), "group_id", "__n")
    return joined.withColumn("proposed_album", F.when(F.col("told"), F.col("value")).otherwise(F.col("proposed_album"))).drop("value", "told")


def without_group(records: DataFrame) -> DataFrame:
    """The records whose group_id is null or empty."""
    return records.where(F.coalesce("group_id", F.lit("")) == "")


def require_groups(records: DataFrame) -> None:
    if not without_group(records).limit(1).isEmpty():
        raise RuntimeError("a record has no group_id")
