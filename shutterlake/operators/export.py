"""The export plan: a date-and-album layout without collisions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shutterlake.functions.dates import stamp
from shutterlake.functions.paths import extension
from shutterlake.operators.albums import problems, targets_with_dates
from shutterlake.operators.running import running
from shutterlake.operators.spread import known_of
from shutterlake.sources.kept import dropped, kept

#: Offenders that a refusal names; it counts the others.
MOST_NAMED = 1000


def refusals(records: DataFrame) -> DataFrame:
    """(kind, what, proposals): why an export is refused. Names of albums are told only once no proposals conflict."""
    found = problems(records, all_proposals=False)
    clash = found.where("kind = 'conflict'").limit(1).select(F.lit(True).alias("clash"))  # one row at most
    return found.join(F.broadcast(clash), (F.col("kind") == "invalid_name") & F.col("clash"), "left_anti")


def validate(records: DataFrame) -> None:
    """Refuses an export while proposals conflict, then while a target is no album name."""
    found = refusals(records).persist()
    first = found.orderBy("kind", "what").take(MOST_NAMED)
    more = found.count() - len(first) if len(first) == MOST_NAMED else 0
    found.unpersist()
    if first:
        told = [{"group_id": r.what, "proposals": r.proposals} if r.kind == "conflict" else r.what for r in first]
        text = "conflicting proposals" if first[0].kind == "conflict" else "invalid album names"
        raise RuntimeError(f"{text}: {told}" + (f" and {more} more" if more else ""))


def plan(records: DataFrame) -> DataFrame:
    """records(filename, group_id, first_date timestamp, album, proposed_album) with target, the path within the export.

    The folder of an album has the least date over all its groups; the name has the file's own date. The n-th claimant
    of a path, by group and filename, gets -n before the extension: claimants are counted in ranges, so that a path that
    all records claim is no single task's work. Dates per album meet pre-aggregated, and neither an album nor a group,
    however large, is gathered for them. The records are computed once; between the steps stand tables, so that no more
    than one shuffle of all records is on disk at a time.
    """
    told = kept(records, "records", free=True)
    groups = kept(targets_with_dates(told, "__n").withColumnRenamed("target", "goal"), "groups", free=True)
    least = groups.where(F.col("goal").isNotNull()).groupBy("goal").agg(F.min("min_date").alias("folder_date"), F.count(F.lit(1)).alias("__groups"))
    facts = kept(known_of(groups, least, "goal", "__groups").select("group_id", "goal", "folder_date", "__n"), "facts", free=True)
    rows = known_of(told, facts, "group_id", "__n")
    year = lambda c: F.year(c).cast("string")
    folder = F.when(F.col("goal").isNotNull(), F.concat(year("folder_date"), F.lit("/"), F.date_format("folder_date", "yyyyMMdd"), F.lit("-"), "goal")).otherwise(year("first_date"))
    root = F.concat(folder, F.lit("/"), stamp(F.col("first_date")))
    rooted = kept(rows.withColumn("root", root).withColumn("ext", extension(F.col("filename"))).drop("goal", "folder_date"), "rooted", free=True)
    for done in (told, groups, facts):
        dropped(done)
    rows = running(rooted, ["root", "ext"], ["group_id", "filename"], "n")
    dropped(rooted)
    target = F.concat("root", F.when(F.col("n") > 0, F.concat(F.lit("-"), F.col("n").cast("string"))).otherwise(""), "ext")
    return rows.withColumn("target", target).drop("root", "ext", "n")
