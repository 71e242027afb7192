"""Media files and their side files: a scored join within each directory."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shutterlake.functions.names import parse_media, parse_sidecar
from shutterlake.functions.paths import basename, dirname
from shutterlake.operators.prefixes import prefix_pairs

FUZZY_THRESHOLD = 40


def parsed(files: DataFrame, sidecar: bool, anchored: bool = False) -> DataFrame:
    """files(path) with dir, name, duplicate, extension."""
    part = parse_sidecar(F.col("path"), anchored) if sidecar else parse_media(F.col("path"))
    return files.select("path", dirname(F.col("path")).alias("dir"), part.alias("p")).select("path", "dir", "p.*")


def candidates(media: DataFrame, sidecars: DataFrame, fuzzy: bool = True, threshold: int = FUZZY_THRESHOLD) -> DataFrame:
    """(media, sidecar, score) of every pair that matches, from parsed() frames.

    Directory and duplicate marker must agree, null with null. Names that are equal score 150 with the same extension
    and 100 else; a side file named after the whole media name scores 100; where one name begins with the other and
    the longer one reaches the threshold, the score is 50 plus the shorter one's length. The rules are equi-joins and one
    pass over the names in order, so that a directory of any size needs no pairwise comparison.
    """
    # The join key for the marker: text that no marker has stands for none.
    mark = F.coalesce("duplicate", F.lit("-")).alias("mark")
    m = media.select(F.col("path").alias("media"), F.col("dir").alias("m_dir"), F.col("name").alias("m_name"), F.col("extension").alias("m_ext"), mark.alias("m_mark"))
    s = sidecars.select(F.col("path").alias("sidecar"), F.col("dir").alias("s_dir"), F.col("name").alias("s_name"), F.col("extension").alias("s_ext"), mark.alias("s_mark"))
    near = (F.col("m_dir") == F.col("s_dir")) & (F.col("m_mark") == F.col("s_mark"))
    exact_score = F.when((F.col("m_ext") == F.col("s_ext")) & (F.col("m_ext") != ""), 150).otherwise(100)
    exact = m.join(s, near & (F.col("m_name") == F.col("s_name"))).select("media", "sidecar", exact_score.alias("score"))
    inside = F.lower(F.concat("m_name", "m_ext")) == F.lower("s_name")
    embedded = m.join(s, near & inside).where("m_name <> s_name").select("media", "sidecar", F.lit(100).alias("score"))
    out = exact.unionByName(embedded)
    if fuzzy:
        score = (F.lit(50) + F.least(F.length("m_name"), F.length("s_name"))).alias("score")
        sides = lambda rows, p, side: rows.select(F.col(f"{p}_dir").alias("dir"), F.col(f"{p}_mark").alias("mark"), F.col(f"{p}_name").alias("name"), F.lit(side).alias("side"))
        names = sides(m, "m", 1).unionByName(sides(s, "s", 2)).groupBy("dir", "mark", "name").agg(F.bit_or("side").alias("sides"))
        pairs = prefix_pairs(names, ["dir", "mark"]).where(F.length("long") >= threshold)
        for m_name, s_name in (("short", "long"), ("long", "short")):
            on = pairs.where((F.col(f"{m_name}_sides").bitwiseAND(1) > 0) & (F.col(f"{s_name}_sides").bitwiseAND(2) > 0)).select("dir", "mark", F.col(m_name).alias("__m"), F.col(s_name).alias("__s"))
            met = on.join(m, (F.col("dir") == F.col("m_dir")) & (F.col("mark") == F.col("m_mark")) & (F.col("__m") == F.col("m_name")))
            met = met.join(s, (F.col("dir") == F.col("s_dir")) & (F.col("mark") == F.col("s_mark")) & (F.col("__s") == F.col("s_name")))
            out = out.unionByName(met.where(~inside).select("media", "sidecar", score))
    return out


def confidence(score: Column) -> Column:
    return F.when(score >= 150, 3).when(score >= 100, 2).otherwise(1)


def link(media: DataFrame, sidecars: DataFrame, fuzzy: bool = True, threshold: int = FUZZY_THRESHOLD, anchored: bool = False) -> DataFrame:
    """media(path) with sidecar, score and confidence of its best side file, null without one; ties go to the smaller path."""
    found = candidates(parsed(media, False), parsed(sidecars, True, anchored), fuzzy, threshold)
    best = found.groupBy("media").agg(F.min(F.struct((-F.col("score")).alias("minus"), "sidecar")).alias("b"))
    best = best.select("media", F.col("b.sidecar").alias("sidecar"), (-F.col("b.minus")).alias("score"))
    joined = media.join(best, media.path == best.media, "left").drop("media")
    return joined.withColumn("confidence", F.when(F.col("score").isNotNull(), confidence(F.col("score"))))


def unmatched(media: DataFrame, sidecars: DataFrame, linked: DataFrame) -> DataFrame:
    """(kind, path) of the media and the side files that no link has."""
    got = linked.where(F.col("sidecar").isNotNull())
    lone_media = media.select("path").join(got.select("path"), "path", "left_anti").select(F.lit("media").alias("kind"), "path")
    lone_side = sidecars.select("path").join(got.select(F.col("sidecar").alias("path")).distinct(), "path", "left_anti").select(F.lit("sidecar").alias("kind"), "path")
    return lone_media.unionByName(lone_side)


def label_takeout(media: DataFrame, markers: DataFrame) -> DataFrame:
    """Adds source: an album if an album marker lies in the directory, else loose."""
    dirs = markers.select(dirname(F.col("path")).alias("marked")).distinct()
    d = dirname(F.col("path"))
    joined = media.join(dirs, d == F.col("marked"), "left")
    album = F.col("marked").isNotNull()
    return joined.withColumn("source", F.struct(F.when(album, "album").otherwise("loose").alias("type"), F.when(album, basename(d)).alias("name"))).drop("marked")


def label_archive(media: DataFrame, root: str) -> DataFrame:
    """Adds source: loose in the root itself, else an album named after the nearest directory."""
    d = dirname(F.col("path"))
    loose = d == (root.rstrip("/") or "/")
    return media.withColumn("source", F.struct(F.when(loose, "loose").otherwise("album").alias("type"), F.when(~loose, basename(d)).alias("name")))
