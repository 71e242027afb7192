import datetime
import random
import time
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from shutterlake.operators import albums, dedupe, export, spread
from shutterlake.sources import kept

FREED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@pytest.fixture
def crowded(spark):
    """Shuffles as they are, so that a task's rows can be counted."""
    names = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.shuffle.partitions": "16"}
    before = {n: spark.conf.get(n) for n in names}
    for n, v in names.items():
        spark.conf.set(n, v)
    yield
    for n, v in before.items():
        spark.conf.set(n, v)


def largest(df):
    return df.groupBy(F.spark_partition_id().alias("task")).count().agg(F.max("count")).first()[0]


def test_known_of_equals_a_left_join(spark):
    rng = random.Random(1)
    keys = [None if rng.random() < 0.1 else "big" if rng.random() < 0.4 else f"k{rng.randrange(300)}" for _ in range(3000)]
    rows = spark.createDataFrame([(i, k, {"a": i}, "mine") for i, k in enumerate(keys)], "i int, k string, m map<string,int>, `a.b` string").repartition(5)
    told = {k: keys.count(k) for k in set(keys) if k and k != "k7"}
    facts = spark.createDataFrame([*((k, n, k.upper(), None if n % 2 else n) for k, n in told.items()), (None, 5000, "NULL", 1), ("absent", 9000, "ABSENT", 2)], "k string, n long, v string, w long")
    got = spread.known_of(rows, facts, "k", "n")
    assert got.columns == ["i", "k", "m", "a.b", "v", "w"]
    expected = [(i, k, {"a": i}, "mine", k.upper() if k in told else None, None if k not in told or told[k] % 2 else told[k]) for i, k in enumerate(keys)]
    assert sorted(map(tuple, got.collect()), key=lambda r: r[0]) == expected
    assert spread.known_of(rows.limit(0), facts, "k", "n").count() == 0
    assert {r.v for r in spread.known_of(rows, facts.limit(0), "k", "n").collect()} == {None}


def test_a_hash_of_half_the_files_is_no_task_of_its_own(spark, crowded):
    n = 20000
    i = F.col("id")
    files = spark.range(n).select(
        F.concat(F.lit("p"), i).alias("path"), F.when(i % 2 == 0, "hot").when(i % 10 == 1, None).otherwise(F.concat(F.lit("h"), i % 777)).alias("hash"),
        F.struct(F.when(i % 3 == 0, "album").otherwise("loose").alias("type")).alias("source"),
    )
    got = dedupe.resolve(files)
    assert largest(got) < 2 * n / 16
    rows = files.collect()
    kinds = {}
    for r in rows:
        kinds.setdefault(r.hash, set()).add(r.source.type)
    expected = {r.path: None if r.hash is None else "delete" if len(kinds[r.hash]) == 2 and r.source.type == "loose" else "keep" for r in rows}
    assert {r.path: r.result for r in got.collect()} == expected


def test_an_album_and_a_group_of_half_the_records(spark, crowded):
    n = 8000
    i = F.col("id")
    day = datetime.datetime(2020, 1, 1)
    records = spark.range(n).select(
        F.format_string("f%05d.jpg", i).alias("filename"), F.when(i % 2 == 0, "g").otherwise(F.concat(F.lit("g"), i)).alias("group_id"),
        F.timestamp_add("DAY", (i % 500).cast("int"), F.lit(day)).alias("first_date"), F.when(i % 4 == 3, None).otherwise("Sea").alias("album"), F.lit(None).cast("string").alias("proposed_album"),
    )
    events = spark.createDataFrame([("g", "Hills", 1), ("g", "Lakes", 2), ("g5", "Woods", 3), ("g5", None, 4)], "group_id string, value string, version long")
    laid = albums.overlay(records, events)
    assert largest(laid) < 2 * n / 16
    assert {(r.group_id, r.proposed_album) for r in laid.where("proposed_album IS NOT NULL").select("group_id", "proposed_album").distinct().collect()} == {("g", "Lakes")}
    got = {r.filename: r.target for r in export.plan(laid).collect()}
    assert len(got) == n and len(set(got.values())) == n
    assert sum(t.startswith("2020/20200101-Lakes/") for t in got.values()) == n // 2
    assert sum("-Sea/" in t for t in got.values()) == n // 4


def test_a_plan_leaves_one_table(spark):
    day = datetime.datetime(2020, 1, 1)
    i = F.col("id")
    records = spark.range(3000).select(
        F.format_string("f%05d.jpg", i).alias("filename"), F.concat(F.lit("g"), i % 700).alias("group_id"), F.lit(day).alias("first_date"),
        F.when(i % 4 > 0, "Sea").alias("album"), F.lit(None).cast("string").alias("proposed_album"),
    )
    before, folder = spark.conf.get(FREED), Path(kept.shared_folder(spark).removeprefix("file:"))
    there = {p.name for p in folder.iterdir()}
    planned = export.plan(records.repartition(5))
    tables = {p.name for p in folder.iterdir()} - there
    assert len(tables) == 1 and "running" in tables.pop()
    assert planned.select("target").distinct().count() == 3000
    assert spark.conf.get(FREED) == before


def test_what_is_shuffled_for_a_table_goes_when_it_is_written(spark, tmp_path):
    def shuffles():
        at = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().getAllFiles()
        return sum(at.apply(i).getName().endswith(".data") for i in range(at.size()))

    rows = spark.range(1000).repartition(7, "id")
    before = shuffles()
    table = kept.kept(rows, "x", str(tmp_path / "x"), free=True)
    for _ in range(50):
        if shuffles() <= before:
            break
        time.sleep(0.1)
    assert shuffles() <= before and table.count() == 1000
