import datetime
import random
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from shutterlake.operators import export, heuristics, metric, prefixes, similarity
from shutterlake.progress import ticking


def test_prefixes_of_any_length_by_one_pass(spark):
    rng = random.Random(4)
    names = {(d, "".join(rng.choice("ab") for _ in range(rng.randrange(12)))): rng.choice([1, 2, 3]) for d in ("x", "y") for _ in range(150)}
    names |= {("x", "a" * n): 1 + n % 2 for n in range(40)} | {("z", ""): 1, ("z", "é" * 300): 2, ("z", "é" * 299 + "日"): 2}
    expected = {(d, long, short) for (d, long), a in names.items() for (e, short), b in names.items() if d == e and long != short and long.startswith(short) and a | b == 3}
    rows = spark.createDataFrame([(d, n, s) for (d, n), s in names.items()], "dir string, name string, sides int")
    for parts in (1, 7, 40):
        got = [tuple(r) for r in prefixes.prefix_pairs(rows.repartition(3), ["dir"], parts).select("dir", "long", "short").collect()]
        assert len(got) == len(set(got)) and set(got) == expected
    pairs = prefixes.prefix_pairs(rows, ["dir"], 7)
    # What is shuffled are the names, and for each range a few that run on into it.
    assert spark.read.parquet(pairs._kept_path).count() == len(names)


def exact(rows, queries, k):
    out = {}
    for q, v in queries:
        scored = sorted(((-float(np.dot(v, x)), p) for p, x in rows if p != q))[:k]
        out[q] = [p for _, p in scored]
    return out


@pytest.mark.parametrize("kind", ["clusters", "random", "lengths", "equal"])
def test_nearest_by_zones_equals_all_pairs(spark, kind):
    rng = np.random.default_rng(2)
    if kind == "clusters":
        x = np.concatenate([c + rng.normal(0, 0.05, (100, 8)) for c in rng.normal(size=(12, 8))])
    elif kind == "lengths":
        x = rng.normal(size=(600, 8)) * rng.choice([0.0, 0.1, 1, 30], (600, 1))
    elif kind == "equal":
        x = np.repeat(rng.normal(size=(3, 8)), 100, axis=0)
    else:
        x = rng.normal(size=(600, 8))
    if kind != "lengths":
        x /= np.sqrt((x * x).sum(axis=1, keepdims=True))
    rows = [(f"p{i:04d}", v.tolist()) for i, v in enumerate(x)]
    df = spark.createDataFrame([*rows, ("none", None)], "path string, embedding array<double>").repartition(3)
    asked = rows[::20]
    with ticking(spark, lambda n: None) as count:
        got = metric.nearest(df, spark.createDataFrame([*asked, ("none", None)], "path string, embedding array<double>"), 5, pivots=32, count=count).collect()
    found = {}
    for r in sorted(got, key=lambda r: r.rank):
        found.setdefault(r.query, []).append(r.path)
    if kind == "equal":  # ties within rounding: the scores count
        score = {(r.query, r.rank): r.score for r in got}
        assert all(abs(score[q, i + 1] - float(np.dot(v, dict(rows)[p]))) < 1e-9 for q, v in asked for i, p in enumerate(exact(rows, asked, 5)[q]))
    else:
        assert found == exact(rows, asked, 5)
    pairs = len(asked) * len(rows)
    assert count.value <= 1.02 * pairs
    if kind == "clusters":
        assert count.value < 0.4 * pairs  # most pairs are never compared


def test_nearest_has_no_cross_join(spark):
    df = spark.createDataFrame([(f"p{i}", [float(i), 1.0]) for i in range(30)], "path string, embedding array<float>")
    plan = similarity.similar_batch(df, df, 3)._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan
    assert similarity.similar_batch(df.limit(0), df, 3).collect() == []
    assert len(similarity.similar_batch(df, df, 50).collect()) == 30 * 29


def test_a_path_that_all_claim(spark):
    day = datetime.datetime(2020, 5, 6, 7, 8, 9)
    rows = spark.range(0, 6000).select(F.format_string("f%05d.jpg", F.col("id")).alias("filename"), F.format_string("g%05d", F.col("id")).alias("group_id"), F.lit(day).alias("first_date"), F.lit(None).cast("string").alias("album"), F.lit(None).cast("string").alias("proposed_album"))
    planned = export.plan(rows.repartition(5))
    got = {r.filename: r.target for r in planned.collect()}
    assert all(got[f"f{i:05d}.jpg"] == f"2020/20200506-070809{f'-{i}' if i else ''}.jpg" for i in range(6000))
    tasks = [r["count"] for r in spark.read.parquet(planned._kept_path).groupBy("__task").count().collect()] if hasattr(planned, "_kept_path") else None
    assert tasks is None or max(tasks) < 6000


def test_a_cover_of_aligned_intervals(spark):
    rng = random.Random(1)
    ranges = [(a, a + rng.randrange(0, 60_000)) for a in (rng.randrange(-40_000, 40_000) for _ in range(200))] + [(0, 0), (-1, 1), (-4, 8), (5, 6), (-(1 << 20), 1 << 20)]
    df = spark.createDataFrame(ranges, "a int, e int").select("a", "e", heuristics.aligned_cover(F.col("a"), F.col("e")).alias("c"))
    for r in df.collect():
        spans = sorted((x.block << x.level, (x.block + 1) << x.level) for x in r.c)
        assert sum(b - a for a, b in spans) == r.e - r.a and all(p[1] == q[0] for p, q in zip(spans, spans[1:]))
        assert not spans or (spans[0][0], spans[-1][1]) == (r.a, r.e)
        assert len(spans) <= 2 * max(1, (r.e - r.a).bit_length())


def test_long_trips(spark):
    t = datetime.datetime
    trips = spark.createDataFrame([(1, t(1950, 1, 1), t(2050, 1, 1)), (2, t(2020, 5, 1, 12), t(2020, 5, 1, 13)), (3, t(2020, 5, 2), t(2020, 5, 1)), (4, None, t(2020, 1, 1)), (5, t(1969, 12, 30), t(1970, 1, 2))], "trip_id int, starts timestamp, ends timestamp")
    rows = spark.createDataFrame([(1, t(1950, 1, 1)), (2, t(2050, 1, 1)), (3, t(2050, 1, 1, 0, 0, 1)), (4, t(2020, 5, 1, 12)), (5, t(2020, 5, 1, 13, 0, 1)), (6, t(1969, 12, 31)), (7, None)], "id int, ts timestamp")
    got = sorted((r.id, r.trip_id) for r in heuristics.in_trips(rows, trips).collect())
    assert got == [(1, 1), (2, 1), (4, 1), (4, 2), (5, 1), (6, 1), (6, 5)]
    cover = F.when(F.col("starts") <= F.col("ends"), heuristics.aligned_cover(F.unix_date(F.to_date("starts")), F.unix_date(F.to_date("ends")) + 1))
    assert trips.where("trip_id = 1").select(F.size(cover).alias("n")).first().n < 40
    assert heuristics.in_trips(rows, trips.limit(0)).collect() == []


@pytest.mark.parametrize("kind", ["timestamp", "timestamp_ntz"])
def test_trips_of_equal_times_in_tiles(spark, monkeypatch, kind):
    rng = random.Random(8)
    t = lambda n: datetime.datetime(2024, 1, 1) + datetime.timedelta(microseconds=n * 3_600_000_000 // 7)
    spans = [(a, a + rng.randrange(-3, 400)) for a in (rng.randrange(0, 900) for _ in range(25))] + [(5, 5), (-9_000, 90_000)]
    trips = [(i, *rng.choice(spans), rng.choice([None, "x", "yé"])) for i in range(300)]
    rows = [(i, rng.choice([None, "", "ab"]), rng.choice([0, 5, 5, rng.randrange(-50, 1_400)])) for i in range(700)] + [(700, "z", None)]
    expected = sorted((i, i_name or "-", k, k_name or "-") for i, i_name, n in rows for k, a, e, k_name in trips if n is not None and a <= n <= e)
    df = spark.createDataFrame([(i, name, None if n is None else t(n)) for i, name, n in rows], f"id int, name string, ts {kind}").repartition(3)
    of = spark.createDataFrame([(k, t(a), t(e), name) for k, a, e, name in trips], f"trip_id int, starts {kind}, ends {kind}, place string").repartition(2)
    for run_rows, run_trips, size in ((1024, 256, 8 << 20), (7, 2, 300), (50, 3, 4_000)):
        monkeypatch.setattr(heuristics, "RUN_ROWS", run_rows)
        monkeypatch.setattr(heuristics, "RUN_TRIPS", run_trips)
        monkeypatch.setattr(heuristics, "PAIR_BYTES", size)
        # Beyond what is sent, trips are met by days.
        for sent in (300, 10) if run_rows == 1024 else (300,):
            met = heuristics.in_trips(df, of, sent)
            assert met.columns == ["id", "name", "ts", "trip_id", "starts", "ends", "place"]
            got = met.collect()
            assert sorted((r.id, r.name or "-", r.trip_id, r.place or "-") for r in got) == expected
            assert all(r.starts <= r.ts <= r.ends for r in got)


def test_pairs_with_trips_fill_little_disk(spark, tmp_path):
    t = F.timestamp_seconds
    rows = spark.range(400).select("id", t(1_704_067_200 + F.col("id") * 60).alias("ts"))
    start = 1_704_067_200 + F.col("id") % 4 * 60
    trips = spark.range(24_000).select(F.col("id").alias("trip_id"), t(start).alias("starts"), t(start + 30_000).alias("ends"))
    met = heuristics.in_trips(rows, trips)
    met.select("id", "trip_id").write.parquet(f"{tmp_path}/out")
    out = spark.read.parquet(f"{tmp_path}/out")
    assert out.count() == sum(6_000 for i in range(400) for k in range(4) if i >= k)
    # The trips of one row alone fill a page of a file: by rows, each pair would need its trip's number.
    assert sum(p.stat().st_size for p in (tmp_path / "out").glob("*.parquet")) < 0.3 * out.count()
    # One day is dealt to several tasks.
    assert out.groupBy(F.input_file_name()).count().count() > 1


def test_pairs_at_few_of_the_times_are_dealt_to_all_tasks(spark):
    second = 1_704_067_200
    t = lambda c: F.timestamp_micros(c)
    # 400 of 40,400 rows are in trips, each of times of its own.
    rows = spark.range(40_400).select("id", F.timestamp_seconds(second + F.when(F.col("id") < 400, F.col("id") * 60).otherwise(F.col("id") * 3_600)).alias("ts"))
    start = second * 1_000_000 + F.col("id") * 100_000
    trips = spark.range(24_000).select(F.col("id").alias("trip_id"), t(start).alias("starts"), t(start + 30_000_000_000).alias("ends"))
    got = heuristics.in_trips(rows, trips).groupBy(F.spark_partition_id()).agg(F.count(F.lit(1)).alias("n"), F.sum("id").alias("ids"), F.sum("trip_id").alias("trip_ids")).collect()
    at, of = np.arange(400) * 60_000_000, np.arange(24_000)
    held = [of[(of * 100_000 <= a) & (a <= of * 100_000 + 30_000_000_000)] for a in at.tolist()]
    assert sum(r.n for r in got) == sum(map(len, held))
    assert sum(r.ids for r in got) == sum(i * len(h) for i, h in enumerate(held))
    assert sum(r.trip_ids for r in got) == sum(int(h.sum()) for h in held)
    assert len(got) == 4 and max(r.n for r in got) < 0.5 * sum(r.n for r in got)


def test_pairs_leave_python_as_lists(spark):
    t = pa.array(np.arange(2_000) * 1_000_000, pa.timestamp("us"))
    trips = pa.table({"trip_id": np.arange(5_000), "__starts": pa.array(np.zeros(5_000, int), t.type), "__ends": pa.array(np.full(5_000, 1_500_000_000), t.type)})
    rows = pa.RecordBatch.from_arrays([pa.array(np.arange(2_000)), t], names=["id", "__at"])
    out = list(heuristics._tiles(SimpleNamespace(value=trips), ["id"], ["trip_id"], ["ids", "trip_ids"])([rows]))
    tiles = [(a, b) for batch in out for a, b in zip(batch["ids"].to_pylist(), batch["trip_ids"].to_pylist(), strict=True)]
    pairs = np.zeros((2_000, 5_000), int)
    for a, b in tiles:
        pairs[np.ix_(a, b)] += 1
    assert (pairs[:1_501] == 1).all() and not pairs[1_501:].any()
    assert sum(batch.nbytes for batch in out) < 0.2 * pairs.sum()
    # Spark holds the pairs of a tile.
    assert max(len(a) * len(b) for a, b in tiles) * 16 <= heuristics.PAIR_BYTES


def test_means_are_added_up_where_they_are_read(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(500, 6))
    rows = [(None if i % 11 == 0 else f"k{i % 7}" if i % 3 else "hot", v.tolist()) for i, v in enumerate(x)]
    df = spark.createDataFrame([*rows, ("lone", None), ("zero", [0.0] * 6)], "key string, embedding array<float>").repartition(4)
    means = similarity.mean_vectors(df, "key")
    plan = means._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan
    got = {r.key: r.embedding for r in means.collect()}
    assert set(got) == {k for k, _ in rows} | {"zero"} and got["zero"] == [0.0] * 6
    for key in {k for k, _ in rows}:
        m = np.mean([v for k, v in rows if k == key], axis=0)
        assert np.allclose(got[key], m / np.linalg.norm(m), atol=1e-6)


def test_a_gap_is_told_to_the_microsecond(spark):
    t = datetime.datetime(2024, 1, 1)
    late = [datetime.timedelta(hours=48), datetime.timedelta(hours=48, microseconds=1), datetime.timedelta(hours=48, microseconds=999_999)]
    rows = spark.createDataFrame([(i, x) for i, d in enumerate(late) for x in (t, t + d)], "key int, ts timestamp_ntz")
    got = heuristics.events(rows, "key", "ts").groupBy("key").agg(F.max("event").alias("event")).collect()
    assert {r.key: r.event for r in got} == {0: 0, 1: 1, 2: 1}


def shuffled(spark):
    """Bytes that the session's stages have written for shuffles so far."""
    context = spark.sparkContext
    context._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    none = context._gateway.new_array(context._jvm.double, 0)
    stages = context._jsc.sc().statusStore().stageList(None, False, False, none, None)
    return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))


def test_vectors_travel_once_for_each_part(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(4000, 16)).astype(np.float32)
    rows = [(f"p{i:05d}", v.tolist()) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "path string, embedding array<float>").repartition(2).persist()
    assert df.count() == len(rows)
    before = shuffled(spark)
    got = metric.nearest(df, df, 3).collect()
    # All queries meet nearly all zones here; no zone is sent a copy of their vectors.
    assert len(got) == 3 * len(rows) and shuffled(spark) - before < 5 * x.nbytes
    df.unpersist()


def test_parts_of_rows_meet_groups_of_queries(spark, monkeypatch):
    for name, value in (("PART_ROWS", 100), ("GROUP_QUERIES", 13), ("LEAST_ROWS", 50), ("ROW_BLOCK", 16), ("QUERY_BLOCK", 8)):
        monkeypatch.setattr(metric, name, value)
    rng = np.random.default_rng(6)
    x = np.concatenate([rng.normal(size=(500, 6)), np.repeat(rng.integers(-2, 3, (3, 6)), 60, axis=0)])
    rows = [(f"p{i:04d}", v.tolist()) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "path string, embedding array<double>").repartition(3)
    asked = rows[::17]
    found = {}
    for r in sorted(metric.nearest(df, spark.createDataFrame(asked, df.schema), 4).collect(), key=lambda r: r.rank):
        found.setdefault(r.query, []).append(r.score)
    for q, v in asked:
        assert np.allclose(found[q], sorted((float(np.dot(v, y)) for p, y in rows if p != q), reverse=True)[:4])
