import hashlib
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from shutterlake import cli
from shutterlake.operators import running
from shutterlake.options import META_DIR, RECORD_END, IngestOptions
from shutterlake.plans import commands
from shutterlake.progress import ticking
from shutterlake.sources import contents, listing, sinks


def put(path, data=b"x"):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "wb") as f:
        f.write(data)


def tree(root):
    return {os.path.relpath(os.path.join(d, n), root): open(os.path.join(d, n), "rb").read() for d, _, names in os.walk(root) for n in names}


def numbered_tasks(df):
    return df.withColumn("task", F.spark_partition_id())


@pytest.mark.parametrize("parts", [1, 9])
@pytest.mark.parametrize("by", [[], ["k"], ["k", "s"]])
def test_running_sums(spark, by, parts):
    rng = np.random.default_rng(1)
    rows = [(None if k == 7 else int(k), "hot" if s else None, i, int(v)) for i, (k, s, v) in enumerate(zip(np.minimum(rng.integers(0, 30, 900), 8), rng.integers(0, 2, 900), rng.integers(0, 50, 900)))]
    got = running.running(spark.createDataFrame(rows, "k int, s string, i int, v long").repartition(5), by, ["i"], "n", F.col("v"), parts).collect()
    sums, expected = {}, set()
    for k, s, i, v in rows:
        key = (k, s)[: len(by)]
        expected.add((i, sums.get(key, 0)))
        sums[key] = sums.get(key, 0) + v
    assert {(r.i, r.n) for r in got} == expected and len(got) == 900
    ranks = running.running(spark.createDataFrame(rows, "k int, s string, i int, v long"), by, ["v"], "n", parts=parts).groupBy(*by).agg(F.count(F.lit(1)).alias("c"), F.collect_set("n").alias("all")).collect()
    assert all(sorted(r.all) == list(range(r.c)) for r in ranks)
    assert running.running(spark.createDataFrame([], "k int, s string, i int, v long"), by, ["i"], "n").collect() == []


def test_a_hot_key_is_no_single_tasks_work(spark):
    rows = spark.range(0, 20_000).withColumn("k", F.lit("one"))
    got = running.running(rows, ["k"], ["id"], "n", parts=8)
    assert got.where("n = id").count() == 20_000
    counted = spark.read.parquet(got._kept_path).groupBy("__task").count().collect()
    assert len(counted) == 8 and max(r["count"] for r in counted) < 2 * 20_000 / 8


def test_one_top_folder_is_listed_and_hashed_by_all_cores(spark, tmp_path):
    cores = spark.sparkContext.defaultParallelism
    root = str(tmp_path / "src")
    for i in range(40):
        put(f"{root}/Takeout/p{i:02d}.jpg", bytes([i]) * (1000 + 700 * (i % 5)))
    for i in range(30):
        put(f"{root}/Takeout/a/b/c{i % 3}/_q{i}.mp4", b"z" * 500)
    os.makedirs(f"{root}/Takeout/empty")
    os.symlink(f"{root}/Takeout/a", f"{root}/Takeout/loop")
    os.symlink(f"{root}/nowhere", f"{root}/Takeout/dangling.jpg")
    files = listing.list_files(spark, root)
    assert sorted(os.path.relpath(r.path, root) for r in files.collect()) == sorted([*tree_names(root)])
    sizes = {r.path: r.size for r in files.collect()}
    assert sizes[f"{root}/Takeout/p01.jpg"] == 1700 and sizes[f"{root}/Takeout/dangling.jpg"] is None
    level = spark.read.parquet(files._kept_path + "/level=1").where("entries IS NULL")
    assert level.select(F.input_file_name()).distinct().count() >= cores
    dealt = contents.dealt_by_bytes(files)
    load = [r.b for r in numbered_tasks(dealt).groupBy("task").agg(F.sum("size").alias("b")).collect()]
    assert len(load) >= cores and max(load) <= 2 * sum(load) / len(load)
    got = {r.path: (r.hash, r.status) for r in contents.hash_files(dealt).collect()}
    assert len(got) == 71 and got[f"{root}/Takeout/dangling.jpg"] == (None, "error")
    assert got[f"{root}/Takeout/p03.jpg"][0] == hashlib.sha256(bytes([3]) * 3100).hexdigest()
    flat = listing.list_files(spark, f"{root}/Takeout/a/b", flat=True)
    assert flat.collect() == [] and listing.list_files(spark, f"{root}/Takeout/empty").collect() == []


def tree_names(root):
    for d, _, names in os.walk(root):
        for n in names:
            yield os.path.relpath(os.path.join(d, n), root)


@pytest.fixture
def source(tmp_path):
    root = str(tmp_path / "src")
    for i in range(24):
        put(f"{root}/Takeout/Trip {i % 3}/p{i:02d}.jpg", b"same" if i in (4, 5) else bytes([i]) * 50)
        put(f"{root}/Takeout/Trip {i % 3}/p{i:02d}.jpg.json", b'{"photoTakenTime": {"timestamp": "17000000%02d"}}' % i)
    return root


def counting(folder, fail=None):
    """A reader and a writer that leave a line for each file that they are asked for."""

    def reader(paths):
        for p in paths:
            with open(os.path.join(folder, os.path.basename(p) + ".read"), "a") as f:
                f.write("x")
        return {os.path.normpath(p): {"SourceFile": p} for p in paths}

    def writer(path, tags):
        with open(path, "ab") as f:
            f.write(tags[0].encode())
        if fail == "row" and b"\x07" in open(path, "rb").read():
            raise RuntimeError("no tags for this one")
        if fail == "task" and b"\x07" in open(path, "rb").read():
            os._exit(1)

    return reader, writer


def test_each_file_is_read_once(spark, source, tmp_path):
    log, home = str(tmp_path / "log"), str(tmp_path / "lib")
    os.makedirs(log)
    ticks = []

    def progress(label, total):
        import contextlib

        @contextlib.contextmanager
        def step():
            yield lambda done: ticks.append((label, done, total))

        return step()

    planned = commands.ingest_plan(spark, IngestOptions(source, home), counting(log)[0], progress)
    done = commands.apply_import(planned, IngestOptions(source, home), counting(log, "row")[1], progress)
    rows = {os.path.basename(r.media_path): r for r in done.collect()}
    links, lone = (s.first().asDict() for s in planned.link_counts())
    assert links == {"confidence_3": 24, "confidence_2": 0, "confidence_1": 0, "unmatched": 0} and not any(lone.values())
    assert {n: open(os.path.join(log, n)).read() for n in os.listdir(log)} == {f"p{i:02d}.jpg.read": "x" for i in range(24)}
    assert rows["p07.jpg"].apply.status == "error" and rows["p07.jpg"].apply.error == "no tags for this one" and rows["p08.jpg"].apply.result == "written"
    names = set(tree_names(home))
    assert len([n for n in names if n.endswith(".jpg")]) == 23 and len([n for n in names if n.endswith(RECORD_END)]) == 23
    assert len(names) == 47  # and the report
    assert {t[0] for t in ticks} == {"Hashing", "Tags", "Copying"} and ("Copying", 24, 24) in ticks and ("Hashing", 24, 24) in ticks
    with open(f"{home}/{META_DIR}/report.csv") as f:
        assert sum("no tags" in line for line in f) == 1


def test_an_import_is_whole_or_not_there(spark, source, tmp_path):
    log, home, again = str(tmp_path / "log"), str(tmp_path / "lib"), str(tmp_path / "again")
    os.makedirs(log)
    options = IngestOptions(source, home)
    planned = commands.ingest_plan(spark, options, counting(log)[0])
    commands.apply_import(planned, options, counting(log)[1])
    whole = tree(home)
    # A task that is lost before the mark takes everything back.
    with pytest.raises(Exception):
        commands.apply_import(planned, IngestOptions(source, again), counting(log, "task")[1])
    assert list(tree_names(again)) == []
    commands.apply_import(planned, IngestOptions(source, again), counting(log)[1])
    assert tree(again) == whole
    # What was marked as made is ended by the next import; what wasn't goes.
    staging = f"{again}/{META_DIR}/{sinks.STAGING}"
    moved = next(n for n in whole if n.endswith(".jpg"))
    os.makedirs(staging)
    os.replace(f"{again}/{moved}", f"{staging}/{moved}")
    put(f"{staging}/open-17-other.jpg")
    put(f"{staging}/{sinks.MADE}")
    sinks.recover(spark, again)
    assert tree(again) == whole
    put(f"{staging}/{moved}", b"half")
    sinks.recover(spark, again)
    assert tree(again) == whole and not os.path.exists(staging)


def test_ticks_rise_while_a_step_runs(spark):
    seen = []

    def stage(batches):
        import time

        for b in batches:
            time.sleep(0.3)
            count.add(len(b))
            yield b

    with ticking(spark, seen.append, every=0.1) as count:
        spark.range(0, 64, 1, 16).mapInArrow(stage, "id long").count()
        before_the_end = len(seen)
    assert before_the_end > 1 and seen == sorted(set(seen)) and seen[-1] == 64


def test_all_errors_are_told(spark, tmp_path, monkeypatch, capsys):
    root = str(tmp_path / "src")
    for i in range(130):
        put(f"{root}/p{i:03d}.jpg", b"%d" % i)
    monkeypatch.setattr(contents, "missing_tools", lambda names: [])
    monkeypatch.setattr(contents, "exiftool_reader", lambda tags: lambda paths: {})
    assert cli.main(["import", root, str(tmp_path / "lib"), "--archive"], spark) == 0
    told = capsys.readouterr()
    assert sum("\tReconcile\t" in line for line in told.out.splitlines()) == 130
    assert "Hashing 130 of 130" in told.err
