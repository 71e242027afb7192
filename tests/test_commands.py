import base64
import json
import os

import numpy as np
import pytest

from shutterlake import cli
from shutterlake.operators import albums, dedupe, geocode, records, report, similarity
from shutterlake.operators.hdbscan import labels
from shutterlake.options import META_DIR, RECORD_END, EnrichOptions, ExportOptions, IngestOptions
from shutterlake.plans import commands
from shutterlake.progress import job_progress, no_progress
from shutterlake.sources import captioner, contents, listing, matrix, models, proposals, sinks


def put(path, data):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "wb") as f:
        f.write(data if isinstance(data, bytes) else json.dumps(data).encode())


@pytest.fixture
def takeout(tmp_path):
    root = str(tmp_path / "src")
    put(f"{root}/Trip/metadata.json", {})
    put(f"{root}/Trip/a.jpg", b"one")
    put(f"{root}/Trip/a.jpg.supplemental-meta.json", {"photoTakenTime": {"timestamp": "1700000000"}, "geoData": {"latitude": 48.1, "longitude": 11.5, "altitude": 500.0}})
    put(f"{root}/Photos/a.jpg", b"one")
    put(f"{root}/Photos/_MG_1.JPG", b"two")
    put(f"{root}/Photos/.hidden.mp4", b"three")
    put(f"{root}/Photos/b.avi", b"four")
    put(f"{root}/Photos/b.avi.json", b"{not json")
    put(f"{root}/Photos/note.txt", b"x")
    return root


@pytest.fixture
def reader():
    def read(paths):  # nested, so that it travels to the workers by value
        out = {}
        for p in paths:
            tags = {"SourceFile": p, "File:FileModifyDate": "2024:05:06 07:08:09"}
            if p.endswith("_MG_1.JPG"):
                tags |= {"EXIF:DateTimeOriginal": "2020:02:02 10:00:00"}
            out[os.path.normpath(p)] = tags
        return out

    return read


def test_listing_hides_nothing(spark, takeout):
    names = {os.path.basename(r.path) for r in listing.list_files(spark, takeout).collect()}
    assert {"_MG_1.JPG", ".hidden.mp4", "note.txt", "metadata.json"} <= names
    with pytest.raises(NotADirectoryError):
        listing.list_files(spark, takeout + "/nowhere")


def test_import_and_export(spark, takeout, reader, tmp_path):
    home, out = str(tmp_path / "lib"), str(tmp_path / "out")
    done = commands.ingest(spark, IngestOptions(takeout, home), reader, lambda path, tags: None)
    rows = {os.path.relpath(r.media_path, takeout): r for r in done.collect()}
    assert rows["Photos/a.jpg"].dedupe.result == "delete" and rows["Photos/a.jpg"].apply is None
    assert rows["Trip/a.jpg"].apply.result == "written" and rows["Photos/_MG_1.JPG"].apply.result == "copied"
    assert rows["Photos/b.avi"].metadata.status == "skipped"
    assert rows["Trip/a.jpg"].metadata.write_tags[0] == "SubSecDateTimeOriginal=2023:11:14 22:13:20+00:00"
    with open(os.path.join(home, META_DIR, "report.csv")) as f:
        lines = f.read().splitlines()
    assert lines[0] == "media,metadata,confidence,status,reason" and len(lines) == 6
    recs = {r.filename: r for r in contents.read_records(spark, home).collect()}
    assert len(recs) == 3
    trip = next(r for r in recs.values() if r.album == "Trip")
    assert trip.dates == ["2023-11-14T22:13:20", "2024-05-06T07:08:09"] and trip.geo.latitude == 48.1
    with open(os.path.join(home, META_DIR, trip.filename + RECORD_END)) as f:
        assert set(json.load(f)) == {"dates", "geo", "album", "group_id"}
    assert commands.check(spark, home)["ok"]
    assert commands.propose(spark, home, trip.filename, "Alps") == [trip.filename]
    with pytest.raises(ValueError):
        commands.propose(spark, home, trip.filename, "a/b")
    plan = commands.export(spark, home, out, ExportOptions(dry_run=True))
    targets = sorted(r.target for r in plan.collect())
    assert targets == ["2020/20200202-100000.jpg", "2023/20231114-Alps/20231114-221320.jpg", "2024/20240506-070809.mp4"]
    commands.export(spark, home, out)
    assert sorted(os.path.relpath(os.path.join(d, n), out) for d, _, names in os.walk(out) for n in names) == targets
    with pytest.raises(RuntimeError, match="not empty"):
        commands.export(spark, home, out)
    commands.export(spark, home, out, ExportOptions(force=True))


def test_dry_run_and_archive_write_nothing(spark, takeout, reader, tmp_path):
    done = commands.ingest(spark, IngestOptions(takeout, dry_run=True, mode="archive", skip_dedupe=True), reader)
    rows = {os.path.relpath(r.media_path, takeout): r for r in done.collect()}
    assert len(rows) == 5 and rows["Trip/a.jpg"].source.name == "Trip" and rows["Trip/a.jpg"].sidecar is None
    assert not (tmp_path / "lib").exists()


def test_enrich_caption_similar_cluster(spark, tmp_path):
    home = str(tmp_path / "lib")
    for i in range(12):
        put(f"{home}/p{i:02d}.jpg", bytes([i]))
        record = {"dates": ["2020-01-01T00:00:00"], "geo": {"latitude": 10.0, "longitude": 10.0, "altitude": None} if i else None, "album": None, "group_id": f"g{i}"}
        put(f"{home}/{META_DIR}/p{i:02d}.jpg{RECORD_END}", record)
    places = spark.createDataFrame([(1, 10.5, 10.5, "Here", None, "HH"), (2, -50.0, 100.0, "There", "T", "TT")], "place_id long, lat double, lon double, name string, admin1 string, cc string")

    def model(images):
        out = []
        for b in images:
            if b[0] == 11:
                out.append(ValueError("can't decode"))
            else:
                angle = (0 if b[0] < 6 else 1.5) + b[0] * 0.001
                out.append([float(np.cos(angle)), float(np.sin(angle))])
        return out

    found = {r.filename: r for r in commands.enrich(spark, home, places, model).collect()}
    assert tuple(found["p01.jpg"].location) == ("Here", "", "HH") and found["p00.jpg"].location is None
    assert found["p11.jpg"].embed_status == "error"
    assert contents.read_records(spark, home).where("location IS NOT NULL").count() == 11
    near = commands.similar(spark, home, f"{home}/p00.jpg", 3)
    assert [x["path"] for x in near] == ["p01.jpg", "p02.jpg", "p03.jpg"]
    groups = commands.cluster(spark, home, [f"x/p{i:02d}.jpg" for i in range(12)], 3)
    assert {tuple(map(os.path.basename, v)) for k, v in groups.items() if k != "-1"} == {tuple(f"p{i:02d}.jpg" for i in range(6)), tuple(f"p{i:02d}.jpg" for i in range(6, 11))}
    slice_ = commands.cluster_slice(spark, home, lambda r: records.dated_between(r, "2019", "2021"), 3).collect()
    assert {r.path for r in slice_} == {f"p{i:02d}.jpg" for i in range(11)}
    recs = spark.createDataFrame([("a", "old"), ("b", None), ("bad", "")], "filename string, caption string")
    told = {r.filename: r.caption for r in commands.caption(recs, lambda n: 1 / 0 if n == "bad" else n * 2).collect()}
    assert told == {"a": "old", "b": "bb", "bad": ""}


def test_geocode_by_cells_equals_the_broadcast(spark):
    r = np.random.default_rng(3)
    pts = spark.createDataFrame([(i, float(a), float(o)) for i, (a, o) in enumerate(zip(r.uniform(-89, 89, 60), r.uniform(-179, 179, 60)))], "key long, lat double, lon double")
    pls = spark.createDataFrame([(i, float(a), float(o), f"n{i}", None, "c") for i, (a, o) in enumerate(zip(r.uniform(-89, 89, 80), r.uniform(-179, 179, 80)))], "place_id long, lat double, lon double, name string, admin1 string, cc string")
    a = {x.key: x.place_id for x in geocode.nearest(pts, pls).collect()}
    b = {x.key: x.place_id for x in geocode.nearest(pts, pls, broadcast_places=10).collect()}
    assert a == b and None not in a.values()


def test_places_without_coordinates_are_no_ones_nearest(spark):
    pts = spark.createDataFrame([(1, 10.0, 10.0)], "key long, lat double, lon double")
    pls = spark.createDataFrame([(1, None, 10.0, "a", None, "c"), (2, 10.0, None, "b", None, "c"), (3, 11.0, 10.0, "d", None, "c")], "place_id long, lat double, lon double, name string, admin1 string, cc string")
    assert [geocode.nearest(pts, pls, broadcast_places=n).first().place_id for n in (10, 0)] == [3, 3]


def test_density_labels():
    r = np.random.default_rng(1)
    angles = np.concatenate([r.normal(0, 0.02, 20), r.normal(2, 0.02, 20), [1.0, -1.2]])
    got = labels(np.column_stack([np.cos(angles), np.sin(angles)]), 5)
    assert set(got[:20]) == {0} and set(got[20:40]) == {1} and got[41] == -1


def test_similar_plan_is_a_top_k(spark):
    v = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 1.0])], "path string, embedding array<float>")
    assert "TakeOrderedAndProject" in similarity.similar(v, "a", 1)._jdf.queryExecution().toString()


def test_report_precedence(spark):
    ddl = f"media_path string, sidecar struct<path:string,confidence:int>, dedupe struct<status:string,result:string,error:string>, metadata struct<status:string,error:string>, apply {sinks.APPLY}"
    rows = [("/s/a", None, ("processed", "keep", None), ("processed", None), ("processed", "written", "t", None)), ("/s/b,\"q\"", ("/s/b.json", 3), ("processed", "keep", None), ("skipped", "why"), None), ("/s/c", None, ("processed", "delete", None), None, None), ("/s/d", None, ("error", None, "io"), None, None), ("/s/e", None, ("processed", "keep", None), ("processed", None), None)]
    got = [(r.media, r.status, r.reason) for r in report.report(spark.createDataFrame(rows, ddl), "/s").collect()]
    assert got == [("a", "written", ""), ('b,"q"', "skipped", "why"), ("c", "deleted", ""), ("d", "error", "io"), ("e", "error", "Unknown state")]


def test_record_json(spark):
    rows = spark.createDataFrame([(["d"], None, None, "g", None, "cap", None)], records.RECORD_DDL)
    assert json.loads(rows.select(records.to_json().alias("j")).first().j) == {"dates": ["d"], "geo": None, "album": None, "group_id": "g", "caption": "cap"}


def test_clusters_of_any_size(spark, monkeypatch):
    r = np.random.default_rng(3)
    x = np.concatenate([c + r.normal(0, 0.05, (40, 5)) for c in r.normal(size=(6, 5))] + [r.normal(size=(60, 5))])
    rows = spark.createDataFrame([(f"p{i:03d}", v.tolist()) for i, v in enumerate(x)], "path string, embedding array<double>").repartition(3)
    whole = {q.path: q.label for q in similarity.cluster(rows).collect()}
    monkeypatch.setattr(similarity, "MOST_CLUSTERED", 100)
    monkeypatch.setattr(similarity, "BLOCK", 64)
    got = {q.path: q.label for q in similarity.cluster(rows).collect()}
    assert got == whole and len(got) == 300 and len(set(got.values())) > 4


def test_an_unreadable_record_fails(spark, tmp_path):
    home = str(tmp_path / "lib")
    put(f"{home}/a.jpg", b"x")
    put(f"{home}/{META_DIR}/a.jpg{RECORD_END}", b"\xff\xfe{}")
    with pytest.raises(Exception, match="can't be read"):
        commands.check(spark, home)
    put(f"{home}/{META_DIR}/a.jpg{RECORD_END}", b"{not json")
    with pytest.raises(Exception):
        commands.check(spark, home)
    with pytest.raises(RuntimeError, match="no records"):
        commands.check(spark, str(tmp_path))


def test_tags_are_read_in_batches(spark):
    def reader(paths):
        return {p: {"n": len(paths)} for p in paths}

    files = spark.createDataFrame([(f"/s/{i}",) for i in range(1000)], "path string").coalesce(1)
    sizes = [int(r.tags["n"]) for r in contents.read_tags(files, reader).collect()]
    assert sorted(sizes) == [488] * 488 + [512] * 512


def test_vectors_kept_as_a_matrix(spark, tmp_path):
    home = str(tmp_path / "lib")
    put(f"{home}/{META_DIR}/embeddings.paths.json", ["a", "b", "c"])
    with pytest.raises(RuntimeError, match="only one of"):
        contents.read_embeddings(spark, home)
    np.save(f"{home}/{META_DIR}/embeddings.npy", np.eye(3, dtype=np.float32))
    got = {r.path: r.embedding for r in contents.read_embeddings(spark, home).collect()}
    assert got == {"a": [1, 0, 0], "b": [0, 1, 0], "c": [0, 0, 1]}
    np.save(f"{home}/{META_DIR}/embeddings.npy", np.eye(4, dtype=np.float32))
    with pytest.raises(RuntimeError, match="4 vectors have 3 names"):
        contents.read_embeddings(spark, home)
    assert contents.read_embeddings(spark, str(tmp_path), strict=False) is None


def test_command_line(spark, tmp_path, takeout, capsys, monkeypatch):
    assert cli.main(["import", takeout], spark) == 1
    assert "is it a takeout?" in capsys.readouterr().err
    monkeypatch.setattr(contents, "missing_tools", lambda names: list(names))
    assert cli.main(["import", takeout, str(tmp_path / "x"), "--from-takeout"], spark) == 1
    assert "not installed: exiftool" in capsys.readouterr().err
    home = str(tmp_path / "lib")
    for i, caption in enumerate(("old", None)):
        put(f"{home}/p{i}.jpg", b"x")
        put(f"{home}/{META_DIR}/p{i}.jpg{RECORD_END}", {"dates": ["2020-01-01T00:00:00"], "geo": {"latitude": 10.0, "longitude": 10.0, "altitude": None}, "album": None, "group_id": f"g{i}"} | ({"caption": caption} if caption else {}))
    put(f"{home}/lone.jpg", b"x")
    assert cli.main(["caption", f"{home}/p0.jpg"], spark) == 0
    assert capsys.readouterr().out == "old\n"
    assert cli.main(["caption", f"{home}/p1.jpg", "--server", "http://127.0.0.1:1"], spark) == 1
    assert "no model server" in capsys.readouterr().err
    assert commands.caption_file(spark, home, "p1.jpg", lambda n: f"about {n}") == "about p1.jpg"
    assert commands.caption_file(spark, home, "p1.jpg", lambda n: "new", force=True) == "new"
    assert commands.caption_file(spark, home, "p1.jpg", lambda n: "", force=True) is None
    assert {r.filename: r.caption for r in contents.read_records(spark, home).collect()} == {"p0.jpg": "old", "p1.jpg": "new"}
    with open(tmp_path / "places.csv", "w") as f:
        f.write("place_id,lat,lon,name,admin1,cc\n1,10.5,10.5,Here,,HH\n")
    with open(tmp_path / "fake_embedder.py", "w") as f:
        f.write("def embed(pictures):\n    return [[1.0, 0.0] for _ in pictures]\n")
    monkeypatch.syspath_prepend(str(tmp_path))
    spark.sparkContext.addPyFile(str(tmp_path / "fake_embedder.py"))
    arguments = ["enrich", home, "--places", str(tmp_path / "places.csv"), "--embedder", "fake_embedder:embed"]
    assert cli.main([*arguments, "--dry-run"], spark) == 0
    assert contents.read_embeddings(spark, home, strict=False) is None
    assert cli.main(arguments, spark) == 0
    told = [json.loads(x) for x in capsys.readouterr().out.splitlines()]
    assert told[2] == {"records": 2, "geocoded": 2, "no_geo": 0, "images": 2, "videos": 0, "failed": 0}
    assert told[3] == {"media_without_record": 1, "record_without_media": 0, "unsupported_media": 0}
    assert cli.main(["cluster", f"{home}/p0.jpg", f"{home}/nowhere.jpg", "--min-cluster-size", "2"], spark) == 1
    assert "nowhere.jpg has no vector" in capsys.readouterr().err
    assert cli.main(["propose", f"{home}/p0.jpg", "Trip"], spark) == 0
    assert capsys.readouterr().out == "Trip: 1 files\np0.jpg\n"
    assert cli.main(["check", home], spark) == 0
    assert json.loads(capsys.readouterr().out)["ok"]
    assert cli.main(["export", home, "--to", str(tmp_path / "out"), "--dry-run"], spark) == 0
    assert capsys.readouterr().out.splitlines()[-1] == '{"operations": 2}'


def test_model_names():
    assert captioner.has_model(["llava:7b", "x"], "llava") and captioner.has_model(["llava:7b"], "llava:7b")
    assert not captioner.has_model(["llava:7b"], "7b") and not captioner.has_model([], "x")


def test_describer_asks_for_scaled_pictures(tmp_path, monkeypatch):
    put(str(tmp_path / "a.jpg"), b"picture")
    sent = []

    def request(url, body, timeout):
        sent.append(body)
        return {"message": {"content": "  a cat \n"}}

    monkeypatch.setattr(captioner, "_request", request)
    describe = captioner.describer(str(tmp_path), payload=lambda data, edge, quality: data + b"%d" % edge)
    assert describe("a.jpg") == "a cat"
    assert base64.b64decode(sent[0]["messages"][0]["images"][0]) == b"picture768"
    with pytest.raises(RuntimeError):
        describe("a.txt")


def test_a_group_with_an_undated_member_fails(spark):
    rows = spark.createDataFrame([("g", 1), ("g", None)], "group_id string, first_date int")
    with pytest.raises(Exception, match="without a date"):
        albums.min_dates(rows).collect()


def test_a_file_that_was_not_resolved_fails(spark):
    rows = spark.createDataFrame([(None, "processed", None), (None, "error", None)], "hash string, status string, result string")
    with pytest.raises(Exception, match="not resolved"):
        dedupe.assured(rows).collect()
    assert dedupe.assured(rows.where("status = 'error'")).count() == 1


def test_progress_names_the_jobs(spark):
    with job_progress(spark)("Copying", 3) as tick:
        assert spark.sparkContext.getLocalProperty("spark.job.description") == "Copying"
        tick(2)
        assert spark.sparkContext.getLocalProperty("spark.job.description") == "Copying (2 of 3)"
    assert spark.sparkContext.getLocalProperty("spark.job.description") is None
    with no_progress("x", 1) as tick:
        tick(1)


def test_few_places_are_met_without_a_shuffle(spark):
    pts = spark.createDataFrame([(1, 10.0, 10.0), (2, None, 1.0)], "key long, lat double, lon double")
    pls = spark.createDataFrame([(5, 11.0, 10.0, "d", None, "c"), (4, 11.0, 10.0, "e", "r", "c")], "place_id long, lat double, lon double, name string, admin1 string, cc string")
    found = geocode.nearest(pts, pls)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan
    assert [(r.key, r.place_id, r.location and tuple(r.location)) for r in found.orderBy("key").collect()] == [(1, 4, ("e", "r", "c")), (2, None, None)]
    assert geocode.nearest(pts, pls.limit(0)).where("location IS NULL AND place_id IS NULL").count() == 2


def test_half_the_points_at_one_home(spark):
    r = np.random.default_rng(5)
    home = [(i, 48.1 + x, 11.5 + y) for i, (x, y) in enumerate(r.normal(0, 0.001, (8000, 2)).tolist())]
    away = [(8000 + i, float(a), float(o)) for i, (a, o) in enumerate(zip(r.uniform(-89, 89, 8000), r.uniform(-179, 179, 8000)))] + [(20_000, -48.1, -168.5)]
    near = [(i, 48.1 + x, 11.5 + y) for i, (x, y) in enumerate(r.normal(0, 0.5, (300, 2)).tolist())] + [(300 + i, float(a), float(o)) for i, (a, o) in enumerate(zip(r.uniform(0, 80, 300), r.uniform(-20, 60, 300)))]
    pts = spark.createDataFrame(home + away, "key long, lat double, lon double").repartition(8)
    pls = spark.createDataFrame([(*p, f"n{p[0]}", None, "c") for p in near], "place_id long, lat double, lon double, name string, admin1 string, cc string")
    many = geocode.nearest(pts, pls, broadcast_places=20)
    assert {x.key: x.place_id for x in many.collect()} == {x.key: x.place_id for x in geocode.nearest(pts, pls).collect()}


def test_a_matrix_is_read_by_ranges_of_both_files(spark, tmp_path):
    rng = np.random.default_rng(1)
    names = [f'n{i} "quoted\\ é日 ]' + "x" * int(n) for i, n in enumerate(rng.integers(0, 40, 1000))]
    x = rng.normal(size=(1000, 3)).astype(np.float32)
    np.save(tmp_path / "m.npy", x)
    for k, text in enumerate((json.dumps(names), json.dumps(names, indent=2, ensure_ascii=False))):
        (tmp_path / f"n{k}.json").write_text(text)
        offsets, n = matrix.name_offsets(str(tmp_path / f"n{k}.json"), 512, piece=100)
        assert n == 1000 and len(offsets) == 2
        df = matrix.read_matrix(spark, str(tmp_path / "m.npy"), str(tmp_path / f"n{k}.json"), 512)
        assert df.rdd.getNumPartitions() == 2 and sorted(df.rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect()) == [488, 512]
        assert {r.path: r.embedding for r in df.collect()} == {p: v.tolist() for p, v in zip(names, x)}
    (tmp_path / "few.json").write_text('["a"]')
    with pytest.raises(RuntimeError, match="1000 vectors have 1 names"):
        matrix.read_matrix(spark, str(tmp_path / "m.npy"), str(tmp_path / "few.json"))


def test_a_model_is_made_once_for_each_worker(spark, tmp_path):
    home, log = str(tmp_path / "lib"), str(tmp_path / "made")
    for i in range(60):
        put(f"{home}/p{i:02d}.jpg", bytes([i]))

    def make():
        with open(log, "a") as f:
            f.write(f"{os.getpid()}\n")

        def model(images):
            if any(b[0] == 33 for b in images):
                raise ValueError("can't decode")
            return [[float(b[0]), 1.0] for b in images]

        return model

    files = spark.createDataFrame([(f"p{i:02d}.jpg",) for i in range(60)], "filename string").repartition(12)
    found = {r.filename: r for r in commands.embed(spark, home, files, models.PerWorker(make), EnrichOptions(image_batch=4)).collect()}
    workers = open(log).read().split()
    assert len(workers) == len(set(workers)) <= spark.sparkContext.defaultParallelism
    assert [n for n, r in found.items() if r.status == "error"] == ["p33.jpg"] and "can't decode" in found["p33.jpg"].error
    assert found["p34.jpg"].embedding == [34.0, 1.0]


def test_proposals_are_a_log(spark, tmp_path, monkeypatch):
    home = str(tmp_path / "lib")
    for i in range(4):
        put(f"{home}/p{i}.jpg", b"x")
        put(f"{home}/{META_DIR}/p{i}.jpg{RECORD_END}", {"dates": ["2020-01-01T00:00:00"], "geo": None, "album": None, "group_id": f"g{i // 2}", "proposed_album": "Old" if i < 2 else None})
    before = {n: os.stat(f"{home}/{META_DIR}/{n}").st_mtime_ns for n in os.listdir(f"{home}/{META_DIR}") if n.endswith(RECORD_END)}
    say = lambda: {r.filename: r.proposed_album for r in proposals.records(spark, home).collect()}
    assert say() == {"p0.jpg": "Old", "p1.jpg": "Old", "p2.jpg": None, "p3.jpg": None}
    assert commands.propose(spark, home, "p0.jpg", "One") == ["p0.jpg", "p1.jpg"]
    commands.propose(spark, home, "p1.jpg", "Two")
    commands.propose(spark, home, "p2.jpg", "Three")
    assert say() == {"p0.jpg": "Two", "p1.jpg": "Two", "p2.jpg": "Three", "p3.jpg": "Three"}
    planned = commands.export(spark, home, str(tmp_path / "out"), ExportOptions(dry_run=True))
    assert sorted(r.target.split("/")[1] for r in planned.collect()) == ["20200101-Three"] * 2 + ["20200101-Two"] * 2
    monkeypatch.setattr(proposals, "MOST_FILES", 3)
    commands.propose(spark, home, "p0.jpg", None)
    assert say() == {"p0.jpg": None, "p1.jpg": None, "p2.jpg": "Three", "p3.jpg": "Three"}
    assert proposals.log(spark, home).count() == 2
    with pytest.raises(ValueError):
        commands.propose(spark, home, "p0.jpg", "a/b")
    assert {n: os.stat(f"{home}/{META_DIR}/{n}").st_mtime_ns for n in before} == before
