from pyspark.sql import functions as F

from shutterlake.operators import albums, records, similarity


def test_clusters_are_numbered_each_on_its_own(spark):
    rows = [("b", 0), ("a", 0), ("a", 0), ("z", -1), ("c", 1), ("y", None), ("x", None), *((f"n{k:04d}", 7) for k in range(2000))]
    found = similarity.member_listing(spark.createDataFrame(rows, "path string, label int")).collect()
    by_label = {}
    for r in sorted(found, key=lambda r: r.place):
        by_label.setdefault(r.label, []).append((r.place, r.path))
    assert by_label.pop(7) == [(k, f"n{k:04d}") for k in range(2000)]
    assert by_label == {0: [(0, "a"), (1, "a"), (2, "b")], -1: [(0, "z")], 1: [(0, "c")], None: [(0, "x"), (1, "y")]}


def test_listings_of_empty_tables(spark):
    assert similarity.member_listing(spark.createDataFrame([], "path string, label int")).collect() == []
    assert records.sibling_listing(spark.createDataFrame([], "group_id string, filename string"), F.lit(True)).collect() == []


def test_siblings_leave_out_records_without_a_group(spark):
    rows = spark.createDataFrame([("g", "b"), ("g", "a"), (None, "a"), ("h", "c")], "group_id string, filename string")
    found = records.sibling_listing(rows, F.col("filename") == "a").collect()
    assert sorted((r.group_id, r.filename, r.place) for r in found) == [("g", "a", 0), ("g", "b", 1)]
    assert [r.filename for r in albums.without_group(rows).collect()] == ["a"]
