import datetime

import pytest
from pyspark.sql import functions as F

from shutterlake.functions import albums, dates, geo, handlers, names, paths


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "x string").select(column(F.col("x")).alias("y")).first().y


@pytest.mark.parametrize("name,ext", [("a.jpg", ".jpg"), ("a.b.c", ".c"), ("a", ""), (".hidden", ""), ("..x", ""), (".h.jpg", ".jpg"), ("a.", "."), ("", ""), ("...a.b", ".b")])
def test_extension(spark, name, ext):
    assert one(spark, name, paths.extension) == ext
    assert one(spark, name, paths.stem) == name[: len(name) - len(ext)]


@pytest.mark.parametrize("path,base,folder", [("/a/b.c", "b.c", "/a"), ("/x", "x", "/"), ("x", "x", ""), ("/a/b/", "", "/a/b")])
def test_parts(spark, path, base, folder):
    assert one(spark, path, paths.basename) == base
    assert one(spark, path, paths.dirname) == folder


@pytest.mark.parametrize("path,name,dup,ext", [
    ("/d/IMG(4).JPG", "IMG", "4", ".jpg"), ("/d/x-edited.jpg", "x", None, ".jpg"), ("/d/x-edi(2).png", "x", "2", ".png"), ("/d/x-000", "x-000", None, ""), ("/d/(1).jpg", "", "1", ".jpg"), ("/d/a(007).jpg", "a", "7", ".jpg"),
])
def test_parse_media(spark, path, name, dup, ext):
    assert tuple(one(spark, path, names.parse_media)) == (name, dup, ext)


@pytest.mark.parametrize("path,name,dup,ext", [
    ("/d/a.jpg.suppl.json", "a", None, ".jpg"), ("/d/a.jpg.supplemental-metadata(4).json", "a", "4", ".jpg"), ("/d/FA7.jpeg..json", "FA7.jpeg", None, "."),
    ("/d/photo.summer.jpg.supplemental-metadata.json", "photo", None, ""), ("/d/x.jpg.s.json", "x", None, ".jpg"), ("/d/x-000.json", "x-000", None, ""), ("/d/(1).json", "", "1", ""),
])
def test_parse_sidecar(spark, path, name, dup, ext):
    assert tuple(one(spark, path, names.parse_sidecar)) == (name, dup, ext)


def test_parse_sidecar_anchored(spark):
    assert tuple(one(spark, "/d/photo.summer.jpg.supplemental-me.json", lambda c: names.parse_sidecar(c, anchored=True))) == ("photo.summer", None, ".jpg")


@pytest.mark.parametrize("text,iso", [
    ("2023:01:02 03:04:05", "2023-01-02T03:04:05"), (" 2023-01-02 03:04:05.99+01:00", "2023-01-02T03:04:05"), ("2023/01/02  03:04:05Z", "2023-01-02T03:04:05"), ("2023-01-02", None), ("x", None), ("", None), (None, None), ("0000:00:00 00:00:00", "0000-00-00T00:00:00"),
])
def test_disk_dates(spark, text, iso):
    assert one(spark, text, dates.normalize_disk_date) == iso


EXIF = {
    "0": "1970:01:01 00:00:00+00:00", "1700000000": "2023:11:14 22:13:20+00:00", "-1": "1969:12:31 23:59:59+00:00", "1719935787": "2024:07:02 15:56:27+00:00", "1710899464": "2024:03:20 01:51:04+00:00",
    "1710994697": "2024:03:21 04:18:17+00:00", "1711192947": "2024:03:23 11:22:27+00:00", "1711016650": "2024:03:21 10:24:10+00:00", "1704675601": "2024:01:08 01:00:01+00:00", "1704067200": "2024:01:01 00:00:00+00:00",
}


@pytest.mark.parametrize("text,iso", [
    ("0", "1970-01-01T00:00:00"), ("1700000000", "2023-11-14T22:13:20"), ("-1", "1969-12-31T23:59:59"), ("soon", None), ("1.5", None), (None, None), ("1719935787", "2024-07-02T15:56:27"), ("1710899464", "2024-03-20T01:51:04"),
    ("1710994697", "2024-03-21T04:18:17"), ("1711192947", "2024-03-23T11:22:27"), ("1711016650", "2024-03-21T10:24:10"), ("1704675601", "2024-01-08T01:00:01"), ("1704067200", "2024-01-01T00:00:00"),
])
def test_epochs(spark, text, iso):
    assert one(spark, text, dates.epoch_to_iso) == iso
    assert one(spark, text, dates.epoch_to_exif) == EXIF.get(text)


@pytest.mark.parametrize("text,year", [("253402300799", "9999"), ("253402300800", "10000"), ("900002700000", "30489"), ("-62135596801", "0000"), ("-30000000000", "1019"), ("-65000000000", "-90")])
def test_epochs_beyond_four_digit_years(spark, text, year):
    # As SQL's strftime writes %Y: without a sign before years over 9999.
    assert one(spark, text, dates.epoch_to_iso).startswith(f"{year}-") and one(spark, text, dates.epoch_to_exif).startswith(f"{year}:")


@pytest.mark.parametrize("text", [
    "2024-01-02", "20240102", "2024-01-02T03:04:05", "2024-01-02 03:04", "2024-01-02T03", "20240102T030405", "2024-01-02T03:04:05.25", "2024-01-02T03:04:05,123456789", "2024-01-02T03:04:05Z", "2024-01-02T03:04:05.5+02:00", "2024-01-02T03:04-0330", "2024-02-29",
    "2023-02-29", "2024-13-01", "2024-01-02T25:00:00", "2024-0102", "2024-01-02T03:0405", "2024-1-2", "x", "", "2024-01-02T", "2024-01-02T03:04:05+2", "0000-00-00T00:00:00",
])
def test_iso_forms(spark, text):
    try:
        want = datetime.datetime.fromisoformat(text).replace(tzinfo=None)
    except ValueError:
        want = None
    assert one(spark, text, dates.parse_iso) == want


def test_first_date_fails_without_one(spark):
    for value in ([], ["0000-00-00T00:00:00"]):
        with pytest.raises(Exception, match="no valid first date"):
            spark.createDataFrame([(value,)], "d array<string>").select(dates.first_date(F.col("d"))).collect()


@pytest.mark.parametrize("exif,plain,want", [((0.0, 1.0, 1.0), (2.0, 3.0, None), (2.0, 3.0, None)), ((1.0, 1.0, 5.0), (2.0, 3.0, None), (1.0, 1.0, 5.0)), ((1.0, 0.0, 5.0), None, None), (None, None, None), ((None, 1.0, 1.0), None, None)])
def test_sidecar_geo(spark, exif, plain, want):
    kind = "struct<latitude:double,longitude:double,altitude:double>"
    got = spark.createDataFrame([(exif, plain)], f"e {kind}, p {kind}").select(geo.sidecar_geo(F.col("e"), F.col("p")).alias("g")).first().g
    assert (got and tuple(got)) == want


def test_disk_geo_takes_zero(spark):
    got = spark.range(1).select(geo.disk_geo(F.lit(0), F.lit(0), F.lit(None)).alias("g"), geo.disk_geo(F.lit(0), F.lit(None), F.lit(1)).alias("h")).first()
    assert tuple(got.g) == (0.0, 0.0, None) and got.h is None


@pytest.mark.parametrize("name,ok", [("Trip", True), ("", False), ("  ", False), ("a/b", False), ("a\\b", False), ("a\x00", False), ("Éte 1", True), (" ", False)])
def test_album_names(spark, name, ok):
    assert one(spark, name, albums.valid_album_name) is ok


def test_handlers(spark):
    tags = {"EXIF:DateTimeOriginal": "2023:01:01 12:00:00", "EXIF:CreateDate": "bad", "File:FileModifyDate": "2024:01:01 00:00:00+02:00", "QuickTime:CreateDate": "2022:02:02 02:02:02", "Composite:GPSLatitude": "1.5", "Composite:GPSLongitude": "0"}
    exif, quick = handlers.REGISTRY
    rows = spark.createDataFrame([(tags,)], "t map<string,string>")
    got = rows.select(exif.dates(F.col("t")).alias("a"), quick.dates(F.col("t")).alias("b"), quick.timestamp(F.col("t")).alias("c"), exif.geo(F.col("t")).alias("g")).first()
    assert got.a == ["2023-01-01T12:00:00", "2024-01-01T00:00:00"] and got.b == ["2022-02-02T02:02:02", "2024-01-01T00:00:00"]
    assert got.c is None and tuple(got.g) == (1.5, 0.0, None)
    g = F.struct(F.lit(1.5).alias("latitude"), F.lit(2.5).alias("longitude"), F.lit(None).cast("double").alias("altitude"))
    got = spark.range(1).select(exif.write_geo(g).alias("a"), quick.write_geo(g).alias("b"), exif.write_timestamp(F.lit("x")).alias("c")).first()
    assert got.a == ["Composite:GPSLatitude=1.5", "Composite:GPSLongitude=2.5"] and got.b == ["Keys:GPSCoordinates=1.5, 2.5"] and got.c == ["SubSecDateTimeOriginal=x"]
    assert len(handlers.required_tags()) == len(set(handlers.required_tags())) == 13
