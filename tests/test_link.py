import random

import pytest
from pyspark.sql import functions as F

from shutterlake.operators import link

LONG = "a_rather_long_file_name_of_41_characters_x"


def best(spark, media, sides, **how):
    m = spark.createDataFrame([(x,) for x in media], "path string")
    s = spark.createDataFrame([(x,) for x in sides], "path string")
    return {r.path: (r.sidecar, r.score, r.confidence) for r in link.link(m, s, **how).collect()}


CASES = [
    ("/d/u.jpg", ["/d/u.jpg.suppl.json"], "/d/u.jpg.suppl.json", {}),
    ("/d/PXL_1.MP.jpg", ["/d/PXL_1.MP.jpg.supplemental-met.json"], "/d/PXL_1.MP.jpg.supplemental-met.json", {}),
    ("/d/c_33(4).jpg", ["/d/c_33.jpg.supplemental-metadata(4).json", "/d/c_33.jpg.json"], "/d/c_33.jpg.supplemental-metadata(4).json", {}),
    ("/d/name-000", ["/d/name-000.json"], "/d/name-000.json", {}),
    ("/d/FA79581F10E4.jpeg", ["/d/FA79581F10E4.jpeg..json"], "/d/FA79581F10E4.jpeg..json", {}),
    ("/d/C3D916AEF50.jpg", ["/d/C3D916AEF50D.jpg.suppl.json"], "/d/C3D916AEF50D.jpg.suppl.json", {"threshold": 0}),
    ("/d/IMG_0449.MP4", ["/d/IMG_0449.HEIC.supplemental-metadata(1).json"], None, {}),
    ("/d/photo-edited.jpg", ["/d/photo.jpg.json"], "/d/photo.jpg.json", {}),
    (f"/d/{LONG[:36]}-edited.jpg", [f"/d/{LONG}.json"], f"/d/{LONG}.json", {}),
    ("/d/11491078.MP", ["/d/11491078.MP.jpg.supplemental-met.json"], "/d/11491078.MP.jpg.supplemental-met.json", {}),
    ("/Photos/Vacation.jpg", ["/Photos/Vacation 2024/IMG_123.json"], None, {}),
    ("/d/IMG_0267.JPG", ["/d/IMG_0267.HEIC.json", "/d/IMG_0267.JPG.json"], "/d/IMG_0267.JPG.json", {}),
    ("/d/IMG_1234.jpg", ["/d/IMG_123.json"], None, {}),
    (f"/d/{LONG[:30]}.jpg", [f"/d/{LONG}.json"], None, {"fuzzy": False}),
    ("/d/IMAGE.JPG", ["/d/IMAGE.jpg.json"], "/d/IMAGE.jpg.json", {}),
]


@pytest.mark.parametrize("media,sides,want,how", CASES)
def test_cases(spark, media, sides, want, how):
    assert best(spark, [media], sides, **how)[media][0] == want


def test_long_prefixes_outrank_exact_names(spark):
    name = "n" * 55
    got = best(spark, [f"/d/{name}.jpg"], [f"/d/{name}.png.json", f"/d/{name}more.jpg.json"])
    assert got[f"/d/{name}.jpg"] == (f"/d/{name}more.jpg.json", 105, 2)


def model(media, sides, fuzzy, threshold):
    def score(m, s):
        if m.dir != s.dir or m.duplicate != s.duplicate:
            return 0
        if m.name == s.name:
            return 150 if m.extension == s.extension and m.extension else 100
        if (m.name + m.extension).lower() == s.name.lower():
            return 100
        long = max(len(m.name), len(s.name)) >= threshold
        if fuzzy and long and (m.name.startswith(s.name) or s.name.startswith(m.name)):
            return 50 + min(len(m.name), len(s.name))
        return 0

    out = {}
    for m in media:
        found = sorted((-score(m, s), s.path) for s in sides if score(m, s))
        out[m.path] = (found[0][1], -found[0][0]) if found else (None, None)
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_joins_equal_the_pairwise_rule(spark, seed):
    r = random.Random(seed)
    stem = lambda: r.choice(["ab", "abc", "abcd", "x" * 45, "x" * 44, "x" * 46 + "y", "", "AB"])
    ext, dup = lambda: r.choice([".jpg", ".JPG", ".mp", ""]), lambda: r.choice(["", "", "(1)", "(01)", "(2)"])
    media = sorted({f"/{r.choice('pq')}/{stem()}{dup()}{ext()}" for _ in range(60)})
    sides = sorted({f"/{r.choice('pq')}/{stem()}{ext()}{r.choice(['', '.suppl', '.s'])}{dup()}.json" for _ in range(60)})
    m = spark.createDataFrame([(x,) for x in media], "path string")
    s = spark.createDataFrame([(x,) for x in sides], "path string")
    got = {x.path: (x.sidecar, x.score) for x in link.link(m, s, threshold=40).collect()}
    assert got == model(link.parsed(m, False).collect(), link.parsed(s, True).collect(), True, 40)


def test_no_pairwise_plan(spark):
    m = spark.range(10).select(F.concat(F.lit("/d/"), F.col("id").cast("string"), F.lit(".jpg")).alias("path"))
    plan = link.link(m, m.withColumn("path", F.concat("path", F.lit(".json"))))._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
