import itertools
import re

import duckdb
import pytest

from shutterlake.llm import filter_audit as A

WORDS = " ".join(f"word{k}" for k in range(210))
DOCS = [
    (1, WORDS, "en"), (2, WORDS, "en"), (None, WORDS, None), (3, None, None), (4, "", "en"), (5, "short text", "en"), (6, "short  text", "de"),
    (7, "SHOUT " * 300, "de"), (8, WORDS + " $5", "de"), (9, "the same word " * 100, "en"), (9, "the same word " * 100, "en"), (10, "short text", "fr"),
    (11, WORDS + "\t x " + "É" * 40, ""), (12, "|", "fr"), (None, None, "fr"), (13, ("Word" + "x" * 5 + "\n") * 250_000, "fr"), (14, "A B\x0bC\x0cD" * 60, "en"),
]
LABELS = [(1, 1, 0), (2, 1, 1), (5, 0, 1), (5, 1, 0), (7, None, 1), (9, 1, None), (None, 1, 1), (999, 1, 1), (8, 1, 1)]


def fails(docs) -> list[tuple[str, set[str], int | None]]:
    least: dict[str, int] = {}
    for k, t, _ in docs:
        if k is not None:
            least[t or ""] = min(k, least.get(t or "", k))
    out = []
    for k, t, lang in docs:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        f = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 3 * len(t), "D": bool(re.search("[#$%&*|]", t)), "E": t in least and least[t] != k}
        out.append((lang or "", {x for x in f if f[x]}, k))
    return out


def brute() -> set[tuple]:
    docs = fails(DOCS)
    good = {k for k, q, _ in LABELS if q == 1 and k is not None}
    toxic = {k for k, _, x in LABELS if x == 1 and k is not None}
    out, shapley = [], {}
    for part in {p for p, _, _ in docs}:
        for order in itertools.permutations("ABCDE"):
            left = [d for d in docs if d[0] == part]
            for step, f in enumerate(order, 1):
                gone = [d for d in left if f in d[1]]
                left = [d for d in left if f not in d[1]]
                failing = [d for d in docs if d[0] == part and f in d[1]]
                shapley[part, f] = shapley.get((part, f), 0) + len(gone)
                out.append((part, "".join(order), step, len(left), len(gone), len(failing) - len(gone), sum(d[1] == {f} for d in failing), sum(d[2] in good for d in gone), sum(d[2] in toxic for d in gone)))
    return {(*r, shapley[r[0], r[1][r[2] - 1]]) for r in out}


COLUMNS = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("audit")
    spark.createDataFrame([(*d, True) for d in DOCS], "doc_id long, text string, lang string, kept boolean").write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(*r, "x") for r in LABELS], "doc_id long, quality int, toxic int, part string").write.parquet(f"{at}/labels.parquet")
    return str(at)


def test_equals_brute_force_and_sql(spark, folder):
    got = A.query(spark, folder)
    rows = {tuple(r) for r in got.select(*COLUMNS).collect()}
    assert len(rows) == 4 * 600 and rows == brute()
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet/*.parquet')")
    assert set(con.execute(f"SELECT {', '.join(COLUMNS)} FROM ({A.SQL})").fetchall()) == rows


def test_each_set_of_filters_is_applied_once(spark, tmp_path):
    rows = spark.createDataFrame([("p", True, False, True, True, False), ("p", False, True, True, False, True), ("q", False, False, False, True, False)], "part string, A boolean, B boolean, C boolean, good boolean, toxic boolean")
    A.walk(rows, list("ABC"), str(tmp_path / "w"))
    states = spark.read.parquet(str(tmp_path / "w"))
    assert states.select("state").distinct().count() == 8
    assert {(r.part, r.kept) for r in states.where("state = '_B'").collect()} == {("p", 1), ("q", 1)}
    assert [r.part for r in states.where("state = '_ABC'").collect()] == ["q"]
    got = {tuple(r) for r in A.orders_of(states, list("ABC")).where("part = 'p' AND filter_order = 'CAB'").select("step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost").collect()}
    assert got == {(1, 0, 2, 0, 0, 1, 1), (2, 0, 0, 1, 0, 0, 0), (3, 0, 0, 1, 0, 0, 0)}


def test_empty_tables(spark, folder, tmp_path):
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    assert A.audit(docs.limit(0), labels).collect() == []
    assert all(r.good_lost == r.toxic_lost == 0 for r in A.audit(docs, labels.limit(0)).collect())
