import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from shutterlake.llm import common, ngram_join


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            n = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * n >= 80 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    groups = {}
    for i in range(len(rows)):
        groups.setdefault(find(i), []).append(i)
    least = {k: min((rows[i][0] for i in v if rows[i][0] is not None), default=None) for k, v in groups.items()}
    return sorted(((rows[i][0], len(sets[i]), least[find(i)]) for i in range(len(rows))), key=repr), len(groups)


def corpus(seed, n=80):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcXYé") for _ in range(r.randint(1, 4)))
    base = [[word() for _ in range(r.choice([3, 5, 8, 40, 120, 300]))] for _ in range(10)]
    line = [word() for _ in range(12)]
    rows = []
    for i in range(n):
        w = list(r.choice(base)) if r.random() < 0.8 else [word() for _ in range(r.randint(0, 30))]
        for _ in range(r.choice([0, 0, 1, 2, 4])):
            if w:
                w[r.randrange(len(w))] = word()
        if r.random() < 0.4:
            w += line
        rows.append((i, r.choice([" ", "\n", "\t", " \r\n "]).join(w)))
    rows += [(900, None), (901, ""), (902, " \n "), (903, "one"), (904, "ONE"), (5, rows[3][1]), (5, rows[60][1]), (None, rows[8][1]), (None, "alone here"), (906, "\xa0 a\x85b")]
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed,small", [(1, 24), (2, 2), (3, 2)])
def test_equals_brute_force(spark, seed, small):
    rows = corpus(seed)
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, row int").repartition(4)
    want, n = brute(rows)
    _, got = ngram_join.similar(docs, small=small)
    got = got.collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=repr) == want
    assert sum(r.first for r in got) == n


@pytest.mark.parametrize("classes", [0, 200_000])
def test_both_sides_of_the_switches(spark, monkeypatch, classes):
    # Hot classes and hot components by a broadcast, the rest by a shuffle; sets fetched by a shuffle or a broadcast.
    monkeypatch.setattr(common, "HOT_ROWS", 5)
    monkeypatch.setattr(ngram_join, "BROADCAST_CLASSES", classes)
    r = random.Random(4)
    base = [f"w{k}" for k in range(60)]
    rows = [(i, " ".join(base)) for i in range(40)]
    for i in range(40, 90):
        w = list(base)
        w[r.randrange(60)] = f"x{i % 30}"
        rows.append((i, " ".join(w)))
    rows += [(i, f"alone {i} " + " ".join(f"y{i}_{k}" for k in range(9))) for i in range(90, 110)]
    r.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want, _ = brute(rows)
    got = ngram_join.similar(docs)[1].collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=repr) == want


@pytest.mark.parametrize("hot", [3, 20, 1000])
def test_hot_tokens_come_last(spark, hot):
    rows = corpus(11, 120)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    want, _ = brute(rows)
    got = ngram_join.similar(docs, hot_token_rows=hot)[1].collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=repr) == want


def test_first_tokens_with_hot_ones():
    r = np.random.default_rng(5)
    bounds = np.cumsum([0, 5, 0, 1, 30, 100, 7])
    tokens = np.concatenate([np.sort(r.integers(0, 1 << 20, n)) for n in np.diff(bounds)]).astype(np.uint64)
    hot = r.random(len(tokens)) < 0.4
    first, row, rank = ngram_join._first_tokens(tokens, bounds, hot)
    for k, (a, b) in enumerate(zip(bounds, bounds[1:])):
        order = sorted(range(a, b), key=lambda i: (hot[i], i))
        assert [rank[i] for i in order] == list(range(b - a)) and (row[a:b] == k).all()
        n = b - a - int(ngram_join.least_overlap(np.int64(b - a))) + int(ngram_join.extra(np.int64(b - a)))
        assert set(np.flatnonzero(first[a:b]) + a) == set(order[:n])


@pytest.mark.parametrize("seed,small", [(5, 16), (6, 2)])
def test_all_links_equal_brute_force(spark, seed, small):
    rows = corpus(seed)
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, class int").repartition(3)
    members, pairs = ngram_join.links(docs, small=small)
    sets = [shingles(t) for _, t in rows]
    linked = lambda x, y: bool(x and y) and 100 * len(x & y) >= 80 * len(x | y)
    want = sorted(((i, len(x), sum(linked(x, y) for k, y in enumerate(sets) if k != j)) for j, ((i, _), x) in enumerate(zip(rows, sets))), key=repr)
    got = members.collect()
    assert sorted(((r.doc_id, r.n_shingles, r.n_links) for r in got), key=repr) == want
    different = sorted(set(sets), key=repr)
    want = sorted((len(x & y), len(x | y)) for k, x in enumerate(different) for y in different[:k] if linked(x, y))
    assert sorted((r.overlap, r.union) for r in pairs.collect()) == want and len(want) > 10
    assert all((r.class_id is None) == (r.n_shingles == 0) for r in got)


def test_text_longer_than_a_chunk(spark):
    r = random.Random(9)
    word = [f"w{r.randrange(10**9)}" for _ in range(450_000)]
    near, far = list(word), list(word)
    near[1000:1200] = [f"n{k}" for k in range(200)]
    far[: len(far) // 3] = [f"f{k}" for k in range(len(far) // 3)]
    rows = [(1, " ".join(word)), (2, " ".join(near)), (3, " ".join(far)), (4, word[5])]
    assert len(rows[0][1]) > 4 << 20
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.similar(docs)[1].collect()}
    assert {k: v[1] for k, v in got.items()} == {1: 1, 2: 1, 3: 3, 4: 4} and got[1][0] == 449_996 and got[4][0] == 1


def test_more_askers_than_a_turn_takes():
    r = np.random.default_rng(2)
    n = 3 * ngram_join.ASKING
    points = np.repeat(r.poisson(3, (1, ngram_join.GROUPS)), n, axis=0).astype(np.int32)
    sizes, labels, shares, ranks = points.sum(axis=1).astype(np.int64), np.arange(n), np.ones(n), np.arange(n)
    a, b, more = ngram_join.tree_pairs(points, sizes, labels, shares, ranks, 1)
    assert more and len(set(a) | set(b)) == n
    a, b, more = ngram_join.tree_pairs(points, sizes, labels, shares, ranks, ngram_join.ROUNDS - 1)
    assert not more and len({(x, y) for x, y in zip(a, b)}) >= n * (n - 1) // 2 - (n - 1)


def test_one_of_each_keeps_columns(spark):
    rows = [(2, "a b c d e f g", "x"), (1, "A b c d e f g", "y"), (1, "a b c d e f g", "z"), (3, None, "n"), (4, "", "e"), (None, "q", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, component_id string").withColumn("no_text", F.lit(True)).withColumn("__no_text", F.lit(1)).withColumn("label", F.lit("l"))
    kept = ngram_join.one_of_each(docs)
    assert kept.columns == docs.columns and all(r["no_text"] and r["__no_text"] == 1 and r["label"] == "l" for r in kept.collect())
    docs = docs.select("doc_id", "text", "component_id")
    got = sorted((tuple(r) for r in ngram_join.one_of_each(docs).collect()), key=repr)
    assert len(got) == 4 and got[1:] == sorted([(3, None, "n"), (4, "", "e"), (None, "q", None)], key=repr) and got[0][0] == 1
    assert ngram_join.one_of_each(docs.limit(0)).collect() == []


def test_tree_gives_all_pairs_within_the_bound():
    r = np.random.default_rng(7)
    base = r.poisson(3, (40, ngram_join.GROUPS))
    points = np.maximum(0, base[r.integers(0, 40, 700)] + r.integers(-1, 2, (700, ngram_join.GROUPS)) * (r.random((700, 1)) < 0.5)).astype(np.int32)
    sizes = points.sum(axis=1).astype(np.int64)
    tree = ngram_join.Tree(points, sizes)
    got = {(int(a), int(b)) for q, p in tree.probe(np.arange(700)) for a, b in zip(q, p)}
    a, b = (x.ravel() for x in np.indices((700, 700)))
    ok = ngram_join.likely(points, sizes, a, b)
    assert got == set(zip(a[ok].tolist(), b[ok].tolist()))


def test_a_hot_class_is_copied_to_several_tasks(spark):
    pairs = spark.range(0, 3000).selectExpr("if(id < 2000, 7L, id) as a", "id + 10000 as b")
    facts = spark.createDataFrame([(k, f"set {k}") for k in [7, *range(2000, 3000)]], "a long, tokens string")
    shares = common.shares_of(pairs, "a", 100)
    assert [tuple(r) for r in shares.collect()] == [(7, 20)]
    joined = common.copied_join(pairs, facts, "a", ["b"], shares)
    rows = joined.collect()
    assert len(rows) == 3000 and all(r.tokens == f"set {r.a}" for r in rows) and {r.b for r in rows} == set(range(10000, 13000))
    assert "Cartesian" not in joined._jdf.queryExecution().executedPlan().toString()


def test_near_copies_of_one_text_are_one_component(spark):
    base = [f"w{k}" for k in range(120)]
    rows = [(i, " ".join([*base[:60], f"own{i}", *base[61:]])) for i in range(600)]
    found = ngram_join.similar(spark.createDataFrame(rows, "doc_id long, text string"), keep_chunks=False)[1].collect()
    assert {r.component_id for r in found} == {0} and len(found) == 600
