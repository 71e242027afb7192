import hashlib
import random
from collections import defaultdict

import numpy as np
import pytest

from shutterlake.llm import substrings


def brute(rows, length=substrings.LENGTH):
    first = defaultdict(lambda: 1 << 63)
    key = lambda i: (1 << 62) if i is None else i
    for doc_id, text in rows:
        b = (text or "").encode()
        for s in range(len(b) - length + 1):
            first[b[s : s + length]] = min(first[b[s : s + length]], key(doc_id))
    out = []
    for doc_id, text in rows:
        b = (text or "").encode()
        gone = [False] * len(b)
        for s in range(len(b) - length + 1):
            if first[b[s : s + length]] < key(doc_id):
                gone[s : s + length] = [True] * length
        kept = bytes(x for x, g in zip(b, gone) if not g)
        spans = sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))
        out.append((doc_id, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def corpus(seed, n=60):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdeé ") for _ in range(r.randint(1, 8)))
    passages = [" ".join(word() for _ in range(r.randint(5, 60))) for _ in range(6)]
    rows = []
    for i in range(n):
        text = " ".join(r.choice(passages) if r.random() < 0.3 else word() for _ in range(r.randint(0, 30)))
        if rows and r.random() < 0.3:
            old = rows[r.randrange(len(rows))][1] or ""
            at = r.randint(0, len(old))
            text = old[:at] + r.choice(["", "x", word()]) + old[at + r.randint(0, 2) :]
        rows.append((i, text))
    rows += [(500, None), (501, ""), (502, "ab" * 400), (503, "ab" * 300), (504, "a" * 200), (505, "a" * 49), (3, rows[7][1]), (3, rows[7][1]), (None, rows[9][1]), (None, rows[5][1])]
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_equals_brute_force(spark, seed, monkeypatch):
    rows = corpus(seed)
    docs = spark.createDataFrame([(i, t, 7) for i, t in rows], "doc_id long, text string, n_bytes int").repartition(4)
    got = sorted((tuple(r) for r in substrings.deduplicated(docs).collect()), key=repr)
    assert got == brute(rows)


def test_several_shards_end_to_end(spark):
    rows = corpus(8, 90)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = sorted((tuple(r) for r in substrings.deduplicated(docs, shard_bytes=300).collect()), key=repr)
    assert got == brute(rows)


@pytest.mark.parametrize("hot", [0, 3])
def test_hot_anchors_window_by_window(spark, hot):
    r = random.Random(3)
    rows = corpus(5, 60)
    passage = "a passage that stands in very many documents, longer than a window by far and always the same words"
    rows += [(1000 + i, "".join(r.choices("xyz ", k=r.randint(0, 60))) + passage + "".join(r.choices("uvw ", k=r.randint(0, 60)))) for i in range(50)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = sorted((tuple(x) for x in substrings.deduplicated(docs, hot_kinds=hot).collect()), key=repr)
    assert got == brute(rows)


def test_text_longer_than_a_chunk(spark):
    r = random.Random(5)
    text = lambda n: "".join(r.choices("abcdefghijklmnopqrstuvwxyz     ", k=n))
    long = text(4_600_000)
    # Across the borders of runs and of a chunk's size.
    parts = [(1_048_500, 1_048_700), (4_194_250, 4_194_400), (2_000_000, 2_003_000)]
    rows = [(1, long, 0)] + [(2 + i, text(70) + "<" + long[a:b] + ">" + text(70), 0) for i, (a, b) in enumerate(parts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, chunk_id int").repartition(3)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans) for r in substrings.deduplicated(docs).collect()}
    assert got == {1: (4_600_000, 0, 0)} | {2 + i: (142 + b - a, b - a, 1) for i, (a, b) in enumerate(parts)}


@pytest.mark.parametrize("seed", range(4))
def test_least_documents_over_shards(seed):
    r = random.Random(seed)
    stretch = lambda: bytes(r.choices(b"ab", k=r.randint(1, 40)))
    texts = [[stretch() for _ in range(r.randint(1, 30))] for _ in range(r.randint(1, 6))]
    docs = [np.array([r.randint(0, 5) for _ in t]) for t in texts]
    first: dict[bytes, int] = {}
    for t, d in zip(texts, docs):
        for x, i in zip(t, d):
            for k in range(len(x) - 11):
                first[x[k : k + 12]] = min(first.get(x[k : k + 12], 99), i)
    want = [[first[x[k : k + 12]] for x in t for k in range(len(x) - 11)] for t in texts]
    assert [x.tolist() for x in substrings.least_documents(texts, docs, 12)] == want


def test_no_rows(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert substrings.deduplicated(docs).collect() == []


def test_merged_transforms_are_sorted():
    r = np.random.default_rng(4)
    shards = [np.append(r.integers(97, 100, int(n)), 255).astype(np.uint8) for n in (300, 1, 77, 500)]
    order, prefix = substrings.merge_transforms(shards, 12)
    owner = np.repeat(np.arange(4), [len(s) for s in shards])
    start = np.cumsum([0, *(len(s) for s in shards)])
    rotation = lambda i: bytes(np.roll(shards[owner[i]], -(i - start[owner[i]]))[:12].tolist() * 12)[:12]
    keys = [rotation(i) for i in order]
    assert sorted(order.tolist()) == list(range(len(owner)))
    assert keys == sorted(keys)
    for a, b, p in zip(keys, keys[1:], prefix[1:]):
        assert p == next((k for k in range(12) if a[k] != b[k]), 12)


def test_anchors_cover_each_window_once():
    r = random.Random(1)
    texts = ["".join(r.choice("ab") for _ in range(r.choice([0, 10, 49, 50, 51, 400]))).encode() for _ in range(40)]
    data = np.frombuffer(b"".join(texts), np.uint8)
    offsets = np.cumsum([0, *map(len, texts)])
    _, _, doc, low, last = substrings.anchors(data, offsets)
    seen = [(int(d), int(s)) for d, a, b in zip(doc, low, last) for s in range(a, b + 1)]
    want = [(d, int(offsets[d]) + s) for d, t in enumerate(texts) for s in range(len(t) - 49)]
    assert sorted(seen) == want
