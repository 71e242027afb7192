import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from shutterlake.llm import packing, token_counts
from shutterlake.llm.tokenizing import encoder


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def texts(n=60, seed=3):
    r = random.Random(seed)
    alphabet = ["a", "the", " ", "  ", "\n", "\n\n", "\t", "é", "ß", "<|endoftext|>", "'s", "1", "42", "%%%", "\x1c", "\x85", "\xa0", "漢字", "🙂", "ﷺ", "İ", "​", "²", "Ⅷ", "don't"]
    return ["".join(r.choice(alphabet) for _ in range(r.randint(0, 60))) for _ in range(n)] + ["", "x" * 5000, " " * 300]


def test_ids_equal_the_library(library):
    for t in texts(400):
        assert encoder().ids(t).tolist() == library.encode(t, add_special_tokens=False).ids


def test_special_string_is_one_id(library):
    own = encoder()
    assert own.ids("a<|endoftext|>b").tolist() == [64, 50256, 65] == library.encode("a<|endoftext|>b", add_special_tokens=False).ids
    text = "é <|endoftext|>\n\n x" * 3
    ids = own.ids(text)
    starts, ends = token_counts.token_spans(ids, text, own.byte_length)
    assert [text[a:b] for a, b, i in zip(starts, ends, ids) if i == 50256] == ["<|endoftext|>"] * 3 and ends[-1] == len(text)


def one_by_one(counts, cap):
    """The residuals after each piece, longest first, has gone to the open bin that it fits best."""
    size, weights, bins = (cap.tokens, cap.documents, cap.attention), cap.weights, []
    for length in sorted((n for n, c in counts.items() for _ in range(c)), reverse=True):
        item = (length, 1, length * length)
        fits = [b for b in bins if all(r >= i for r, i in zip(b, item))]
        if cap.rule == "dot":
            score = lambda b: -sum(r / s * i / s * w for r, i, s, w in zip(b, item, size, weights))
        else:
            score = lambda b: sum(w * ((r - i) / s) ** 2 for r, i, s, w in zip(b, item, size, weights))
        best = min(fits, key=lambda b: (round(score(b), 12), b[0])) if fits else None
        if best is None:
            best = list(size)
            bins.append(best)
        best[:] = [r - i for r, i in zip(best, item)]
    return sorted(map(tuple, bins))


@pytest.mark.parametrize("rule", ["residual", "dot"])
@pytest.mark.parametrize("seed", range(6))
def test_plan_equals_best_fit_one_by_one(rule, seed):
    r = random.Random(seed)
    cap = packing.Capacity(60, r.choice([3, 5, 60]), r.choice([900, 1700, 3600]), rule)
    most = int(min(cap.tokens, cap.attention**0.5))
    counts = {n: r.randint(1, 12) for n in r.sample(range(1, most + 1), min(most, 20))}
    left = defaultdict(lambda: [cap.tokens, cap.documents, cap.attention])
    for length, a, b, first, _ in packing.plan_packing(counts, cap):
        for k in range(first, first + b - a):
            left[k] = [x - y for x, y in zip(left[k], (length, 1, length * length))]
    assert sorted(map(tuple, left.values())) == one_by_one(counts, cap)


@pytest.mark.parametrize("rule", ["residual", "dot"])
@pytest.mark.parametrize("cap", [packing.Capacity(), packing.Capacity(tokens=50, documents=3, attention=1600)])
def test_plan_keeps_every_constraint(rule, cap):
    cap = packing.Capacity(cap.tokens, cap.documents, cap.attention, rule)
    r = random.Random(1)
    most = int(min(cap.tokens, cap.attention**0.5))
    counts = {n: r.choice([1, 2, 17, 3000]) for n in r.sample(range(1, most + 1), min(most, 200))}
    held = defaultdict(list)
    for length, a, b, first, offset in packing.plan_packing(counts, cap):
        for k in range(b - a):
            held[first + k].append((offset, length))
    assert sum(map(len, held.values())) == sum(counts.values())
    for pieces in held.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= cap.tokens and len(pieces) <= cap.documents and sum(n * n for _, n in pieces) <= cap.attention


def test_plan_is_near_the_lower_bound():
    r = random.Random(2)
    counts = defaultdict(int)
    for _ in range(50_000):
        counts[min(2048, 1 + int(r.expovariate(1 / 400)))] += 1
    plan = packing.plan_packing(counts)
    used = max(first + b - a for _, a, b, first, _ in plan)
    assert used <= 1.001 * -(-sum(n * c for n, c in counts.items()) // 2048) + 1


def test_packing_of_odd_rows(spark, library):
    rows = [(1, "hello world", 1), (1, "hello world", 1), (None, None, 2), (3, "", 3), (4, "word " * 5000, 4), (5, "a" * 9000, 5), (6, "x y " * 700, 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, length int").repartition(3)
    got = packing.pack_documents(docs).collect()
    by_sequence, by_doc = defaultdict(list), defaultdict(list)
    for r in got:
        by_sequence[r.sequence_id].append((r.offset, r.length))
        by_doc[r.doc_id].append(r)
    for pieces in by_sequence.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 2048
    for doc_id, text in ((4, "word " * 5000), (5, "a" * 9000), (3, ""), (None, "")):
        ids = np.array([*library.encode(text, add_special_tokens=False).ids, 0], "<u4")
        pieces = sorted(by_doc[doc_id], key=lambda r: r.piece)
        assert [p.piece for p in pieces] == list(range(len(pieces)))
        assert all(p.length == 2048 for p in pieces[1:])
        assert sum(p.length for p in pieces) == len(ids)
        for p in pieces:
            assert p.ids_crc32 == zlib.crc32(ids[p.start : p.start + p.length].tobytes())
    assert len(by_doc[1]) == 2
    assert packing.pack_documents(docs.limit(0)).count() == 0


@pytest.mark.parametrize("rule", token_counts.RULES)
def test_attribution_equals_a_walk_over_tokens(rule, library):
    r = random.Random(5)
    for text in texts(120, 9):
        cuts = sorted(r.sample(range(len(text) + 1), min(len(text) + 1, 6)))
        sections = list(zip(cuts[::2], cuts[1::2])) or [(0, len(text))]
        sections = [s for s in sections if s[0] < s[1]] or [(0, len(text))]
        ids = encoder().ids(text)
        spans, at, raw = [], 0, text.encode()
        char_of = [i for i, c in enumerate(text) for _ in c.encode()]
        for i in ids:
            n = int(encoder().byte_length[i])
            spans.append((char_of[at], char_of[at + n - 1] + 1))
            at += n
        assert at == len(raw)
        want = [0.0] * len(sections)
        for a, b in spans:
            inside = [sum(s <= c < e for c in range(a, b)) for s, e in sections]
            outside_runs = []
            owner = [next((k for k, (s, e) in enumerate(sections) if s <= c < e), None) for c in range(a, b)]
            if rule == "share":
                for k, n in enumerate(inside):
                    want[k] += n / (b - a)
                continue
            if rule == "first":
                k = owner[0]
            elif rule == "last":
                k = owner[-1]
            else:
                runs = []
                for c, o in enumerate(owner):
                    gap = (o, sum(e <= a + c for _, e in sections))
                    if runs and runs[-1][0] == gap:
                        runs[-1][1] += 1
                    else:
                        runs.append([gap, 1])
                k = max(runs, key=lambda x: x[1])[0][0]
            if k is not None:
                want[k] += 1
        got, _ = token_counts.attribute(*token_counts.token_spans(ids, text, encoder().byte_length), sections, rule)
        assert np.allclose(got, want), (text, sections)


def test_counts_of_lines(spark, library):
    rows = [(1, "one line\nand two\n\nend", "x"), (2, None, "y"), (3, "", "z"), (None, "é" * 40 + "\n" * 5, "q")]
    got = token_counts.count_tokens(spark.createDataFrame(rows, "doc_id long, text string, section string")).collect()
    for doc_id, text, _ in rows:
        own = [r for r in got if r.doc_id == doc_id]
        assert sum(r.n_tokens for r in own) == len(library.encode(text or "", add_special_tokens=False).ids)
        assert len(own) == max(1, len((text or "").splitlines()))
