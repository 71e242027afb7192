import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from shutterlake.llm import token_files as T


def packed(docs: list[np.ndarray]) -> bytes:
    return T.pack_shard(np.arange(len(docs)), np.zeros(len(docs), bool), np.array(list(map(len, docs))), np.concatenate(docs))


def check(docs: list[np.ndarray]) -> T.Shard:
    shard = T.Shard(packed(docs))
    assert (shard.all_ids() == np.concatenate(docs)).all() and shard.n_ids == sum(map(len, docs))
    # Every rule is made of older symbols, and its length is theirs.
    for k, (a, b) in enumerate(shard.rules.tolist()):
        assert max(a, b) < shard.base + k
        assert shard.lengths[k] == sum(1 if s < shard.base else shard.lengths[s - shard.base] for s in (a, b))
    return shard


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 3) | st.sampled_from([7, 50256]), min_size=1, max_size=300), min_size=1, max_size=12), st.data())
def test_any_range_of_any_document_comes_back(docs, data):
    docs = [np.array(d * data.draw(st.integers(1, 4)), np.uint32) for d in docs]
    shard = check(docs)
    nth = data.draw(st.integers(0, len(docs) - 1))
    a = data.draw(st.integers(0, len(docs[nth])))
    b = data.draw(st.integers(a, len(docs[nth]) + 5))
    assert (shard.ids(nth, a, b) == docs[nth][a:b]).all() and (shard.ids(nth) == docs[nth]).all()


def test_runs_copies_and_many_different_pairs():
    rng = np.random.default_rng(3)
    assert len(check([np.zeros(5000, np.uint32)]).symbols) < 20
    text = rng.integers(0, 50257, 4000).astype(np.uint32)
    shard = check([text] * 20)
    assert len(shard.symbols) + 2 * len(shard.rules) < len(text) * 20 // 4
    shard = check([rng.integers(0, 200, 150_000).astype(np.uint32), rng.integers(0, 200, 100_000).astype(np.uint32)])
    assert len(shard.rules) > 1000
    wide = check([np.tile(rng.integers(0, 1 << 17, 50).astype(np.uint32), 40)])
    assert wide.symbols.max() > 1 << 16
    # Nothing repeats: nothing is replaced.
    assert len(check([np.arange(3000, dtype=np.uint32)]).rules) == 0


def test_a_damaged_shard_raises():
    data = bytearray(packed([np.arange(50, dtype=np.uint32)]))
    data[60] ^= 1
    with pytest.raises(ValueError, match="damaged"):
        T.Shard(bytes(data))
    with pytest.raises(ValueError, match="damaged"):
        T.Shard(b"something else, long enough")


def table(spark):
    rng = random.Random(2)
    words = ["alpha", "beta", " gamma", "!", "é", "日本", "<|endoftext|>", "\n\n", "delta epsilon"]
    rows = [(k, " ".join(rng.choices(words, k=rng.randrange(60)))) for k in rng.sample(range(-500, 5000), 300)]
    rows += [(None, "no id"), (None, None), (9000, None), (9001, ""), (9002, "long " * 300_000), (9003, "same"), (9003, "same"), (9003, "other"), (9004, "!")]
    rng.shuffle(rows)
    return rows, spark.createDataFrame([(k, t, "x") for k, t in rows], "doc_id long, text string, ids string")


def test_files_give_every_document_back(spark, tmp_path):
    rows, docs = table(spark)
    T.write_tokens(docs.repartition(5), str(tmp_path / "t"))
    got = T.read_tokens(spark, str(tmp_path / "t")).collect()
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    encoded = {t: library.encode(t or "", add_special_tokens=False).ids + [0] for t in {t for _, t in rows}}
    assert sorted((r.doc_id is not None, r.doc_id or 0, bytes(r.ids)) for r in got) == sorted((k is not None, k or 0, np.array(encoded[t], "<u4").tobytes()) for k, t in rows)
    at = 0
    ordered = sorted(got, key=lambda r: r.start)
    for r in ordered:
        assert r.start == at and r.n_tokens == len(r.ids) // 4
        at += r.n_tokens
    keys = [r.doc_id for r in ordered]
    assert keys[:2] == [None, None] and keys[2:] == sorted(keys[2:])
    wanted = spark.createDataFrame([(9002, 250_000, 250_003), (9002, -5, 2), (9001, 0, 9), (9003, 0, 1), (9003, 0, 1), (77777, 0, 5), (9000, 1, 4)], "doc_id long, first long, end long")
    ranges = sorted((r.doc_id, r.first, np.frombuffer(r.ids, "<u4").tolist()) for r in T.fetch_ranges(spark, str(tmp_path / "t"), wanted).collect())
    long, same, other = encoded["long " * 300_000], encoded["same"], encoded["other"]
    assert ranges == sorted([(9002, 250_000, long[250_000:250_003]), (9002, -5, long[:2]), (9001, 0, [0]), (9003, 0, same[:1]), (9003, 0, same[:1]), (9003, 0, other[:1]), (9000, 1, [])])


def test_query(spark, tmp_path):
    rows, docs = table(spark)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    got = T.query(spark, str(tmp_path)).collect()
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    crc = lambda t: zlib.crc32(np.array(library.encode(t or "", add_special_tokens=False).ids + [0], "<u4").tobytes())
    assert sorted((str(r.doc_id), r.ids_crc32) for r in got) == sorted((str(k), crc(t)) for k, t in rows)
    docs.limit(0).write.parquet(str(tmp_path / "none" / "documents.parquet"))
    assert T.query(spark, str(tmp_path / "none")).collect() == []
