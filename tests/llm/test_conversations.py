import hashlib
import itertools
import random
import re
import zlib

import duckdb
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from shutterlake.llm import conversations as C

SCHEMA = "conv_id long, turn long, role string, text string"


def brute(symbols: str) -> tuple[int, str]:
    """The cheapest edits of a few turns among all that insert up to three."""
    best = None

    def go(k: int, inserted: int, cost: int, audit: str, roles: str) -> None:
        nonlocal best
        if inserted < 3:
            for r in "ua":
                go(k, inserted + 1, cost + 5, audit + "I", roles + r)
        if k == len(symbols):
            if re.fullmatch("(s?(ua)+)?", roles) and (best is None or (cost, audit) < best):
                best = cost, audit
            return
        c = symbols[k]
        go(k + 1, inserted, cost + 2, audit + "D", roles)
        if c != "x":
            extra = 5 if c.isupper() else 0
            go(k + 1, inserted, cost + extra, audit + "K", roles + c.lower())
            for r in "ua":
                go(k + 1, inserted, cost + extra + 1, audit + "R", roles + r)

    go(0, 0, 0, "", "")
    return best


def least(layer: C.Layer) -> tuple[int, str]:
    return min(layer[s] for s in C.FINAL if s in layer)


def test_answers_equal_brute_force():
    trie = C.Trie()
    for n in range(4):
        for symbols in itertools.product("AOSUaosux", repeat=n):
            assert least(trie.answers("^" + "".join(symbols))[C.START]) == brute("".join(symbols)), symbols
    for symbols in ("uasu", "suau", "aauu", "xuxa", "ssua", "UaUa", "oooo", "uaau", "sUau", "aaaa"):
        assert least(trie.answers("^" + symbols)[C.START]) == brute(symbols)


def test_a_shared_prefix_is_computed_once():
    signatures = sorted("^" + "".join(x) for n in range(5) for x in itertools.product("uax", repeat=n))
    trie = C.Trie()
    for s in signatures:
        trie.answers(s)
    assert trie.made == len({s[:k] for s in signatures for k in range(1, len(s) + 1)})


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from("AOSUaosux"), max_size=40), st.integers(1, 9))
def test_segments_chain_to_the_whole(symbols, size):
    whole = "".join(symbols)
    pieces = [whole[k : k + size] for k in range(0, len(whole), size)] or [""]
    rows = [("^" if k == 0 else "+") + p for k, p in enumerate(pieces)]
    answers = [[{"entry": e, "state": s, "cost": c, "audit": a} for e, layer in C.Trie().answers(r).items() for s, (c, a) in layer.items()] for r in rows]
    n = len(rows)
    columns = {"conv_id": [1] * n, "seg": list(range(n)), "last": [k == n - 1 for k in range(n)], "answers": answers, "turn": [None] * n, "role": [None] * n, "digest": [None] * n, **{c: [0] * n for c in C._COUNTS}}
    batch = pa.RecordBatch.from_pydict(columns)
    told = pa.Table.from_batches(C._chain(iter([batch]))).to_pydict()
    assert (told["cost"][0], "".join(told["piece"])) == least(C.Trie().answers("^" + whole)[C.START])


def plain(rows: list[tuple]) -> dict:
    """Everything about one conversation's rows in order (turn, role, text), by a plain loop."""
    turns = [r[0] for r in rows if r[0] is not None]
    out = {"gaps": max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, "blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0}
    seen, symbols = set(), ""
    for k, (_, role, text) in enumerate(rows):
        words = re.sub(r"[\x20\x09-\x0D]", "", text)
        fault = "blank" if not words else "duplicate" if (role, text) in seen else "truncated" if words[-1] not in ".!?" else ""
        seen.add((role, text))
        if fault:
            out[fault] += 1
        c = role[:1] if role[:1] and role[:1] in "sua" else "o"
        symbols += "x" if fault in ("blank", "duplicate") else c.upper() if fault else c
        out["illegal"] += k > 0 and rows[k - 1][1][:1] + role[:1] not in ("su", "ua", "au")
    out["cost"], out["audit"] = least(C.Trie().answers("^" + symbols)[C.START])
    made, left = [], list(rows)
    for edit in out["audit"]:
        want = "user" if len(made) == 0 or made[-1][0][0] != "u" else "assistant"
        if edit == "I":
            made.append((want, ""))
            continue
        _, role, text = left.pop(0)
        if edit != "D":
            made.append((role if edit == "K" else want, text))
    assert not left and re.fullmatch("(s?(ua)+)?", "".join(r[0] for r, _ in made))
    out["repaired_sha256"] = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in made).encode()).hexdigest()
    return out


def test_whole_conversations_equal_a_plain_loop(spark):
    rng = random.Random(5)
    rows, expected = [], {}
    for conv in [None, *range(60)]:
        n = 900 if conv == 7 else rng.randrange(1, 9)
        own = []
        for k in range(n):
            turn = rng.choice([None, k, k, k, k + 3])
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", "ü"])
            text = rng.choice([f"Fine {k}.", f"cut {k}", "Same.", "  \n", "", "Ends? \t\n", "no-break ", "x" * 3000 + "!"])
            own.append((turn, role, text))
        rows += [(conv, *r, "extra") for r in own]
        order = lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).digest())
        expected[conv] = plain(sorted(own, key=order))
    rows.append((500, None, None, None, "known only"))
    expected[500] = plain([])
    rng.shuffle(rows)
    got = {r.conv_id: r.asDict() for r in C.repaired(spark.createDataFrame(rows, SCHEMA + ", audit string")).collect()}
    assert len(got) == len(expected)
    for conv, e in expected.items():
        assert {k: v for k, v in got[conv].items() if k != "conv_id"} == e, conv
    assert got[500]["repaired_sha256"] == hashlib.sha256(b"").hexdigest() and got[500]["audit"] == ""


def test_damage(spark):
    rows = [(c, t, r, x) for c in (None, *range(12)) for t in (None, *range(9)) for r, x in (("system", "Wait. Why? No!"), (None, None))]
    got = sorted(map(repr, C.damaged(spark.createDataFrame(rows, SCHEMA)).collect()))
    expected = []
    for c, t, r, x in rows:
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        r, x = r or " ", x or " "
        if kind == 0:
            expected.append((c, t, None, None))
            continue
        x = "" if kind == 1 else re.sub("[.!?]", "", x) if kind == 2 else x
        expected += [(c, t, "user" if kind == 4 else r, x)] * (2 if kind == 3 else 1)
    assert got == sorted(map(repr, spark.createDataFrame(expected, SCHEMA).collect()))


def test_odd_tables_equal_sql(spark, tmp_path):
    rows = [(None, None, None, None), (1, None, "user", None), (1, 2, None, "A."), (1, 2, None, "A."), (2, 5, "assistant", "Hm"), (2, 9, "assistant", "Hm"), (3, 1, "system", "S."), (3, 2, "user", "Q?"), (3, 2, "user", "Q?"), (3, 7, "assistant", "Yes! \n")]
    rows += [(k, t, ("user", "assistant")[t % 2], f"Turn {t}" + ".?x"[k % 3]) for k in range(10, 60) for t in range(k % 7)]
    spark.createDataFrame([(*r, 1) for r in rows], SCHEMA + ", blank int").write.parquet(str(tmp_path / "conversations.parquet"))
    got = C.query(spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{tmp_path}/conversations.parquet/*.parquet')")
    listed = ", ".join(got.columns)
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, con.execute(f"SELECT {listed} FROM ({C.SQL})").fetchall()))
    none = tmp_path / "none"
    spark.createDataFrame([], SCHEMA).write.parquet(str(none / "conversations.parquet"))
    assert C.query(spark, str(none)).collect() == []
