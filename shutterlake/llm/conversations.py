"""Repair of conversations' structure by dynamic programming over a trie of signatures.

What the cheapest repair of a conversation is depends on a signature alone: for each turn, whose it is and whether it is
cut off or has to go. Signatures, cut into segments so that they and all that is computed of them stay small, are sorted
and walked as a prefix trie: the layers of the DP are computed once for each shared prefix, and the node at which a
signature ends has its answers. Segments then chain to whole conversations.

The rows pass twice, each time sorted within tasks and streamed, so that no conversation is ever held: without their
texts for the signatures, with them for the repaired text's hash, which has to see it in order.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from shutterlake.llm.common import forget, hot_limit, partitions_of, read, spread_join, stored

#: Turns of a segment.
SEGMENT = 256
#: Costs of the edits, and of a turn that stays cut off.
REROLE, DELETE, INSERT, CUT_OFF = 1, 2, 5, 5
#: White space, as bytes 09 to 0D and 20.
_BLANK = " \t\n\x0b\x0c\r"

# States of the pattern (s?(ua)+)?: nothing yet, after s, after u, after a. It may end at the first and the last.
START, AFTER_S, AFTER_U, AFTER_A = range(4)
FINAL = (START, AFTER_A)
_NEXT = {(START, "s"): AFTER_S, (START, "u"): AFTER_U, (AFTER_S, "u"): AFTER_U, (AFTER_U, "a"): AFTER_A, (AFTER_A, "u"): AFTER_U}
#: The role that an inserted or changed turn must have in each state.
ROLE = {START: "user", AFTER_S: "user", AFTER_U: "assistant", AFTER_A: "user"}

#: Cheapest edits to each state: (cost, their initials).
Layer = dict[int, tuple[int, str]]


def _least(layer: Layer, state: int, found: tuple[int, str]) -> None:
    if state not in layer or found < layer[state]:
        layer[state] = found


def with_inserts(layer: Layer) -> Layer:
    """The layer after insertions as well; more than two in a row never pay."""
    out = dict(layer)
    for state, (cost, audit) in layer.items():
        for _ in range(2):
            state = _NEXT[state, ROLE[state][0]]
            cost, audit = cost + INSERT, audit + "I"
            _least(out, state, (cost, audit))
    return out


def after_turn(layer: Layer, symbol: str) -> Layer:
    """The layer after a turn: x has to go; s, u, a and o (any other role) may stay, in upper case at the cost of being cut off."""
    out: Layer = {}
    for state, (cost, audit) in layer.items():
        _least(out, state, (cost + DELETE, audit + "D"))
        if symbol == "x":
            continue
        extra = CUT_OFF if symbol.isupper() else 0
        if (kept := _NEXT.get((state, symbol.lower()))) is not None:
            _least(out, kept, (cost + extra, audit + "K"))
        _least(out, _NEXT[state, ROLE[state][0]], (cost + extra + REROLE, audit + "R"))
    return with_inserts(out)


def root_layers(first: bool) -> dict[int, Layer]:
    """For each state that a segment may begin in, the layer before its turns; only a conversation's first may begin with insertions."""
    return {START: with_inserts({START: (0, "")})} if first else {s: {s: (0, "")} for s in range(4)}


class Trie:
    """The path of layers to the last signature; the next one, in sorted order, keeps what it shares of it."""

    def __init__(self) -> None:
        self.path = ""
        self.layers: list[dict[int, Layer]] = []
        #: Layers that were computed.
        self.made = 0

    def answers(self, signature: str) -> dict[int, Layer]:
        """The layers at the node of a signature: "^" or "+" (a first or a later segment) and its turns."""
        shared = 0
        for a, b in zip(self.path, signature, strict=False):
            if a != b:
                break
            shared += 1
        del self.layers[shared:]
        for symbol in signature[shared:]:
            self.layers.append({s: after_turn(x, symbol) for s, x in self.layers[-1].items()} if self.layers else root_layers(symbol == "^"))
            self.made += 1
        self.path = signature
        return self.layers[-1]


def damaged(conversations: DataFrame) -> DataFrame:
    """The test damage of conversations(conv_id, turn, role, text), by the CRC-32 of id and turn: nulls are one space.

    Of 20 turns one each is dropped (kept here as a row without role and text, so that its conversation is known), is
    emptied, loses its `.!?`, is repeated, or becomes the user's.
    """
    filled = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.encode(F.concat(filled("conv_id"), F.lit(":"), filled("turn")), "UTF-8")) % 20
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), filled("role").alias("role"), filled("text").alias("text"), kind.alias("kind"))
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    times = F.when(F.col("kind") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    there = lambda c: F.when(F.col("kind") != 0, c)
    return rows.select("conv_id", "turn", there(role).alias("role"), there(text).alias("text"), F.explode(times).alias("copy")).drop("copy")


def _ordered(rows: DataFrame, *more: str) -> DataFrame:
    """Rows dealt by conversation and sorted by turn, nulls first, then role and the text's digest."""
    order = [F.asc_nulls_first(c) for c in ("conv_id", "turn", "role", "digest", *more)]
    return rows.sortWithinPartitions(*order)


_KEY = [("turn", pa.int64()), ("role", pa.string()), ("digest", pa.binary())]
_COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal")
_KEY_SCHEMA = "turn long, role string, digest binary"
_SEGMENT = f"conv_id long, seg long, last boolean, signature string, {_KEY_SCHEMA}, " + ", ".join(f"{c} long" for c in _COUNTS)


def _columns(rows: list[tuple], kinds: list[tuple[str, pa.DataType]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(v, k) for v, (_, k) in zip(zip(*rows, strict=True) if rows else [[]] * len(kinds), kinds, strict=True)], names=[n for n, _ in kinds])


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Signatures of segments, and what is counted of each conversation on the last of its segments."""
    kinds = [("conv_id", pa.int64()), ("seg", pa.int64()), ("last", pa.bool_()), ("signature", pa.string()), *_KEY, *((c, pa.int64()) for c in _COUNTS)]
    out: list[tuple] = []
    nothing = object()
    conv: object = nothing
    seg = turns = least = most = before = None
    symbols: list[str] = []
    first_key: tuple = (None, None, None)
    counts = dict.fromkeys(_COUNTS, 0)

    def end(last: bool) -> None:
        counts["gaps"] = most - least + 1 - turns if last and turns else 0
        out.append((conv, seg, last, ("^" if seg == 0 else "+") + "".join(symbols), *first_key, *(counts[c] if last else None for c in _COUNTS)))

    for batch in batches:
        for c, turn, role, digest, fault in zip(*(batch.column(n).to_pylist() for n in ("conv_id", "turn", "role", "digest", "fault")), strict=True):
            if conv is nothing or c != conv:
                if conv is not nothing:
                    end(True)
                conv, seg, turns, least, most, before = c, 0, 0, None, None, None
                symbols, first_key, counts = [], (None, None, None), dict.fromkeys(_COUNTS, 0)
            if role is None:
                continue
            if len(symbols) == SEGMENT:
                end(False)
                seg, symbols = seg + 1, []
            if not symbols:
                first_key = (turn, role, digest)
            if fault:
                counts[fault] += 1
            if before is not None:
                counts["illegal"] += before[:1] + role[:1] not in ("su", "ua", "au")
            if turn is not None and turn != most:
                turns, most, least = turns + 1, turn, turn if least is None else least
            before = role
            initial = role[:1] if role[:1] in ("s", "u", "a") else "o"
            symbols.append("x" if fault in ("blank", "duplicate") else initial.upper() if fault else initial)
        if len(out) >= 1024:
            yield _columns(out, kinds)
            out.clear()
    if conv is not nothing:
        end(True)
    yield _columns(out, kinds)


_ANSWER = pa.list_(pa.struct([("entry", pa.int32()), ("state", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())]))


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    trie = Trie()
    for batch in batches:
        found = [[{"entry": e, "state": s, "cost": c, "audit": a} for e, layer in trie.answers(x).items() for s, (c, a) in layer.items()] for x in batch.column("signature").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("signature"), batch.column("n"), pa.array(found, _ANSWER)], names=["signature", "n", "answers"])


def answered(segments: DataFrame) -> DataFrame:
    """The different signatures of segments(signature, ...), how many segments have each, and the answers at their nodes."""
    distinct = segments.groupBy("signature").agg(F.count(F.lit(1)).alias("n"))
    walked = distinct.repartitionByRange(partitions_of(segments), "signature").sortWithinPartitions("signature")
    return walked.mapInArrow(_walk, "signature string, n long, answers array<struct<entry: int, state: int, cost: long, audit: string>>")


def _before(a: list[str], b: list[str]) -> bool:
    """Whether the strings of a, joined, come before those of b; most pairs differ within some piece."""
    for k, (x, y) in enumerate(zip(a, b, strict=False)):
        if x != y:
            if x.startswith(y) or y.startswith(x):
                return "".join(a[k:]) < "".join(b[k:])
            return x < y
    return len(a) < len(b)


_CHAINED = f"conv_id long, seg long, {_KEY_SCHEMA}, piece string, cost long, " + ", ".join(f"{c} long" for c in _COUNTS)


def _chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The edits of each segment of every conversation, from its segments' answers in their order."""
    kinds = [("conv_id", pa.int64()), ("seg", pa.int64()), *_KEY, ("piece", pa.string()), ("cost", pa.int64()), *((c, pa.int64()) for c in _COUNTS)]
    paths: dict[int, tuple[int, list[str]]] = {START: (0, [])}
    keys: list[tuple] = []
    for batch in batches:
        out = []
        for row in zip(*(batch.column(n).to_pylist() for n in ("conv_id", "seg", "last", "answers", *(k for k, _ in _KEY), *_COUNTS)), strict=True):
            conv, seg, last, answers = row[:4]
            after: dict[int, tuple[int, list[str]]] = {}
            for x in answers:
                if x["entry"] not in paths:
                    continue
                cost, pieces = paths[x["entry"]]
                cost, old = cost + x["cost"], after.get(x["state"])
                if old is None or cost < old[0] or (cost == old[0] and _before([*pieces, x["audit"]], old[1])):
                    after[x["state"]] = (cost, [*pieces, x["audit"]])
            paths = after
            keys.append((conv, seg, *row[4:7]))
            if last:
                best = None
                for state in FINAL:
                    if state in paths and (best is None or paths[state][0] < best[0] or (paths[state][0] == best[0] and _before(paths[state][1], best[1]))):
                        best = paths[state]
                out += [(*key, piece, best[0], *row[7:]) for key, piece in zip(keys, best[1], strict=True)]
                paths, keys = {START: (0, [])}, []
        yield _columns(out, kinds)


_REPAIRED = "conv_id long, " + ", ".join(f"{c} long" for c in _COUNTS) + ", cost long, audit string, repaired_sha256 string"


def edited(role: str, text: str, edits: Iterator[str], state: int) -> tuple[list[tuple[str, str]], int]:
    """The turns that come of one turn and the insertions before it, and the state after them."""
    out = []
    for edit in edits:
        if edit == "D":
            return out, state
        new = role if edit == "K" else ROLE[state]
        state = _NEXT[state, new[:1]]
        out.append((new, "" if edit == "I" else text))
        if edit != "I":
            return out, state
    return out, state


def _apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A conversation's edits come before the turns that they are for; its repaired text is hashed as it passes."""
    kinds = [("conv_id", pa.int64()), *((c, pa.int64()) for c in _COUNTS), ("cost", pa.int64()), ("audit", pa.string()), ("repaired_sha256", pa.string())]
    nothing = object()
    conv: object = nothing
    out: list[tuple] = []
    pieces: list[str] = []
    state = used = at = 0
    totals: tuple = ()
    seen = None

    def pending() -> Iterator[str]:
        nonlocal used, at
        while used < len(pieces):
            while at < len(pieces[used]):
                at += 1
                yield pieces[used][at - 1]
            used, at = used + 1, 0

    def tell(turns: list[tuple[str, str]]) -> None:
        nonlocal seen
        for role, text in turns:
            if seen is None:
                seen = hashlib.sha256()
            else:
                seen.update(b"\n")
            seen.update(f"{role}:{text}".encode())

    def end() -> None:
        tell(edited("", "", pending(), state)[0])
        out.append((conv, *totals, "".join(pieces), (seen or hashlib.sha256()).hexdigest()))

    for batch in batches:
        for row in zip(*(batch.column(n).to_pylist() for n in ("conv_id", "piece", "role", "text", *_COUNTS, "cost")), strict=True):
            if conv is nothing or row[0] != conv:
                if conv is not nothing:
                    end()
                conv, pieces, state, used, at, seen = row[0], [], START, 0, 0, None
            if row[1] is not None:
                pieces.append(row[1])
                totals = tuple(x or 0 for x in row[4:])
            else:
                turns, state = edited(row[2], row[3], pending(), state)
                tell(turns)
        if len(out) >= 1024:
            yield _columns(out, kinds)
            out.clear()
    if conv is not nothing:
        end()
    yield _columns(out, kinds)


def repaired(rows: DataFrame) -> DataFrame:
    """Faults and the cheapest repair of each conversation of rows(conv_id, turn, role, text), in the order of the turns.

    Rows without role are no turns, but make their conversation known. Null turns come first; turns that share a number
    are in the order of role and of the text's digest, so equal rows stand together. A null conv_id is one conversation.
    An empty table gives no rows; extra columns are ignored. Texts are read whole, whatever their length.

    One conversation with a great many turns is sorted and streamed by one task, as its hash has to see the repaired
    text in order; what is held of it are its edits, a byte a turn. The signatures' answers meet hot ones by a broadcast.
    """
    rows = rows.select("conv_id", "turn", "role", "text", F.unhex(F.sha2(F.encode("text", "UTF-8"), 256)).alias("digest"))
    trimmed = F.rtrim("text", F.lit(_BLANK))
    said = F.length(trimmed) > 0
    cut = ~F.substring(trimmed, -1, 1).isin(".", "!", "?")
    n = partitions_of(rows)
    facts = rows.select("conv_id", "turn", "role", "digest", said.alias("said"), cut.alias("cut")).repartition(n, "conv_id")
    # Dealt by conversation already, which serves this window as well; it streams.
    again = F.row_number().over(Window.partitionBy("conv_id", "role", "digest").orderBy(F.asc_nulls_first("turn"))) > 1
    fault = F.when(~F.col("said"), "blank").when(F.col("again"), "duplicate").when(F.col("cut"), "truncated")
    facts = _ordered(facts.withColumn("again", again)).select("conv_id", "turn", "role", "digest", fault.alias("fault"))
    segments = stored(facts.mapInArrow(_segments, _SEGMENT), "segments")
    answers = stored(answered(segments), "signatures")
    met = spread_join(segments, answers, "signature", F.col("n") > hot_limit(segments.count()), ["conv_id", "seg"])
    chained = met.repartition(n, "conv_id").sortWithinPartitions(F.asc_nulls_first("conv_id"), "seg").mapInArrow(_chain, _CHAINED)
    edits = chained.withColumn("text", F.lit(None).cast("string"))
    turns = rows.where(F.col("role").isNotNull())
    both = turns.unionByName(edits, allowMissingColumns=True).withColumn("is_turn", F.col("piece").isNull())
    columns = ("conv_id", "piece", "role", "text", *_COUNTS, "cost")
    out = stored(_ordered(both.repartition(n, "conv_id"), "is_turn", "seg").select(*columns).mapInArrow(_apply, _REPAIRED), "conversations")
    forget(segments)
    forget(answers)
    return out


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op11: the repair of all conversations after the test damage."""
    return repaired(damaged(read(spark, sf_dir, "conversations")))


SQL = """
WITH RECURSIVE src AS (
    SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
           coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations
), crc AS (
    SELECT conv_id, turn, role, text,
           xor(list_reduce([4294967295] || flatten(list_transform(range(1, length(k) + 1), lambda i: list_transform(range(8), lambda b: (ascii(k[i]) >> b) & 1))),
               lambda acc, bit: xor(acc >> 1, 3988292384 * (xor(acc, bit) & 1))), 4294967295) % 20 AS kind
    FROM src
), dam AS (
    SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
           CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
    FROM crc, range(2) c(copy) WHERE kind <> 0 AND (copy = 0 OR kind = 3)
), pos AS (
    SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text)) AS i,
           regexp_extract(text, '(?s)([^\\x20\\x09-\\x0D])[\\x20\\x09-\\x0D]*$', 1) AS final FROM dam
), flt AS (
    SELECT *, CASE WHEN final = '' THEN 'blank'
                   WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate'
                   WHEN final NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
           lag(role[1]) OVER (PARTITION BY conv_id ORDER BY i) AS prior FROM pos
), sums AS (
    SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps, count(*) FILTER (fault = 'blank') AS blank,
           count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
           count(*) FILTER (i > 1 AND prior || role[1] NOT IN ('su', 'ua', 'au')) AS illegal, max(i) AS n FROM flt GROUP BY conv_id
), step(p, initial, q) AS (VALUES (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (2, 'a', 3), (3, 'u', 2)
), ins(p, q, more, cost, text) AS (VALUES
    (0, 0, '', 0, ''), (1, 1, '', 0, ''), (2, 2, '', 0, ''), (3, 3, '', 0, ''), (0, 2, 'I', 5, chr(10) || 'user:'), (1, 2, 'I', 5, chr(10) || 'user:'),
    (3, 2, 'I', 5, chr(10) || 'user:'), (2, 3, 'I', 5, chr(10) || 'assistant:'),
    (0, 3, 'II', 10, chr(10) || 'user:' || chr(10) || 'assistant:'), (1, 3, 'II', 10, chr(10) || 'user:' || chr(10) || 'assistant:')
), dp AS (
    SELECT conv_id, 0::BIGINT AS i, q AS state, {'cost': cost::BIGINT, 'audit': more, 'made': text} AS best FROM sums, ins WHERE p = 0
    UNION ALL
    SELECT conv_id, i, q, min({'cost': c + cost, 'audit': a || more, 'made': m || text}) FROM (
        SELECT dp.conv_id, flt.i, e.q AS at, dp.best.cost + e.c AS c, dp.best.audit || e.edit AS a,
               dp.best.made || CASE WHEN e.edit = 'D' THEN '' WHEN e.edit = 'K' THEN chr(10) || flt.role || ':' || flt.text ELSE chr(10) || e.new || ':' || flt.text END AS m
        FROM dp JOIN flt ON flt.conv_id IS NOT DISTINCT FROM dp.conv_id AND flt.i = dp.i + 1,
        LATERAL (
            SELECT dp.state AS q, 2 AS c, 'D' AS edit, '' AS new
            UNION ALL SELECT step.q, CASE flt.fault WHEN 'truncated' THEN 5 ELSE 0 END, 'K', '' FROM step
                      WHERE step.p = dp.state AND step.initial = flt.role[1] AND flt.fault NOT IN ('blank', 'duplicate')
            UNION ALL SELECT step.q, CASE flt.fault WHEN 'truncated' THEN 6 ELSE 1 END, 'R', CASE step.initial WHEN 'u' THEN 'user' ELSE 'assistant' END FROM step
                      WHERE step.p = dp.state AND step.initial <> 's' AND flt.fault NOT IN ('blank', 'duplicate')
        ) e
    ) x JOIN ins ON ins.p = x.at GROUP BY conv_id, i, q
), done AS (
    SELECT dp.conv_id, min(best) AS best FROM dp JOIN sums ON sums.conv_id IS NOT DISTINCT FROM dp.conv_id AND dp.i = sums.n
    WHERE state IN (0, 3) GROUP BY dp.conv_id
)
SELECT o.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate,
       coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, coalesce(best.cost, 0)::BIGINT AS cost,
       coalesce(best.audit, '') AS audit, sha256(coalesce(substr(best.made, 2), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o
LEFT JOIN sums ON sums.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN done ON done.conv_id IS NOT DISTINCT FROM o.conv_id
"""
