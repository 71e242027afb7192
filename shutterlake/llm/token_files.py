"""Token ids in binary shards under Re-Pair grammars.

Documents go in ascending doc_id order to shards of some hundred thousand ids. In each shard frequent pairs of
neighbouring ids are replaced by nonterminals again and again; the shard stores the rules, how many ids each nonterminal
stands for, and what is left of the sequence. A document, or any range of its ids, is decoded by expanding its own
symbols alone.

A shard's bytes: magic, counts, then little-endian arrays one after another (see Shard), and their CRC-32.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from shutterlake.llm.common import partitions_of, read, remove, shared_dir, stored
from shutterlake.llm.tokenizing import VOCABULARY, encoder

#: Ids of a shard; a longer document is a shard of its own.
SHARD_IDS = 1 << 18
MAGIC = b"RPSHARD1"
_COUNTS = struct.Struct("<6q")  # documents, ids, symbols, rules, first nonterminal, bytes of a symbol's upper part

#: Pairs are counted in so many cells, and replaced while they occur at least LEAST times; every round admits pairs that
#: are FALL times as rare as those of the round before.
_CELL_BITS, LEAST, FALL = 18, 4, 8


def repair(ids: np.ndarray, ends: np.ndarray, base: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbols, which of them end a document, and the rules (left, right) of the nonterminals base, base + 1, ...

    All pairs that are frequent enough are replaced in one pass of a round, left to right where they overlap; a pair
    doesn't cross a document's end. Pairs that meet in one cell wait for a round that deals the cells in another way.
    """
    x, ends = ids.astype(np.uint32), ends.copy()
    rules: list[np.ndarray] = []
    top, limit, turn = base, 0, 0
    while len(x) > 1:
        turn += 1
        cell = x[:-1] * np.uint32((0x9E3779B1 * (2 * turn + 1)) & 0xFFFFFFFF) + x[1:] * np.uint32((0x85EBCA77 * (2 * turn + 1)) & 0xFFFFFFFF)
        cell ^= cell >> np.uint32(15)
        cell *= np.uint32(0x2C1B3C6D)
        cell = (cell >> np.uint32(32 - _CELL_BITS)).astype(np.intp)
        many = np.bincount(cell, minlength=1 << _CELL_BITS)
        limit = limit or max(LEAST, int(many.max()) // FALL)
        at = np.flatnonzero((many >= limit).take(cell))
        at = at[~ends[at]]
        cell = cell[at]
        pair = x[at].astype(np.uint64) << np.uint64(32) | x[at + 1]
        owner = np.zeros(1 << _CELL_BITS, np.uint64)
        owner[cell] = pair
        mine = owner[cell] == pair
        at, cell = at[mine], cell[mine]
        frequent = (np.bincount(cell, minlength=1 << _CELL_BITS) >= limit)[cell]
        at, cell = at[frequent], cell[frequent]
        # In a run of overlapping pairs every other one counts; what then occurs once only stays as it is.
        place = np.arange(len(at))
        begins = np.diff(at, prepend=-2) != 1
        every_other = (place - np.maximum.accumulate(np.where(begins, place, 0))) % 2 == 0
        at, cell = at[every_other], cell[every_other]
        used = np.bincount(cell, minlength=1 << _CELL_BITS) >= max(2, limit // 2)
        at, cell = at[used[cell]], cell[used[cell]]
        if len(at):
            cells = np.flatnonzero(used)
            symbol = np.zeros(1 << _CELL_BITS, np.uint32)
            symbol[cells] = top + np.arange(len(cells), dtype=np.uint32)
            rules.append(np.stack([(owner[cells] >> np.uint64(32)).astype(np.uint32), owner[cells].astype(np.uint32)], axis=1))
            top += len(cells)
            x[at] = symbol[cell]
            ends[at] = ends[at + 1]
            stays = np.ones(len(x), bool)
            stays[at + 1] = False
            stays = np.flatnonzero(stays)
            x, ends = x[stays], ends[stays]
        if limit == LEAST and len(at) * 50 < len(x):
            break
        limit = max(LEAST, limit // FALL)
    return x, ends, np.concatenate(rules) if rules else np.empty((0, 2), np.uint32)


def _lengths(rules: np.ndarray, base: int) -> np.ndarray:
    """How many ids each nonterminal stands for; a rule's symbols are older than it."""
    out = np.zeros(len(rules), np.int64)
    known = 0
    while known < len(rules):
        # Rules whose symbols are all known already, as a run: those of a round at least.
        inner = rules[known:].max(axis=1).astype(np.int64) - base
        end = known + int(np.argmax(inner >= known)) if (inner >= known).any() else len(rules)
        for side in (0, 1):
            symbol = rules[known:end, side].astype(np.int64) - base
            out[known:end] += np.where(symbol < 0, 1, out[np.maximum(symbol, 0)])
        known = end
    return out


def pack_shard(doc_ids: np.ndarray, null_ids: np.ndarray, sizes: np.ndarray, ids: np.ndarray) -> bytes:
    """One shard of documents with so many ids each, which follow one another in `ids`."""
    ends = np.zeros(len(ids), bool)
    ends[np.cumsum(sizes) - 1] = True
    base = int(ids.max(initial=0)) + 1
    symbols, last, rules = repair(ids, ends, base)
    upper = symbols >> np.uint32(16)
    width = 0 if not upper.any() else 1 if int(upper.max()) < 256 else 2
    arrays = [
        doc_ids.astype("<i8"),
        null_ids.astype("u1"),
        np.append(0, np.flatnonzero(last) + 1).astype("<i8"),
        np.append(0, np.cumsum(sizes)).astype("<i8"),
        rules.astype("<u4"),
        _lengths(rules, base).astype("<u4"),
        symbols.astype("<u2"),
        upper.astype(f"<u{width}") if width else upper[:0],
    ]
    body = b"".join([MAGIC, _COUNTS.pack(len(doc_ids), len(ids), len(symbols), len(rules), base, width), *(a.tobytes() for a in arrays)])
    return body + struct.pack("<I", zlib.crc32(body))


@dataclass
class Shard:
    """A shard's bytes, opened; a damaged one raises."""

    data: bytes | pa.Buffer

    def __post_init__(self) -> None:
        view = memoryview(self.data)
        if bytes(view[:8]) != MAGIC or struct.unpack("<I", view[-4:])[0] != zlib.crc32(view[:-4]):
            raise ValueError("not a shard of token ids, or a damaged one")
        docs, self.n_ids, symbols, rules, self.base, width = _COUNTS.unpack_from(view, 8)
        at = 8 + _COUNTS.size

        def take(kind: str, n: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(view, kind, n, at)
            at += out.nbytes
            return out

        self.doc_ids, self.null_ids = take("<i8", docs), take("u1", docs).astype(bool)
        self.symbols_from, self.ids_from = take("<i8", docs + 1), take("<i8", docs + 1)
        self.rules, self.lengths = take("<u4", 2 * rules).reshape(-1, 2), take("<u4", rules)
        self.symbols = take("<u2", symbols).astype(np.uint32)
        if width:
            self.symbols |= take(f"<u{width}", symbols).astype(np.uint32) << np.uint32(16)
        self._whole: tuple[np.ndarray, np.ndarray] | None = None

    def _sizes(self, symbols: np.ndarray) -> np.ndarray:
        out = np.ones(len(symbols), np.int64)
        inner = symbols >= self.base
        out[inner] = self.lengths[symbols[inner] - self.base]
        return out

    def _expand(self, symbols: np.ndarray) -> np.ndarray:
        """All ids that the symbols stand for: every pass replaces the nonterminals by their rules."""
        while (inner := symbols >= self.base).any():
            places = np.cumsum(inner + 1) - 1  # of the last symbol that each becomes
            out = np.empty(places[-1] + 1, np.uint32)
            out[places[~inner]] = symbols[~inner]
            pairs = self.rules[symbols[inner] - self.base]
            out[places[inner] - 1], out[places[inner]] = pairs[:, 0], pairs[:, 1]
            symbols = out
        return symbols

    def all_ids(self) -> np.ndarray:
        """The ids of all documents, one after another."""
        return self._expand(self.symbols)

    def ids(self, nth: int, first: int = 0, end: int | None = None) -> np.ndarray:
        """Ids first to end of the nth document: only the symbols that cover them are expanded."""
        symbols = self.symbols[self.symbols_from[nth] : self.symbols_from[nth + 1]]
        bounds = np.append(0, np.cumsum(self._sizes(symbols)))
        first, end = max(0, first), min(int(bounds[-1]), int(bounds[-1]) if end is None else end)
        if first >= end:
            return np.empty(0, np.uint32)
        a, b = int(np.searchsorted(bounds, first, side="right")) - 1, int(np.searchsorted(bounds, end))
        return self._expand(symbols[a:b])[first - bounds[a] : end - bounds[a]]


_SHARD = "task int, shard long, start_in_task long, n_ids long, doc_ids array<bigint>, bytes binary"


def _write(vocabulary: str):
    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary).ids
        task, nth, before = TaskContext.get().partitionId(), 0, 0
        keys: list[int | None] = []
        held: list[np.ndarray] = []
        size = 0

        def flush() -> pa.RecordBatch:
            nonlocal nth, before, size
            null = np.array([k is None for k in keys])
            packed = pack_shard(np.array([k or 0 for k in keys], np.int64), null, np.array([len(x) for x in held], np.int64), np.concatenate(held))
            row = [[task], [(task << 32) + nth], [before], [size], [list(keys)], [packed]]
            nth, before, size = nth + 1, before + size, 0
            keys.clear()
            held.clear()
            kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(row, kinds, strict=True)], names=["task", "shard", "start_in_task", "n_ids", "doc_ids", "bytes"])

        for batch in batches:
            for key, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                ids = np.append(encode(text.as_py() or ""), np.zeros(1, "<u4"))
                if held and size + len(ids) > SHARD_IDS:
                    yield flush()
                keys.append(key)
                held.append(ids)
                size += len(ids)
        if held:
            yield flush()

    return shards


def write_tokens(docs: DataFrame, root: str, vocabulary: str = VOCABULARY) -> None:
    """Writes the ids of docs(doc_id, text), each document's followed by id 0, to `root` in ascending doc_id order.

    Null doc_ids come first, rows of one doc_id in the order of a hash of their texts; a null or empty text is the lone
    id 0. A text of any length is encoded whole. An empty table gives no shards; extra columns are ignored.
    """
    order = ["doc_id", F.xxhash64(F.coalesce("text", F.lit("")))]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = rows.repartitionByRange(partitions_of(docs), *order).sortWithinPartitions(*order)
    rows.mapInArrow(_write(vocabulary), _SHARD).write.option("compression", "zstd").parquet(root)


def _placed(spark: SparkSession, root: str) -> DataFrame:
    """The shards, each with the number of all ids before it: sums run over one row per task, not over shards."""
    shards = spark.read.schema(_SHARD).parquet(root)
    per_task = shards.groupBy("task").agg(F.sum("n_ids").alias("n"))
    before = F.sum("n").over(Window.orderBy("task").rowsBetween(Window.unboundedPreceding, -1))
    # As many rows as tasks wrote.
    base = per_task.select(F.col("task").alias("of_task"), F.coalesce(before, F.lit(0)).alias("base"))
    return shards.join(F.broadcast(base), F.col("task") == F.col("of_task")).withColumn("start", F.col("base") + F.col("start_in_task"))


_TOKENS = "doc_id long, start long, n_tokens long, ids binary"


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start, data in zip(batch.column("start").to_pylist(), batch.column("bytes"), strict=True):
            shard = Shard(data.as_buffer())
            ids, offsets = shard.all_ids().astype("<u4"), shard.ids_from
            sizes = np.diff(offsets)
            binary = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer((offsets * 4).tobytes()), pa.py_buffer(ids.tobytes())])
            yield pa.RecordBatch.from_arrays([pa.array(shard.doc_ids, pa.int64(), mask=shard.null_ids), pa.array(start + offsets[:-1], pa.int64()), pa.array(sizes, pa.int64()), binary.cast(pa.binary())], names=["doc_id", "start", "n_tokens", "ids"])


def read_tokens(spark: SparkSession, root: str) -> DataFrame:
    """Every document of the files: doc_id, ids before it, number of ids, and the ids as little-endian unsigned 32-bit numbers."""
    return _placed(spark, root).select("start", "bytes").mapInArrow(_read, _TOKENS)


_RANGE = "doc_id long, first long, end long, ids binary"
#: Ranges that one row of a shard's requests holds.
_ASKED = 1024


def _fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for data, asked in zip(batch.column("bytes"), batch.column("asked").to_pylist(), strict=True):
            shard = Shard(data.as_buffer())
            found = [shard.ids(a["nth"], a["first"], a["end"]).astype("<u4").tobytes() for a in asked]
            columns = [[a[c] for a in asked] for c in ("doc_id", "first", "end")]
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in columns), pa.array(found, pa.binary())], names=["doc_id", "first", "end", "ids"])


def fetch_ranges(spark: SparkSession, root: str, wanted: DataFrame) -> DataFrame:
    """Ids first to end (not included) of documents, for the different rows of wanted(doc_id, first, end).

    Only shards that hold a wanted document are opened, and only the symbols that cover the range are expanded. Ranges
    beyond the document give what there is of them, unknown documents nothing, repeated doc_ids one row for each document.
    """
    shards = spark.read.schema(_SHARD).parquet(root)
    places = shards.select("shard", F.posexplode("doc_ids").alias("nth", "doc_id")).where(F.col("doc_id").isNotNull())
    asked = wanted.select(*(F.col(c).cast("long").alias(c) for c in ("doc_id", "first", "end"))).distinct().join(places, "doc_id")
    order = Window.partitionBy("shard").orderBy("doc_id", "nth", "first", "end")
    asked = asked.withColumn("part", F.floor((F.row_number().over(order) - 1) / _ASKED))
    asked = asked.groupBy("shard", "part").agg(F.collect_list(F.struct("doc_id", "nth", "first", "end")).alias("asked"))
    return shards.select("shard", "bytes").join(asked, "shard").select("bytes", "asked").mapInArrow(_fetch, _RANGE)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op12: the ids of every document, written to files and read back."""
    root = f"{shared_dir(spark)}/shutterlake-tokens-{uuid.uuid4().hex}"
    write_tokens(read(spark, sf_dir, "documents"), root)
    out = stored(read_tokens(spark, root).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32")), "tokens")
    remove(spark, root)
    return out
