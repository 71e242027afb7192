"""Benchmark decontamination by spaced-seed hashing.

Fixed masks ignore some positions of a window of words. Windows of documents and of benchmark items that agree on a
mask's other positions hash alike; around each such hit the two texts are laid on each other and the overlap counts if
enough of a window's words are the same, whichever of them were substituted.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shutterlake.llm.chunks import Chunk, rows_of, store_chunks, with_messages
from shutterlake.llm.common import copied_join, forget, hot_limit, read, shares_of, stored
from shutterlake.llm.kernels import LETTERS, combined, groups, text_bytes, words

#: For items of at least LEAST_MASKED words: a share of 0.8 leaves 5 successive words with at most one substitution in
#: every window, and one of these masks of weight 4 fits beside it.
MASKS = ("1111", "11011", "10111", "11101")
#: For items of a whole window, more selective: of weight 6, one fits whichever 3 of 16 words are substituted.
LONG_MASKS = ("1111011", "111000001011", "1110111")
#: A document overlaps an item if, somewhere along one alignment, this share of so many successive words is the same.
WINDOW, SHARE = 16, 0.8
#: Items of fewer words are never looked for; those of fewer than LEAST_MASKED must occur word for word.
LEAST_WORDS, LEAST_MASKED = 1, 5
#: A benchmark of up to so many bytes is sent to the tasks as an index; the hashes of a larger one are joined.
BROADCAST_BYTES = 4 << 20
#: Words of a text around a hit that a window with the hit can reach; log2 of the bits that thin out the join.
REACH, FILTER_BITS = 2 * WINDOW, 24

#: Scripts without spaces between words: each of their characters is a word.
UNSPACED = r"([\p{Han}\p{Hiragana}\p{Katakana}\p{Bopomofo}\p{Yi}\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}\p{Tibetan}])"

_WORD = LETTERS.copy()
_WORD[0x30:0x3A] = True
_TABLE_BITS = 20


def gaps(mask: str) -> tuple[int, ...]:
    return tuple(i for i, c in enumerate(mask) if c == "1")


def word_hashes(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Hashes of the lower-cased words of runs of rows, and the bounds of the rows among them."""
    column = pc.utf8_lower(column.cast(pa.large_string()))
    data, offsets = text_bytes(column)
    if (data >= 0xE0).any():  # the first byte of characters from U+0800 on, as all of UNSPACED are
        data, offsets = text_bytes(pc.replace_substring_regex(column, UNSPACED, r" \1 "))
    for a, b in groups(offsets):
        yield words(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], _WORD)


@dataclass
class Index:
    """The items' words one after another, and for each seed shape the sorted hashes with their places."""

    item_ids: list[int]
    words: np.ndarray
    bounds: np.ndarray
    seeds: list[tuple[tuple[int, ...], np.ndarray, np.ndarray, np.ndarray]]


def shapes_of(size: np.ndarray) -> list[tuple[tuple[int, ...], np.ndarray]]:
    """The seed shapes, and of each which items, given their numbers of words, are sought by it."""
    shapes: list[tuple[tuple[int, ...], np.ndarray]] = [(gaps(m), size >= WINDOW) for m in LONG_MASKS]
    shapes += [(gaps(m), (size >= LEAST_MASKED) & (size < WINDOW)) for m in MASKS]
    return shapes + [(tuple(range(n)), size == n) for n in range(LEAST_WORDS, LEAST_MASKED)]


def build(items: list[tuple[int, str | None]]) -> Index:
    """The index of some items, held in memory."""
    column = pa.array([t for _, t in items], pa.large_string())
    parts = list(word_hashes(column))
    shift, bounds = 0, [np.zeros(1, np.int64)]
    for h, at in parts:
        bounds.append(at[1:] + shift)
        shift += len(h)
    all_words = np.concatenate([h for h, _ in parts]) if parts else np.empty(0, np.uint64)
    bounds = np.concatenate(bounds)
    size = np.diff(bounds)
    owner = np.repeat(np.arange(len(size)), size)
    seeds = []
    for shape, which in shapes_of(size):
        h = combined(all_words, shape)
        n = len(h)
        place = np.flatnonzero((owner[:n] == owner[max(shape) :][:n]) & which[owner[:n]]) if n else np.empty(0, np.int64)
        order = np.argsort(h[place], kind="stable")
        place = place[order]
        h = h[place]
        table = np.zeros(1 << _TABLE_BITS, bool)
        table[(h >> np.uint64(64 - _TABLE_BITS)).astype(np.int64)] = True
        seeds.append((shape, h, place, table))
    return Index([i for i, _ in items], all_words, bounds, seeds)


def best_window(doc: np.ndarray, item: np.ndarray, w: int) -> tuple[int, int] | None:
    """Of two runs of words laid on each other the first window of w words with most of them the same, if that is enough.

    Its number of same words and its first word.
    """
    same = doc == item
    if len(same) < w:
        return None
    sums = np.concatenate([[0], np.cumsum(same)])
    sums = sums[w:] - sums[:-w]
    top = int(sums.argmax())
    return (int(sums[top]), top) if sums[top] >= int(np.ceil(SHARE * w - 1e-9)) else None


def find(doc: np.ndarray, places: list[tuple[np.ndarray, np.ndarray]], index: Index) -> list[tuple[int, int, int, int, int]]:
    """(item, same words, window, first word of the document, of the item): the best window per item that overlaps.

    `places`: the document's and the items' word of each hit. Of equal windows the first in the document, then in the
    item counts.
    """
    size = np.diff(index.bounds)
    seen: set[tuple[int, int]] = set()
    best: dict[int, tuple[int, int, int, int, int]] = {}
    for at, place in places:
        item = np.searchsorted(index.bounds, place, side="right") - 1
        for k, d in set(zip(item.tolist(), (at - (place - index.bounds[item])).tolist(), strict=True)):
            if (k, d) in seen:
                continue
            seen.add((k, d))
            a, b = max(0, -d), min(int(size[k]), len(doc) - d)
            w = min(WINDOW, int(size[k]))
            if found := best_window(doc[a + d : b + d], index.words[index.bounds[k] + a : index.bounds[k] + b], w):
                n, top = found
                new = (index.item_ids[k], n, w, a + d + top, a + top)
                if k not in best or (-n, *new[3:]) < (-best[k][1], *best[k][3:]):
                    best[k] = new
    return sorted(best.values(), key=_order)


def _order(found: tuple[int | None, ...]) -> tuple[int, ...]:
    """Overlaps of a text are told by item, then by place."""
    return found[0] is None, found[0] or 0, *found[3:], *found[1:3]


def overlaps(column: pa.Array, index: Index) -> Iterator[list[tuple[int, int, int, int, int]]]:
    """For each text what find() gives."""
    for hashes, at in word_hashes(column):
        hits: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        for shape, keys, place, table in index.seeds:
            if not len(keys):
                continue
            h = combined(hashes, shape)
            maybe = np.flatnonzero(table[(h >> np.uint64(64 - _TABLE_BITS)).astype(np.int64)])
            low = np.searchsorted(keys, h[maybe])
            maybe, low = maybe[low < len(keys)], low[low < len(keys)]
            hit = keys[low] == h[maybe]
            for i, k in zip(maybe[hit].tolist(), low[hit].tolist(), strict=True):
                row = int(np.searchsorted(at, i, side="right")) - 1
                if i + max(shape) < at[row + 1]:
                    end = k + int(np.searchsorted(keys[k:], keys[k], side="right"))
                    hits.setdefault(row, []).append((np.full(end - k, i - at[row]), place[k:end]))
        for row in range(len(at) - 1):
            yield find(hashes[at[row] : at[row + 1]], hits[row], index) if row in hits else []


_HITS = "array<struct<item_id:long,n_same:int,window:int,doc_word:int,item_word:int>>"
_ARROW_HITS = pa.list_(pa.struct([("item_id", pa.int64()), ("n_same", pa.int32()), ("window", pa.int32()), ("doc_word", pa.int32()), ("item_word", pa.int32())]))


_FIELDS = [f.name for f in _ARROW_HITS.value_type]


def _indexed(items, names: list[str]):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = build(items.value)
        for batch in batches:
            found = [[dict(zip(_FIELDS, x, strict=True)) for x in xs] for xs in overlaps(batch.column("text"), index)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(found, _ARROW_HITS)], names=[*names, "overlaps"])

    return scan


_SEED = "shape int, hash long, item_key long, item_id long, size int, item_at int, item_from int, item_words binary"


def _around(words_: np.ndarray, at: int) -> tuple[int, bytes]:
    """The words that windows with the word at this place can reach: the first one's number, and their hashes."""
    low = max(0, at - REACH)
    return low, words_[low : at + REACH].tobytes()


def _item_seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    task, n = TaskContext.get().partitionId(), 0
    for batch in batches:
        ids, row = batch.column("item_id").to_pylist(), 0
        for hashes, at in word_hashes(batch.column("text")):
            size, out = np.diff(at), []
            for number, (shape, which) in enumerate(shapes_of(size)):
                for k in np.flatnonzero(which):
                    own = hashes[at[k] : at[k + 1]]
                    for i, h in enumerate(combined(own, shape).view(np.int64).tolist()):
                        out.append((number, h, (task << 40) + n + int(k), ids[row + k], int(size[k]), i, *_around(own, i)))
            n += len(size)
            row += len(size)
            types = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary())
            columns = list(zip(*out, strict=True)) or [()] * len(types)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=[x.split()[0] for x in _SEED.split(", ")])


_CANDIDATE = "shape int, hash long, chunk_id long, row int, at int, doc_from int, doc_words binary"


def _doc_seeds(bits):
    def seeds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.unpackbits(np.frombuffer(bits.value, np.uint8), bitorder="little").astype(bool)
        shapes = [shape for shape, _ in shapes_of(np.empty(0, np.int64))]
        for line in rows_of(batches):
            c, row = Chunk(line), 0
            for hashes, at in word_hashes(c.texts()):
                out = []
                for number, shape in enumerate(shapes):
                    h = combined(hashes, shape)
                    hits = np.flatnonzero(table[(h >> np.uint64(64 - FILTER_BITS)).astype(np.int64)])
                    owner = np.searchsorted(at, hits, side="right") - 1
                    inside = hits + max(shape) < at[owner + 1]
                    hits, owner = hits[inside], owner[inside]
                    exact = number >= len(LONG_MASKS) + len(MASKS)
                    if exact and len(hits):
                        # The whole item is these words, and the first place of a text is the one that is told.
                        told = np.column_stack([owner.astype(np.uint64), *(hashes[hits + j] for j in shape)])
                        first = np.sort(np.unique(told, axis=0, return_index=True)[1])
                        hits, owner = hits[first], owner[first]
                    for i, k in zip(hits.tolist(), owner.tolist(), strict=True):
                        own, place = hashes[at[k] : at[k + 1]], i - int(at[k])
                        around = (place, own[place : place + len(shape)].tobytes()) if exact else _around(own, place)
                        out.append((number, int(h[i].view(np.int64)), c.id, row + k, place, *around))
                row += len(at) - 1
                types = (pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary())
                columns = list(zip(*out, strict=True)) or [()] * len(types)
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, types, strict=True)], names=[x.split()[0] for x in _CANDIDATE.split(", ")])

    return seeds


_FOUND = "chunk_id long, row int, item_key long, item_id long, n_same int, window int, doc_word int, item_word int"


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for r in batch.to_pylist():
            doc, item = np.frombuffer(r["doc_words"], np.uint64), np.frombuffer(r["item_words"], np.uint64)
            # Both from the same place of the alignment, as far as both go.
            before = min(r["at"] - r["doc_from"], r["item_at"] - r["item_from"])
            doc, item = doc[r["at"] - r["doc_from"] - before :], item[r["item_at"] - r["item_from"] - before :]
            n = min(len(doc), len(item))
            w = min(WINDOW, r["size"])
            if found := best_window(doc[:n], item[:n], w):
                out.append((r["chunk_id"], r["row"], r["item_key"], r["item_id"], found[0], w, r["at"] - before + found[1], r["item_at"] - before + found[1]))
        types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), *(pa.int32(),) * 4)
        columns = list(zip(*out, strict=True)) or [()] * len(types)
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, types, strict=True)], names=[x.split()[0] for x in _FOUND.split(", ")])


_STANDS_FOR = "column_%d"


def _told(names: list[str]):
    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for line in rows_of(batches):
            c = Chunk(line)
            found: list[list[dict]] = [[] for _ in c.doc_ids]
            for m in sorted(line["messages"] or [], key=lambda m: _order(tuple(m[f] for f in _FIELDS))):
                found[m["row"]].append({f: m[f] for f in _FIELDS})
            table, no_text = c.others()
            text = pc.if_else(no_text, pa.scalar(None, pa.large_string()), c.texts()).cast(pa.string())
            columns = [text if n == "text" else table.column(_STANDS_FOR % i).combine_chunks() for i, n in enumerate(names)]
            told = pa.Table.from_arrays([*columns, pa.array(found, _ARROW_HITS)], names=[*names, "overlaps"])
            yield from told.to_batches(max_chunksize=512)

    return tell


def _joined(docs: DataFrame, benchmark: DataFrame, names: list[str], schema: str) -> DataFrame:
    """The overlaps by a join of hashes. Documents stay in their chunks; only the words around possible hits travel."""
    spark = docs.sparkSession
    # Whatever names and types the other columns have, they wait under names of their own.
    others = [F.col(f"`{n}`").alias(_STANDS_FOR % i) for i, n in enumerate(names) if n != "text"]
    chunks = store_chunks(docs.select(F.lit(None).cast("long").alias("doc_id"), "text", *others), "benchmark")
    seeds = stored(benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").mapInArrow(_item_seeds, _SEED), "seeds")
    # One bit for each value of a hash's first bits: at most 2 ** FILTER_BITS / 64 numbers reach the driver.
    cell = F.shiftrightunsigned("hash", 64 - FILTER_BITS)
    filled = seeds.select(F.shiftright(cell, 6).cast("int").alias("word"), F.expr("shiftleft(1L, cast(hash >>> %d & 63 as int))" % (64 - FILTER_BITS)).alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits"))
    bits = np.zeros(1 << FILTER_BITS - 6, np.int64)
    for r in filled.collect():
        bits[r.word] = r.bits
    candidates = stored(chunks.drop("others").mapInArrow(_doc_seeds(spark.sparkContext.broadcast(bits.tobytes())), _CANDIDATE), "candidates")
    keyed = lambda df: df.withColumn("seed", F.struct("shape", "hash")).drop("shape", "hash")
    # A hash that very many places of the corpus have, as that of an item of one common word, is dealt to several tasks.
    shares = shares_of(keyed(candidates), "seed", hot_limit(candidates.count()))
    found = copied_join(keyed(candidates), keyed(seeds), "seed", ["chunk_id", "row", "at"], shares).mapInArrow(_verified, _FOUND)
    best = found.groupBy("chunk_id", "row", "item_key", "item_id", "window").agg(F.min(F.struct((-F.col("n_same")).alias("minus"), "doc_word", "item_word")).alias("b"))
    best = best.select("chunk_id", "row", "item_key", "item_id", (-F.col("b.minus")).alias("n_same"), "window", "b.doc_word", "b.item_word")
    out = stored(with_messages(chunks, best, keep_all=True).mapInArrow(_told(names), schema), "overlaps")
    for table in (chunks, seeds, candidates):
        forget(table)
    return out


def with_overlaps(docs: DataFrame, benchmark: DataFrame, keep_text: bool = True, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """docs(text, ...) with overlaps, an array of the benchmark items that overlap each text, one row for each row.

    The hashes of benchmark(item_id, text) are joined with those of the texts: by an index that is sent to the tasks
    where the benchmark has up to broadcast_bytes, else by a shuffle; both give the same. Null and empty texts overlap
    nothing, and so do null and empty items; an item of fewer than LEAST_MASKED words must occur word for word. In
    scripts without spaces each character counts as a word. Texts and items of any length are read whole. Of an item's
    windows that overlap equally the first in the text, then in the item is told. Repeated items give repeated
    overlaps, repeated rows the same ones; without items no text has any, without rows there are none. Other columns
    pass unchanged, one named overlaps is replaced.
    """
    spark = docs.sparkSession
    total = benchmark.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first().n
    columns = [c for c in docs.columns if c != "overlaps"]
    rows = docs.select(*columns)
    names = columns if keep_text else [c for c in columns if c != "text"]
    types = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    schema = ", ".join([*(f"`{c}` {types[c]}" for c in names), f"overlaps {_HITS}"])
    if total > broadcast_bytes:
        return _joined(rows, benchmark, names, schema)
    items = spark.sparkContext.broadcast([(r.item_id, r.text) for r in benchmark.where(F.octet_length("text") > 0).select("item_id", "text").orderBy("item_id", "text").collect()])  # at most broadcast_bytes
    return rows.mapInArrow(_indexed(items, names), schema)


def decontaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs whose text overlaps no benchmark item; see with_overlaps()."""
    return with_overlaps(docs, benchmark).where(F.size("overlaps") == 0).select(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op8: a row for each document and benchmark item that overlap."""
    docs, items = read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark")
    return with_overlaps(docs.select("doc_id", "text"), items, keep_text=False).selectExpr("doc_id", "inline(overlaps)")
