"""Vector best-fit packing of documents into sequences.

A piece is a vector (tokens, one document, attention cost = tokens squared), a sequence has a capacity in each. Since
the vector follows from the length, pieces are packed by their counts per length, a table bounded by the sequence
length: each length, longest first, goes to the open kind of sequence whose residual capacities it fits best. The
plan, ranges of ranks per length, is then joined to the pieces.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from shutterlake.llm.common import forget, read, stored
from shutterlake.llm.tokenizing import VOCABULARY, encoder


@dataclass(frozen=True)
class Capacity:
    """What one sequence may hold; the attention cost of a piece is its length squared."""

    tokens: int = 2048
    documents: int = 2048
    attention: int = 2048 * 2048
    #: How a kind of sequence is chosen: least "residual" norm after the piece, or greatest "dot" product of the
    #: piece's and the residual's shares of the capacities.
    rule: str = "residual"
    weights: tuple[float, float, float] = (1.0, 0.1, 0.1)


def plan_packing(counts: dict[int, int], cap: Capacity = Capacity()) -> list[tuple[int, int, int, int, int]]:
    """Rows (length, first rank, end rank, first sequence, offset): rank r of a length goes to sequence first + r - first rank.

    Every length must fit an empty sequence. Work and result grow with the number of different lengths, not of pieces.
    """
    if any(not (0 < n <= cap.tokens and n * n <= cap.attention) for n in counts) or cap.documents < 1:
        raise ValueError("a piece is longer than a sequence may be")
    size = np.array([cap.tokens, cap.documents, cap.attention], float)
    weights = np.array(cap.weights)
    # Kinds of open sequences: residual capacities, and the runs of sequences (first, count) that are of this kind.
    left = np.empty((0, 3), np.int64)
    runs: list[list[tuple[int, int]]] = []
    index: dict[tuple[int, int, int], int] = {}
    plan: list[tuple[int, int, int, int, int]] = []
    made = 0

    def add(residual: np.ndarray, run: tuple[int, int]) -> None:
        nonlocal left
        key = tuple(int(x) for x in residual)
        if key[0] == 0 or key[1] == 0 or key[2] == 0:
            return
        if key not in index:
            index[key] = len(runs)
            runs.append([])
            left = np.vstack([left, residual[None]])
        runs[index[key]].append(run)

    for length in sorted(counts, reverse=True):
        item = np.array([length, 1, length * length], np.int64)
        rank, end = 0, counts[length]
        while rank < end:
            fits = np.flatnonzero((left >= item).all(axis=1) & np.fromiter(map(bool, runs), bool, len(runs)))
            if not len(fits):
                break
            if cap.rule == "dot":
                score = -((left[fits] / size) * (item / size) * weights).sum(axis=1)
            else:
                score = (weights * ((left[fits] - item) / size) ** 2).sum(axis=1)
            kind = int(fits[np.lexsort((left[fits, 0], score))[0]])
            residual = left[kind].copy()
            first, n = runs[kind].pop()
            # By the residual's norm a sequence that has just got a piece fits the next one best, as long as it fits.
            each = 1 if cap.rule == "dot" else min(int(x) for x in residual // item)
            copies = min(each, end - rank)
            take = min(n, (end - rank) // copies)
            if take < n:
                runs[kind].append((first + take, n - take))
            for slot in range(copies):
                plan.append((length, rank, rank + take, first, cap.tokens - int(residual[0]) + slot * length))
                rank += take
            add(residual - copies * item, (first, take))
        fresh = end - rank
        each = min(cap.tokens // length, cap.documents, cap.attention // (length * length))
        for n, copies in ((fresh // each, each), (1 if fresh % each else 0, fresh % each)):
            if not n:
                continue
            for slot in range(copies):
                plan.append((length, rank, rank + n, made, slot * length))
                rank += n
            add(np.array([cap.tokens, cap.documents, cap.attention], np.int64) - copies * item, (made, n))
            made += n
    return plan


_PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long, task int, nth long"


def _pieces(vocabulary: str, tokens: int):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary).ids
        task = TaskContext.get().partitionId()
        seen = np.zeros(tokens + 1, np.int64)
        for batch in batches:
            rows: tuple[list, ...] = ([], [], [], [], [], [])
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                ids = np.append(encode(text.as_py() or ""), np.zeros(1, "<u4")).astype("<u4")
                first = len(ids) % tokens or min(tokens, len(ids))
                bounds = [0, *range(first, len(ids) + 1, tokens)]
                for piece, (a, b) in enumerate(zip(bounds, bounds[1:], strict=False)):
                    for column, value in zip(rows, (doc_id, piece, a, b - a, zlib.crc32(ids[a:b].tobytes()), int(seen[b - a])), strict=True):
                        column.append(value)
                    seen[b - a] += 1
            doc_id, piece, start, length, crc, nth = rows
            yield pa.RecordBatch.from_arrays(
                [pa.array(doc_id, pa.int64()), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64()), pa.array([task] * len(piece), pa.int32()), pa.array(nth, pa.int64())],
                names=["doc_id", "piece", "start", "length", "ids_crc32", "task", "nth"],
            )

    return cut


def pack_pieces(pieces: DataFrame, cap: Capacity = Capacity()) -> DataFrame:
    """Adds sequence_id and offset to stored pieces(length, task, nth), nth counting a task's pieces of that length.

    Ranks of a length come from the counts per task, so that no task gathers a length's pieces.
    """
    spark = pieces.sparkSession
    per_task = pieces.groupBy("length", "task").agg(F.count(F.lit(1)).alias("n"))
    base = F.sum("n").over(Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1))
    per_task = per_task.withColumn("base", F.coalesce(base, F.lit(0)))
    # At most cap.tokens rows.
    counts = {r.length: r.n for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    plan = spark.createDataFrame(plan_packing(counts, cap), "length long, rank_from long, rank_to long, sequence_from long, offset long")
    ranked = pieces.join(per_task.drop("n"), ["length", "task"]).withColumn("rank", F.col("base") + F.col("nth"))
    # The plan is bounded by the different lengths and kinds of sequence (some tens of thousands of small rows).
    placed = ranked.join(F.broadcast(plan), (ranked.length == plan.length) & (F.col("rank") >= F.col("rank_from")) & (F.col("rank") < F.col("rank_to")))
    return placed.select(*[ranked[c] for c in pieces.columns if c not in ("task", "nth")], (F.col("sequence_from") + F.col("rank") - F.col("rank_from")).alias("sequence_id"), "offset")


def pack_documents(docs: DataFrame, cap: Capacity = Capacity(), vocabulary: str = VOCABULARY) -> DataFrame:
    """Packs docs(doc_id, text) into sequences: one row per piece, with its place.

    A document is its text's ids and then id 0. Only documents of more than cap.tokens are cut: the first piece takes
    what is over whole pieces, whatever the text's length. Null and empty texts are the lone id 0. Rows with a null or
    repeated doc_id are packed like others; pieces of equal length are interchangeable, and so may change places from
    run to run. Tables without rows give none; extra columns are ignored.
    """
    pieces = stored(docs.select("doc_id", "text").mapInArrow(_pieces(vocabulary, cap.tokens), _PIECE), "pieces")
    out = stored(pack_pieces(pieces, cap), "packed")
    forget(pieces)
    return out


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op1: all documents in sequences of at most 2048 tokens."""
    return pack_documents(read(spark, sf_dir, "documents"))
