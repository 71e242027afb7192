"""Nearest vectors, mean vectors, density clusters."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from shutterlake.functions.vectors import dot, l2_normalize
from shutterlake.operators import hdbscan, metric
from shutterlake.operators.hdbscan import labels as density_labels
from shutterlake.operators.running import running
from shutterlake.session import ship_package


def similar(embeddings: DataFrame, query: str, k: int = 20) -> DataFrame:
    """The k rows of embeddings(path, embedding) most like that of the query path, itself excluded."""
    if k < 1:
        raise ValueError("k must be at least 1")
    vector = embeddings.where(F.col("path") == query).select(F.col("embedding").alias("q")).limit(1)
    if vector.isEmpty():
        raise ValueError(f"no embedding of {query}")
    q = F.broadcast(vector)  # one row
    scored = embeddings.where(F.col("path") != query).join(q).select("path", dot(F.col("embedding"), F.col("q")).alias("score"))
    return scored.orderBy(F.desc("score"), "path").limit(k)


def similar_batch(embeddings: DataFrame, queries: DataFrame, k: int = 20) -> DataFrame:
    """(query, path, score, rank): the k rows most like each of queries(path, embedding), itself excluded, by a metric index."""
    return metric.nearest(embeddings, queries, k)


def lookup(embeddings: DataFrame, paths: DataFrame) -> DataFrame:
    """paths(path), as often as they are given, with embedding, null for those that have none."""
    return paths.select("path").join(embeddings.select("path", "embedding"), "path", "left")


#: Keys whose sums one task holds; with more it sends what it has and begins again.
KEYS_HELD = 1 << 14


def _sums(key: str):
    """Sum and number of each key's vectors among those that a task reads: one vector travels for each of its keys."""

    def stage(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}

        def flush() -> pa.RecordBatch:
            keys = pa.array(list(held), kind)
            out = [keys, pa.array([n for n, _ in held.values()], pa.int64()), pa.array([x for _, x in held.values()], pa.list_(pa.float64()))]
            held.clear()
            return pa.RecordBatch.from_arrays(out, names=["key", "n", "x"])

        kind = None
        for batch in batches:
            have = batch.filter(pc.is_valid(batch.column("embedding")))
            kind = batch.column(key).type
            if not len(have):
                continue
            vectors, coded = have.column("embedding"), have.column(key).dictionary_encode("encode")
            codes, names = coded.indices.to_numpy(), coded.dictionary.to_pylist()
            sizes = pc.list_value_length(vectors).to_numpy()
            for size in np.unique(sizes):
                rows = np.flatnonzero(sizes == size)
                x = vectors.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(rows), size)
                order = np.argsort(codes[rows], kind="stable")
                begins = np.flatnonzero(np.diff(codes[rows][order], prepend=-1))
                for code, n, total in zip(codes[rows][order][begins], np.diff(np.append(begins, len(rows))), np.add.reduceat(x[order], begins, axis=0), strict=True):
                    before = held.get(names[code], (0, 0.0))
                    if before[0] and len(before[1]) != size:
                        raise ValueError(f"vectors of {names[code]!r} differ in length")
                    held[names[code]] = before[0] + int(n), before[1] + total
            if len(held) >= KEYS_HELD:
                yield flush()
        if held:
            yield flush()

    return stage


def mean_vectors(vectors: DataFrame, key: str) -> DataFrame:
    """(key, embedding): the unit vector along the mean of each key's vectors.

    Tasks add what they read of a key, so that one vector and a count are shuffled for each key and task. Rows without a
    vector don't count; a key's vectors must have one length, and nulls in them count as NaN.
    """
    ship_package(vectors.sparkSession)
    schema = f"key {vectors.schema[key].dataType.simpleString()}, n long, x array<double>"
    parts = vectors.select(key, "embedding").mapInArrow(_sums(key), schema)
    # At most a few partial sums for each task.
    lists = parts.groupBy("key").agg(F.sum("n").alias("n"), F.collect_list("x").alias("xs"))
    total = F.aggregate(F.slice("xs", 2, F.size("xs")), F.get("xs", F.lit(0)), lambda a, b: F.zip_with(a, b, lambda p, q: p + q))
    return lists.select(F.col("key").alias(key), l2_normalize(F.transform(total, lambda v: v / F.col("n"))).alias("embedding"))


#: Up to so many rows, density clustering runs in one task; beyond that, in pairs of blocks of BLOCK vectors.
MOST_CLUSTERED, BLOCK = 10_000, 4096
#: Rows of a block whose distances to another block are held at once.
_AT_ONCE = 512


def cluster(embeddings: DataFrame, paths: DataFrame | None = None, min_cluster_size: int = 5) -> DataFrame:
    """(path, label) of the slice of embeddings named by `paths`(path), -1 where density is too low.

    Any number of rows is clustered, none is sampled. Beyond MOST_CLUSTERED rows, tasks compare blocks of vectors, which
    takes time by the square of the rows; the driver holds the spanning tree, a few numbers a row.
    """
    if min_cluster_size < 2:
        raise ValueError("a cluster has at least 2 members")
    slice_ = embeddings if paths is None else embeddings.join(F.broadcast(paths.select("path").distinct()), "path", "left_semi")
    n = slice_.count()
    if n < min_cluster_size:
        raise ValueError(f"{n} rows can't make a cluster of {min_cluster_size}")
    if n > MOST_CLUSTERED:
        return _cluster_blocks(slice_.select("path", "embedding"), min_cluster_size)

    def run(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("path")
        return pd.DataFrame({"path": f.path, "label": density_labels(np.stack(f.embedding.to_numpy()), min_cluster_size)})

    return slice_.select("path", "embedding", F.lit(0).alias("one")).groupBy("one").applyInPandas(lambda f: run(f), "path string, label int")


def _in_blocks(rows: DataFrame) -> tuple[DataFrame, int]:
    """(lo, paths, x) of each block of BLOCK rows in the order of paths: its first row's number, its unit vectors; and n."""
    ordered = rows.orderBy("path").persist()
    size = BLOCK

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield pd.DataFrame({"p": [TaskContext.get().partitionId()], "n": [sum(len(f) for f in frames)]})

    counts = dict(ordered.select("path").mapInPandas(count, "p int, n long").collect())  # one per partition
    before = dict(zip(sorted(counts), np.cumsum([0, *(counts[p] for p in sorted(counts))]).tolist()))

    def number(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at = before[TaskContext.get().partitionId()]
        for f in frames:
            i = np.arange(at, at + len(f))
            at += len(f)
            yield f.assign(i=i, block=i // size)

    def pack(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("i")
        x = hdbscan.unit(np.stack(f.embedding.to_numpy()))
        return pd.DataFrame({"lo": [int(f.i.iloc[0])], "paths": [f.path.tolist()], "x": [x.tobytes()]})

    numbered = ordered.mapInPandas(number, "path string, embedding array<double>, i long, block long")
    blocks = numbered.groupBy("block").applyInPandas(pack, "lo long, paths array<string>, x binary").persist()
    n = sum(r.n for r in blocks.select(F.size("paths").alias("n")).collect())
    ordered.unpersist()
    return blocks, n


def _pairs(blocks: DataFrame, n: int) -> DataFrame:
    """Each block (lo, n, x) with each block (lo2, n2, x2)."""
    one = blocks.select("lo", F.size("paths").alias("n"), "x").repartition(-(-n // BLOCK))
    other = one.select(F.col("lo").alias("lo2"), F.col("n").alias("n2"), F.col("x").alias("x2"))
    return one.crossJoin(other)


def _core_distances(blocks: DataFrame, n: int, k: int) -> np.ndarray:
    """Each row's distance to the k-th nearest, itself included."""

    def near(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for r in f.itertuples():
                x, y = np.frombuffer(r.x).reshape(r.n, -1), np.frombuffer(r.x2).reshape(r.n2, -1)
                m = min(k, r.n2)
                best = [np.partition(np.clip(1 - x[i : i + _AT_ONCE] @ y.T, 0, 2), m - 1, axis=1)[:, :m] for i in range(0, r.n, _AT_ONCE)]
                yield pd.DataFrame({"lo": [r.lo], "n": [r.n], "d": [np.concatenate(best).tobytes()]})

    def kth(f: pd.DataFrame) -> pd.DataFrame:
        d = np.concatenate([np.frombuffer(r.d).reshape(r.n, -1) for r in f.itertuples()], axis=1)
        return pd.DataFrame({"lo": f.lo.iloc[:1], "d": [np.partition(d, k - 1, axis=1)[:, k - 1].tobytes()]})

    found = _pairs(blocks, n).mapInPandas(near, "lo long, n int, d binary").groupBy("lo").applyInPandas(kth, "lo long, d binary").collect()
    return np.concatenate([np.frombuffer(r.d) for r in sorted(found)])


def _nearest(blocks: DataFrame, n: int, core: np.ndarray):
    """nearest() for hdbscan.spanning_tree()."""
    context = blocks.sparkSession.sparkContext
    cores = context.broadcast(core)

    def nearest(ask: np.ndarray, part: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sent = context.broadcast((ask, part))

        def least(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            ask, part = sent.value
            core = cores.value
            for f in frames:
                for r in f.itertuples():
                    rows = np.flatnonzero(ask[r.lo : r.lo + r.n])
                    if not len(rows):
                        continue
                    x, y = np.frombuffer(r.x).reshape(r.n, -1), np.frombuffer(r.x2).reshape(r.n2, -1)
                    there = slice(r.lo2, r.lo2 + r.n2)
                    height, to = np.empty(len(rows)), np.empty(len(rows), np.int64)
                    for a in range(0, len(rows), _AT_ONCE):
                        own = rows[a : a + _AT_ONCE]
                        reach = np.clip(1 - x[own] @ y.T, 0, 2)
                        np.maximum(reach, core[there], out=reach)
                        np.maximum(reach, core[r.lo + own][:, None], out=reach)
                        reach[part[r.lo + own][:, None] == part[there]] = np.inf
                        j = reach.argmin(axis=1)
                        height[a : a + len(own)], to[a : a + len(own)] = reach[np.arange(len(own)), j], j + r.lo2
                    yield pd.DataFrame({"lo": [r.lo], "lo2": [r.lo2], "h": [height.tobytes()], "t": [to.tobytes()]})

        def best(f: pd.DataFrame) -> pd.DataFrame:
            f = f.sort_values("lo2")  # at equal heights the lesser row comes first
            h, t = np.stack([np.frombuffer(b) for b in f.h]), np.stack([np.frombuffer(b, np.int64) for b in f.t])
            top = h.argmin(axis=0), np.arange(h.shape[1])
            return pd.DataFrame({"lo": f.lo.iloc[:1], "h": [h[top].tobytes()], "t": [t[top].tobytes()]})

        found = sorted(_pairs(blocks, n).mapInPandas(least, "lo long, lo2 long, h binary, t binary").groupBy("lo").applyInPandas(best, "lo long, h binary, t binary").collect())
        sent.destroy()
        return np.concatenate([np.frombuffer(r.h) for r in found]), np.concatenate([np.frombuffer(r.t, np.int64) for r in found])

    return nearest


def _cluster_blocks(rows: DataFrame, min_cluster_size: int) -> DataFrame:
    blocks, n = _in_blocks(rows)
    core = _core_distances(blocks, n, min_cluster_size)
    found = hdbscan.tree_labels(n, hdbscan.spanning_tree(n, _nearest(blocks, n, core)), min_cluster_size)
    labels = rows.sparkSession.sparkContext.broadcast(found)

    def named(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for r in f.itertuples():
                yield pd.DataFrame({"path": r.paths, "label": labels.value[r.lo : r.lo + len(r.paths)]})

    return blocks.select("lo", "paths").mapInPandas(named, "path string, label int")


def member_listing(labelled: DataFrame) -> DataFrame:
    """(label, path, place): each cluster's paths numbered in order from 0, a row each, so that no cluster is gathered."""
    return running(labelled.select("label", "path"), ["label"], ["path"], "place")
