"""Exact top-k by inner product over norm-bucketed vectors.

Vectors are grouped by length into chunks. A query carries a lower bound of its k-th score; against a chunk the bound
becomes a local cosine threshold. Where that is high, the query's largest coordinate limits which vectors can reach it
(coordinate pruning); else only vectors long enough remain (length pruning). What is left is verified by exact products.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from shutterlake.llm.common import forget, read, stored

#: Rows of the bounded set of long vectors that gives each query its first lower bound.
SEED_ROWS = 2048
#: Queries in one block; bytes of a chunk's vectors at 16 bits a component, and the least and most of them.
BLOCK_QUERIES, CHUNK_BYTES, CHUNK_ROWS = 1024, 4 << 20, (256, 1 << 16)
#: Levels of what queries ask of a vector's length, by quantiles; a block is of one level.
LEVELS = 64
#: Meetings of a chunk with a group of blocks, for each task that can run at a time.
MEETINGS = 4
#: Local cosine thresholds from here on use a coordinate, below it the length.
COORDINATE_FROM = 0.5

_VECTOR = "vec_id long, dim int, norm double, v binary"


def _narrow(x: np.ndarray) -> np.ndarray:
    """The same integers in the smallest type of 16 to 64 bits."""
    low, high = int(x.min(initial=0)), int(x.max(initial=0))
    return x.astype(next(t for t in ("<i2", "<i4", "<i8") if np.iinfo(t).min <= low and high <= np.iinfo(t).max))


def _quantised(scale: float):
    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, rows = [], []
            for vec_id, x in zip(batch.column("vec_id").to_pylist(), batch.column("embedding"), strict=True):
                if vec_id is None or not x.is_valid or x.values.null_count:
                    continue
                x = np.asarray(x.values, dtype=np.float64)
                if np.isfinite(x).all():
                    x = np.floor(x * scale)
                    if (np.abs(x) >= 2.0**63).any():
                        raise ValueError(f"a component of vector {vec_id} is beyond 64 bits")
                    ids.append(vec_id)
                    rows.append(x.astype(np.int64))
            norms = [float(np.sqrt((r.astype(np.float64) ** 2).sum())) for r in rows]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(map(len, rows), pa.int32()), pa.array(norms, pa.float64()), pa.array([_narrow(r).tobytes() for r in rows], pa.binary())], names=["vec_id", "dim", "norm", "v"])

    return vectors


def _matrix(blob, dim: int, rows: int) -> np.ndarray:
    """Vectors of one type, which shows in their size, one after another."""
    return np.frombuffer(blob, f"<i{len(blob) // (rows * dim)}").reshape(rows, dim) if rows and dim else np.zeros((rows, dim), np.int16)


def _stacked(blobs: list[bytes], dim: int) -> np.ndarray:
    """Vectors of any types as one matrix of the widest."""
    if len({len(b) for b in blobs}) == 1:
        return _matrix(b"".join(blobs), dim, len(blobs))
    return np.stack([_matrix(b, dim, 1)[0].astype(np.int64) for b in blobs])


def _float(x: np.ndarray) -> np.ndarray:
    """As float64 where that holds every component exactly."""
    y = x.astype(np.float64)
    return y if not y.size or np.abs(y).max() < 2.0**53 else x


def _products(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Exact integer products: in float64 where every sum stays below 2**53, else in Python's integers."""
    if not q.size or not v.size:
        return np.zeros((len(q), len(v)), np.int64)
    a, b = q.astype(np.float64, copy=False), v.astype(np.float64, copy=False)
    if float(np.abs(a).max()) * float(np.abs(b).max()) * q.shape[1] < 2.0**53:
        return a @ b.T
    return (q.astype(np.int64).astype(object) @ v.astype(np.int64).T.astype(object)).astype(np.int64)


_PACKED = "{0} int, {1} int, dim int, ids binary, norms binary, vs binary"


def _pack(rows: DataFrame, keys: tuple[str, str], bounds: bool = False) -> DataFrame:
    """One row per group: its vectors, longest first, as binaries (groups are bounded by how they were dealt)."""

    def pack(table: pa.Table) -> pa.Table:
        norms, ids, dim = table.column("norm").to_numpy(), table.column("vec_id").to_numpy(), table.column("dim")[0].as_py()
        blobs = [x.as_buffer().to_pybytes() for x in table.column("v")]
        order = np.array(sorted(range(len(ids)), key=lambda k: (-norms[k], ids[k], blobs[k])))
        v = _narrow(_stacked([blobs[k] for k in order], dim))
        values = [ids[order].astype("<i8"), norms[order].astype("<f8"), v, *([table.column("bound").to_numpy()[order].astype("<f8")] if bounds else [])]
        least = [pa.array([float(table.column("need").to_numpy().min())])] if bounds else []
        return pa.table([*(table.column(c).slice(0, 1) for c in (*keys, "dim")), *(pa.array([x.tobytes()], pa.binary()) for x in values), *least], names=[*keys, "dim", *names])

    names = ["ids", "norms", "vs", *(["bound", "need"] if bounds else [])]
    told = ["bound", "need"] if bounds else []
    return rows.select(*keys, "dim", "vec_id", "norm", "v", *told).groupBy(*keys, "dim").applyInArrow(pack, _PACKED.format(*keys) + (", bound binary, need double" if bounds else ""))


def _seeded(seed: dict, k: int):
    """Adds to each query the k-th best score within the seed (minus infinity if it has fewer), and the least length that this asks of a vector."""

    def bounds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in (whole.slice(at, BLOCK_QUERIES) for at in range(0, len(whole), BLOCK_QUERIES)):
                ids, dims, norms = (batch.column(c).to_numpy() for c in ("vec_id", "dim", "norm"))
                blobs, bound = [x.as_buffer().to_pybytes() for x in batch.column("v")], np.full(len(batch), -np.inf)
                for dim in set(dims.tolist()) & set(seed):
                    (seed_ids, v), mine = seed[dim], np.flatnonzero(dims == dim)
                    s = _products(_stacked([blobs[i] for i in mine], dim), v).astype(np.float64)
                    s[ids[mine, None] == seed_ids[None, :]] = -np.inf
                    if s.shape[1] >= k:
                        bound[mine] = np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k]
                need = np.where((bound > 0) & (norms > 0), bound / np.maximum(norms, 1e-300), 0.0)
                yield batch.append_column("bound", pa.array(bound)).append_column("need", pa.array(need))

    return bounds


def _dealt(rows: DataFrame, by: str, most: int, size) -> tuple[DataFrame, Column, dict]:
    """rows with their level of `by`, one of `most` at most; the number of shares that each level and dimension is cut
    into, as a column and as {(level, dim): shares}, for size(dim) rows a share."""
    cuts = sorted(set(rows.approxQuantile(by, [i / most for i in range(1, most)], 0.005))) if most > 1 else []
    levelled = rows.withColumn("level", sum((F.when(F.col(by) > c, 1).otherwise(0) for c in cuts), F.lit(0)))
    counts = levelled.groupBy("level", "dim").agg(F.count(F.lit(1)).alias("n")).collect()  # a row per level and dimension
    shares = {(r.level, r.dim): -(-r.n // size(r.dim)) for r in counts}
    return levelled, _told(shares), shares


def _told(values: dict) -> Column:
    """The value of a row's level and dimension."""
    if not values:
        return F.lit(1)
    return F.element_at(F.create_map(*[x for (a, d), n in values.items() for x in (F.struct(F.lit(a).alias("level"), F.lit(d).alias("dim")), F.lit(n))]), F.struct("level", "dim"))


_HIT = "query_id long, vec_id long, score long"


def _probe(k: int):
    """Rows sorted by chunk, each chunk before its query blocks: the chunk stays while they pass one by one."""

    def hits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = held = unit = None
        for batch in batches:
            for i in range(len(batch)):
                row = {n: batch.column(n)[i] for n in batch.schema.names}
                here = tuple(row[n].as_py() for n in ("bucket", "chunk", "dim", "part"))
                ids, norms = (np.frombuffer(row[n].as_buffer(), t) for n, t in (("ids", "<i8"), ("norms", "<f8")))
                v = _matrix(row["vs"].as_buffer(), here[2], len(ids))
                if row["block"].as_py() < 0:
                    v = _float(v)
                    key, held, unit = here, (v, norms, ids), cache(lambda v=v, norms=norms: v / np.maximum(norms, 1e-300)[:, None])
                    continue
                if key != here:
                    raise ValueError("a query block came without its chunk")
                found = _search(v, norms, np.frombuffer(row["bound"].as_buffer(), "<f8"), ids, *held, k, unit)
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in found], names=["query_id", "vec_id", "score"])

    return hits


def _search(q, q_norm, bound, q_ids, v, v_norm, ids, k, unit=None):
    """The k best of one chunk for each query that they can matter to; v is ordered by falling norm, unit() of length 1."""
    unit = unit or cache(lambda: v / np.maximum(v_norm, 1e-300)[:, None])
    longest = v_norm[0] if len(v_norm) else 0.0
    reach = q_norm * longest
    with np.errstate(divide="ignore", invalid="ignore"):
        local = np.where(reach > 0, bound / reach, np.where(bound > 0, np.inf, -np.inf))
        shortest = np.where((bound > 0) & (q_norm > 0), bound / q_norm, 0.0)
    live = np.flatnonzero(local <= 1 + 1e-9)
    keep = np.searchsorted(-v_norm, -(shortest * (1 - 1e-9)), side="right")  # length pruning: a prefix
    whole, picked = [], []
    for i in live:
        if local[i] >= COORDINATE_FROM and q_norm[i] > 0:
            f = int(np.abs(q[i].astype(np.float64)).argmax())
            c, t = q[i, f] / q_norm[i], min(1.0, float(local[i]))
            spread = np.sqrt(max(0.0, (1 - c * c) * (1 - t * t))) + 1e-9
            low, high = -1.0 if -c > t else c * t - spread, 1.0 if c > t else c * t + spread
            x = unit()[: keep[i], f]
            rows = np.flatnonzero((x >= low) & (x <= high))
            if len(rows) * 4 < len(v):
                picked.append((i, rows))
                continue
        whole.append(i)
    out = [], [], []

    def best(i: int, rows: np.ndarray, scores: np.ndarray) -> None:
        ok = (ids[rows] != q_ids[i]) & (scores >= bound[i])
        rows, scores = rows[ok], scores[ok]
        if len(rows) > 4 * k:
            cut = np.partition(scores, len(scores) - k)[len(scores) - k]
            rows, scores = rows[scores >= cut], scores[scores >= cut]
        order = np.lexsort((ids[rows], -scores))[:k]
        out[0].extend([q_ids[i]] * len(order))
        out[1].extend(ids[rows[order]])
        out[2].extend(scores[order].astype(np.int64))

    for i, rows in picked:
        best(i, rows, _products(q[i : i + 1], v[rows])[0])
    for at in range(0, len(whole), 128):
        part = whole[at : at + 128]
        most = int(keep[part].max())
        for i, s in zip(part, _products(q[part], v[:most]), strict=True):
            best(i, np.arange(most), s)
    return out


def exact_topk(vectors: DataFrame, is_query: F.Column, k: int = 5, scale: float = 256.0, seed_rows: int = SEED_ROWS) -> DataFrame:
    """For each query row of vectors(vec_id, embedding) the k other rows of greatest integer product, exact.

    Components become floor(scale * x). Rows whose vec_id or vector is null, or whose vector holds a null or
    non-finite component, take no part; vectors of another dimension than the query's don't match it. Ties go to the
    smaller vec_id. A row that repeats another's vec_id is a candidate of its own, but a query's own vec_id never is;
    repeated query rows count once, by their first vector in byte order. A component or score beyond 64 bits raises.
    Fewer candidates than k give fewer rows. An empty table gives none. Extra columns are ignored. Returns query_id, rank, vec_id, score.
    """
    spark = vectors.sparkSession
    rows = stored(vectors.select("vec_id", "embedding").mapInArrow(_quantised(scale), _VECTOR), "vectors")
    n, width = rows.agg(F.count(F.lit(1)), F.sum(2 * F.col("dim") + 16)).first()
    seed: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    long_rows = rows.orderBy(F.desc("norm"), "vec_id", "v").limit(seed_rows).collect()  # bounded by seed_rows
    for dim in {r.dim for r in long_rows}:
        own = [r for r in long_rows if r.dim == dim]
        seed[dim] = np.array([r.vec_id for r in own]), _stacked([bytes(r.v) for r in own], dim)
    asked = rows.where(is_query).groupBy("vec_id").agg(F.min(F.struct("v", "dim", "norm")).alias("s")).select("vec_id", "s.dim", "s.norm", "s.v")
    asked = bounded = stored(asked.mapInArrow(_seeded(seed, k), _VECTOR + ", bound double, need double"), "bounds")
    m, asked_width = asked.agg(F.count(F.lit(1)), F.sum(2 * F.col("dim") + 24)).first()
    # Chunks and groups of query blocks are a grid of meetings, a few for each task that can run at a time. It is cut so
    # that as little as possible is copied: rows go to the groups, queries to the chunks.
    wanted = MEETINGS * spark.sparkContext.defaultParallelism
    even = -(-n // min(wanted, max(1, math.ceil(math.sqrt(wanted * (width or 1) / (asked_width or 1))))))
    rows_of = lambda dim: min(max(CHUNK_ROWS[0], min(CHUNK_BYTES // (2 * max(1, dim)), even)), CHUNK_ROWS[1])
    # Buckets of like length: 64 at most, by quantiles; chunks within a bucket deal a crowded length out evenly.
    sized, shares, chunks = _dealt(rows, "norm", 64 if n > CHUNK_ROWS[0] else 1, rows_of)
    dealt = sized.withColumn("chunk", F.pmod(F.xxhash64("vec_id", "v"), shares).cast("int")).withColumnRenamed("level", "bucket")
    packed = stored(_with_reach(_pack(dealt, ("bucket", "chunk"))), "chunks")
    # Queries that ask for like lengths are in one block, and like blocks in one group.
    groups = max(1, -(-wanted // max(1, sum(chunks.values()))))
    levelled, shares, blocks = _dealt(asked, "need", min(LEVELS, max(1, -(-m // BLOCK_QUERIES))), lambda dim: BLOCK_QUERIES)
    before, of_dim = {}, {}
    for level, dim in sorted(blocks):
        before[level, dim] = of_dim.get(dim, 0)
        of_dim[dim] = before[level, dim] + blocks[level, dim]
    part = F.floor(F.col("block") * groups / _told({key: of_dim[key[1]] for key in blocks})).cast("int")
    numbered = levelled.withColumn("block", (_told(before) + F.pmod(F.xxhash64("vec_id"), shares)).cast("int")).withColumn("part", part)
    asked = stored(_pack(numbered, ("part", "block"), bounds=True), "queries")
    # Which block meets which chunk is decided on lengths and bounds alone; of a block these are a few bytes for
    # BLOCK_QUERIES queries, which are sent to the tasks, and of the groups fewer. Then a chunk travels once for each
    # group that has a block for it, and blocks to the chunks they meet.
    reached = lambda c: F.col("reach") >= F.col(c) * (1 - 1e-9)
    meets = packed.select("bucket", "chunk", "dim", "reach").join(F.broadcast(asked.select("block", "dim", "need")), "dim").where(reached("need"))
    sent = meets.select("bucket", "chunk", "dim", "block").join(asked.drop("need"), ["block", "dim"])
    least = asked.groupBy("dim", "part").agg(F.min("need").alias("least"))
    stay = packed.join(F.broadcast(least), "dim").where(reached("least")).withColumn("block", F.lit(-1)).withColumn("bound", F.lit(None).cast("binary")).drop("reach", "least")
    order = ["bucket", "chunk", "dim", "part", "block"]
    met = stay.unionByName(sent.select(*stay.columns)).repartition("bucket", "chunk", "dim", "part").sortWithinPartitions(*order)
    hits = met.mapInArrow(_probe(k), _HIT)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    out = stored(hits.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score"), "topk")
    for table in (rows, bounded, packed, asked):
        forget(table)
    return out


def _with_reach(packed: DataFrame) -> DataFrame:
    """With the length of each chunk's longest vector."""

    def reach(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            longest = [float(np.frombuffer(x.as_buffer(), "<f8", 1)[0]) for x in batch.column("norms")]
            yield batch.append_column("reach", pa.array(longest, pa.float64()))

    return packed.mapInArrow(reach, _PACKED.format("bucket", "chunk") + ", reach double")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op4: the 5 best of every row for each row whose vec_id is divisible by 50."""
    return exact_topk(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS e FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id,
             list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2]))::BIGINT AS score
      FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
