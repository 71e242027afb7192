"""Exact nearest vectors by a metric index: pivots, zones of angle around them, and the triangle inequality.

Every row belongs to the pivot that it has the least angle to, and there to a ring of angles: a zone. From a query's
angles to the pivots follows how large a score a zone can hold. A query first meets the zones that promise most, which
gives a score that its k-th best row has at least, and then only those zones that can still beat it. Parts of the rows
meet groups of the queries, each pair in a task.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from shutterlake.progress import NO_COUNT, Counter
from shutterlake.session import ship_package

#: At most so many pivots, and rings of angle around each: the table of zones has at most their product in rows.
PIVOTS, RINGS = 256, 64
#: Vectors of a block of rows and of a block of queries, whose products are held at once.
ROW_BLOCK, QUERY_BLOCK = 1024, 1024
#: At most so many rows and queries meet in one task; fewer rows than LEAST_ROWS aren't worth a part of their own.
PART_ROWS, GROUP_QUERIES, LEAST_ROWS = 1 << 16, 1 << 16, 1 << 12
#: What rounding may do to an angle or, as a share, to a bound.
_SLACK = 1e-6


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _angles(x: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Length of each vector and its angles to the pivots; a zero vector is at right angles to all."""
    size = np.sqrt((x * x).sum(axis=1))
    unit = x / np.where(size > 0, size, 1)[:, None]
    return size, np.arccos(np.clip(unit @ pivots.T, -1, 1))


def _in_zones(x: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each vector's zone and its angle to the zone's pivot."""
    angle = _angles(x, pivots)[1]
    cell = angle.argmin(axis=1)
    own = angle[np.arange(len(cell)), cell]
    return cell * RINGS + np.minimum((own / math.pi * RINGS).astype(np.int64), RINGS - 1), own


def _counted(pivots: np.ndarray):
    """(zone, n) of a task's rows."""

    def stage(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(pivots) * RINGS, np.int64)
        for batch in batches:
            if len(batch):
                total += np.bincount(_in_zones(_matrix(batch.column("embedding")), pivots)[0], minlength=len(total))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["zone", "n"])

    return stage


def _dealt(pivots: np.ndarray, before: np.ndarray, n: np.ndarray, share: int):
    """Rows with their zone, angle and part: zones lie one after another, and each `share` rows of them are a part."""

    def stage(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            zone, own = _in_zones(_matrix(batch.column("embedding")), pivots)
            # The place within the zone is drawn from the path, so that a large zone is spread over its parts.
            place = batch.column("draw").to_numpy() % np.maximum(n[zone], 1)
            part = (before[zone] + place) // share
            yield pa.RecordBatch.from_arrays([batch.column("path"), batch.column("embedding"), pa.array(zone.astype(np.int32)), pa.array(own), pa.array(part)], names=["path", "embedding", "zone", "angle", "part"])

    return stage


@dataclass
class Zones:
    """What is known of each zone: its pivot, the range of its rows' angles and lengths, and how many they are."""

    pivots: np.ndarray
    zone: np.ndarray
    lo: np.ndarray
    hi: np.ndarray
    shortest: np.ndarray
    longest: np.ndarray
    n: np.ndarray

    def bounds(self, x: np.ndarray) -> np.ndarray:
        """The largest score that each query can have in each zone, at least."""
        size, angle = _angles(x, self.pivots)
        to = angle[:, self.zone // RINGS]
        gap = np.maximum(0, np.maximum(to - self.hi, self.lo - to) - _SLACK)
        cos = np.cos(np.minimum(gap, math.pi))
        out = size[:, None] * cos * np.where(cos >= 0, self.longest, self.shortest)
        return out + _SLACK * size[:, None] * self.longest


class _Best:
    """The k best rows of each query among those offered; rows are told by their rank by path."""

    def __init__(self, least: np.ndarray, k: int):
        self.k, self.least, self.last = k, least, np.full(len(least), np.iinfo(np.int64).max)
        self.q, self.score, self.rank = np.empty(0, np.int64), np.empty(0), np.empty(0, np.int64)
        self.waiting: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.n = 0

    def offer(self, q: np.ndarray, score: np.ndarray, rank: np.ndarray, own: np.ndarray) -> None:
        """A block of scores of queries q with rows; own: the rank that is the query's own row."""
        least = self.least[q][:, None]
        row, at = np.nonzero(score >= least)
        s, r = score[row, at], rank[at]
        use = ((s > least[row, 0]) | (r < self.last[q][row])) & (r != own[q][row])
        self.waiting.append((q[row[use]], s[use], r[use]))
        self.n += int(use.sum())
        if self.n > 4 * self.k * len(self.least):
            self.settle()

    def settle(self) -> None:
        q, s, r = (np.concatenate(c) for c in zip((self.q, self.score, self.rank), *self.waiting))
        order = np.lexsort((r, -s, q))
        q, s, r = q[order], s[order], r[order]
        place = np.arange(len(q)) - np.searchsorted(q, q)
        kth = place == self.k - 1
        self.least[q[kth]], self.last[q[kth]] = s[kth], r[kth]
        top = place < self.k
        self.q, self.score, self.rank = q[top], s[top], r[top]
        self.waiting, self.n = [], 0


def _searched(pivots: np.ndarray, sample: np.ndarray, sample_paths: list, k: int, count: Counter):
    """The k best rows of one part for each of a group of queries: first zones that promise most, then what can still matter."""

    def search(rows: pa.Table, asked: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if len(rows) and len(asked):
            rows, asked = rows.combine_chunks(), asked.combine_chunks()
            rows = rows.sort_by([("zone", "ascending"), ("path", "ascending")])
            zone, angle = rows.column("zone").to_numpy(), rows.column("angle").to_numpy()
            x, names = _matrix(rows.column("embedding").combine_chunks()), np.asarray(rows.column("path").to_pylist(), object)
            by_path, rank = np.unique(names, return_inverse=True)
            begins = np.flatnonzero(np.diff(zone, prepend=-1))
            ends = np.append(begins[1:], len(zone))
            size = np.sqrt((x * x).sum(axis=1))
            zones = Zones(pivots, zone[begins], *(f.reduceat(v, begins) for v in (angle, size) for f in (np.minimum, np.maximum)), ends - begins)
            queries, q_names = _matrix(asked.column("embedding").combine_chunks()), np.asarray(asked.column("path").to_pylist(), object)
            place = {p: i for i, p in enumerate(by_path)}
            own = np.array([place.get(p, -1) for p in q_names])
            in_sample = {p: i for i, p in enumerate(sample_paths)}
            # Queries of one pivot together: they need the same zones.
            near = np.argsort(_angles(queries, pivots)[1].argmin(axis=1), kind="stable")
            for at in range(0, len(near), QUERY_BLOCK):
                who = near[at : at + QUERY_BLOCK]
                found = _block(queries[who], own[who], [in_sample.get(p, -1) for p in q_names[who]], x, rank, begins, ends, zones)
                out.append((q_names[who][found.q], by_path[found.rank], found.score))
        columns = [np.concatenate(c) for c in zip(*out)] if out else [[], [], []]
        return pa.Table.from_arrays([pa.array(columns[0], pa.string()), pa.array(columns[1], pa.string()), pa.array(columns[2], pa.float64())], names=["query", "path", "score"])

    def _block(q: np.ndarray, own: np.ndarray, self_at: list[int], x: np.ndarray, rank: np.ndarray, begins: np.ndarray, ends: np.ndarray, zones: Zones) -> _Best:
        # The k-th best row of the sample is a score that the k-th best of all has at least.
        least = np.full(len(q), -np.inf)
        if len(sample) > k:
            scores = q @ sample.T
            scores[np.arange(len(q)), self_at] = np.where(np.asarray(self_at) >= 0, -np.inf, scores[np.arange(len(q)), self_at])
            kth = np.partition(scores, len(sample) - k, axis=1)[:, len(sample) - k]
            least = kth - _SLACK * np.sqrt((q * q).sum(axis=1)) * np.sqrt((sample * sample).sum(axis=1)).max()
        best = _Best(least, k)
        bound = zones.bounds(q)
        order = np.argsort(-bound, axis=1, kind="stable")
        # The best zones until they hold k rows besides the query itself.
        held = np.cumsum(zones.n[order], axis=1) - zones.n[order]
        first = np.zeros(bound.shape, bool)
        np.put_along_axis(first, order, held < k + 1, axis=1)
        for turn in (first, ~first):
            for z in np.argsort(-bound.max(axis=0), kind="stable"):
                for a in range(begins[z], ends[z], ROW_BLOCK):
                    need = np.flatnonzero(turn[:, z] & (bound[:, z] >= best.least))
                    if not len(need):
                        break
                    b = min(a + ROW_BLOCK, ends[z])
                    count.add(len(need) * int(b - a))
                    best.offer(need, q[need] @ x[a:b].T, rank[a:b], own)
            best.settle()
        return best

    return search


_FOUND = "query string, path string, score double"


def nearest(embeddings: DataFrame, queries: DataFrame, k: int, pivots: int = PIVOTS, count: Counter = NO_COUNT) -> DataFrame:
    """(query, path, score, rank): the k rows of embeddings(path, embedding) with the largest products with each of queries.

    The query's own row is left out, ties go to the smaller path; rows and queries without a vector take no part. `count`
    is told the pairs that were really compared. Pivots are a bounded sample, the index has every row. Zones are dealt to
    parts of equal size, a zone that a third of all rows lie in to several; a vector travels once for each part or group
    that it meets, and a task holds one part of the rows and one group of the queries.
    """
    spark = embeddings.sparkSession
    ship_package(spark)
    rows = embeddings.where(F.col("embedding").isNotNull()).select("path", "embedding")
    asked = queries.where(F.col("embedding").isNotNull()).select("path", "embedding")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    n_rows = rows.count()
    sample = rows.orderBy(F.xxhash64("path"), "path").limit(min(pivots, max(1, math.isqrt(n_rows)))).collect()
    if not sample:
        return spark.createDataFrame([], _FOUND + ", rank int")
    picked = np.array([r.embedding for r in sample], np.float64)
    points = picked / np.maximum(np.sqrt((picked * picked).sum(axis=1)), 1e-300)[:, None]
    per_zone = rows.select("embedding").mapInArrow(_counted(points), "zone int, n long").groupBy("zone").agg(F.sum("n").alias("n")).collect()  # at most PIVOTS * RINGS rows
    held = np.zeros(len(points) * RINGS, np.int64)
    held[[r.zone for r in per_zone]] = [r.n for r in per_zone]
    parts = max(-(-n_rows // PART_ROWS), min(n, -(-n_rows // LEAST_ROWS)))
    groups = max(1, -(-asked.count() // GROUP_QUERIES))
    copies = lambda of, name: F.explode(F.sequence(F.lit(0), F.lit(of - 1))).alias(name)
    schema = f"path string, embedding {rows.schema['embedding'].dataType.simpleString()}, zone int, angle double, part long"
    drawn = rows.withColumn("draw", F.xxhash64("path").bitwiseAND(F.lit((1 << 63) - 1)))
    dealt = drawn.mapInArrow(_dealt(points, np.cumsum(held) - held, held, -(-n_rows // parts)), schema).select("*", copies(groups, "group"))
    sent = asked.select("path", "embedding", F.pmod(F.xxhash64("path"), F.lit(groups)).cast("int").alias("group"), copies(parts, "part")).withColumn("part", F.col("part").cast("long"))
    met = dealt.groupBy("part", "group").cogroup(sent.groupBy("part", "group"))
    found = met.applyInArrow(_searched(points, picked, [r.path for r in sample], k, count), _FOUND)
    by_rank = Window.partitionBy("query").orderBy(F.desc("score"), "path")
    return found.withColumn("rank", F.row_number().over(by_rank)).where(F.col("rank") <= k)
