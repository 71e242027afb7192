"""Nearest place to each point.

Up to BROADCAST_PLACES places go to every task, which compares its points with them as matrices: nothing is shuffled.
More are put in blocks of neighbours. A point meets the blocks whose box can hold a place as near as the farthest that
its nearest place can be, so that where points or places are dense, boxes are small and points meet few of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shutterlake.functions.geo import place
from shutterlake.session import ship_package
from shutterlake.sources.kept import kept

#: Up to so many places (about a megabyte) are sent to every task.
BROADCAST_PLACES = 10_000
#: Places of a block at least, blocks at most (more places make larger blocks), and places whose order divides the sphere.
BLOCK_PLACES, BLOCKS, SAMPLE = 8192, 4096, 1 << 16
#: Points that are compared at once, and messages of points to a block that one task takes.
POINTS, MESSAGES = 1024, 16
_NEAR = 1e-9
_NAMES = ("name", "admin1", "cc")
_FOUND = "d double, place_id long, name string, admin1 string, cc string"


def _axes(lat: np.ndarray, lon: np.ndarray) -> np.ndarray:
    """Places on the unit sphere."""
    lat, lon = np.radians(lat), np.radians(lon)
    return np.stack([np.cos(lat) * np.cos(lon), np.cos(lat) * np.sin(lon), np.sin(lat)], axis=1)


def _coordinates(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Rows with both coordinates, and those on the unit sphere."""
    lat, lon = (batch.column(c).cast(pa.float64()).to_numpy(zero_copy_only=False) for c in ("lat", "lon"))
    rows = np.flatnonzero(~(np.isnan(lat) | np.isnan(lon)))
    return rows, _axes(lat[rows], lon[rows])


def _closest(points: np.ndarray, places: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each point the number of its nearest place, of equally near ones that with the smaller id, and the distance squared."""
    best, distance = np.empty(len(points), np.int64), np.empty(len(points))
    for a in range(0, len(points), POINTS):
        part = points[a : a + POINTS]
        dots = part @ places.T
        # What may be nearest but for rounding is told apart by its exact difference.
        row, at = np.nonzero(dots >= dots.max(axis=1, keepdims=True) - _NEAR)
        d = ((part[row] - places[at]) ** 2).sum(axis=1)
        order = np.lexsort((ids[at], d, row))
        first = order[np.flatnonzero(np.diff(row[order], prepend=-1))]
        best[a : a + POINTS], distance[a : a + POINTS] = at[first], d[first]
    return best, distance


class _Table:
    """Places in memory."""

    def __init__(self, rows: list) -> None:
        self.ids = np.array([r[0] for r in rows], np.int64)
        self.xyz = _axes(np.array([r[1] for r in rows], float), np.array([r[2] for r in rows], float))
        self.names = [[r[3 + i] for r in rows] for i in range(len(_NAMES))]

    def arrays(self, best: np.ndarray, distance: np.ndarray) -> list[pa.Array]:
        return [pa.array(distance), pa.array(self.ids[best]), *(pa.array([n[i] for i in best], pa.string()) for n in self.names)]


def _by_all(table: _Table):
    """Adds the nearest place of a small table to rows of points; null without coordinates."""

    def stage(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, xyz = _coordinates(batch)
            place_of = np.full(len(batch), -1, np.int64)
            best, distance = _closest(xyz, table.xyz, table.ids) if len(rows) else (np.empty(0, np.int64), np.empty(0))
            place_of[rows] = np.arange(len(rows))
            index = pa.array(place_of, mask=place_of < 0)
            yield pa.RecordBatch.from_arrays([*batch.columns, *(c.take(index) for c in table.arrays(best, distance))], names=[*batch.schema.names, *(c.split()[0] for c in _FOUND.split(", "))])

    return stage


class Splits:
    """A tree that halves a sample of places along its widest axis, until it has as many leaves as are wanted."""

    def __init__(self, sample: np.ndarray, leaves: int) -> None:
        self.root = self._split(sample, leaves) if len(sample) else 0
        self.made = 0
        self.root = self._numbered(self.root)

    def _split(self, x: np.ndarray, leaves: int):
        width = np.ptp(x, axis=0)
        axis = int(width.argmax())
        if leaves < 2 or not width[axis]:
            return None
        cut = float(np.median(x[:, axis]))
        low = x[:, axis] < cut
        if not low.any():
            low = x[:, axis] <= cut
            cut = float(np.nextafter(cut, np.inf))
        return axis, cut, self._split(x[low], leaves // 2), self._split(x[~low], leaves - leaves // 2)

    def _numbered(self, node):
        if not isinstance(node, tuple):
            self.made += 1
            return self.made - 1
        return node[0], node[1], self._numbered(node[2]), self._numbered(node[3])

    def leaf(self, x: np.ndarray) -> np.ndarray:
        out = np.empty(len(x), np.int32)
        stack = [(self.root, np.arange(len(x)))]
        while stack:
            node, rows = stack.pop()
            if isinstance(node, tuple):
                low = x[rows, node[0]] < node[1]
                stack += [(node[2], rows[low]), (node[3], rows[~low])]
            else:
                out[rows] = node
        return out


def _leaves(splits: Splits):
    def stage(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, xyz = _coordinates(batch)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(splits.leaf(xyz))], names=[*batch.schema.names, "leaf"])

    return stage


_ROW = pa.struct([("place_id", pa.int64()), ("lat", pa.float64()), ("lon", pa.float64()), *((n, pa.string()) for n in _NAMES)])
_PLACE = "place_id long, lat double, lon double, name string, admin1 string, cc string"
_BLOCK = f"block long, box array<double>, places array<struct<{', '.join(c.replace(' ', ':', 1) for c in _PLACE.split(', '))}>>"


def _blocks(most: int):
    """Blocks of places of one leaf, with their boxes, from rows that are sorted by leaf."""

    def stage(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        held: list[dict] = []
        leaf = None

        def flush() -> pa.RecordBatch:
            nonlocal number
            xyz = _axes(np.array([r["lat"] for r in held]), np.array([r["lon"] for r in held]))
            number += 1
            out = [pa.array([number - 1], pa.int64()), pa.array([[*xyz.min(axis=0), *xyz.max(axis=0)]], pa.list_(pa.float64())), pa.array([list(held)], pa.list_(_ROW))]
            held.clear()
            return pa.RecordBatch.from_arrays(out, names=["block", "box", "places"])

        for batch in batches:
            for row in batch.to_pylist():
                if held and (row["leaf"] != leaf or len(held) >= most):
                    yield flush()
                leaf = row.pop("leaf")
                held.append(row)
        if held:
            yield flush()

    return stage


def _sent(numbers: np.ndarray, boxes: np.ndarray, key: str):
    """The points of a batch that a block can have the nearest place of, for each such block."""
    low, high = boxes[:, :3], boxes[:, 3:]

    def stage(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            rows, xyz = _coordinates(whole)
            keys = whole.column(key).take(pa.array(rows))
            for a in range(0, len(rows), POINTS):
                p = xyz[a : a + POINTS, None, :]
                outside = np.maximum(0, np.maximum(low - p, p - high))
                across = np.maximum(np.abs(p - low), np.abs(p - high))
                near = (outside**2).sum(axis=2)
                # Some place of a block is at most its box's far corner away.
                need = near <= (across**2).sum(axis=2).min(axis=1)[:, None] + _NEAR
                hit = np.flatnonzero(need.any(axis=0))
                members = [a + np.flatnonzero(need[:, b]) for b in hit]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(numbers[hit], pa.int64()), pa.array([keys.take(pa.array(m)).to_pylist() for m in members], pa.list_(keys.type)), pa.array([xyz[m].tobytes() for m in members], pa.binary())],
                    names=["block", "keys", "xyz"],
                )

    return stage


def _met(key: str):
    def stage(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kind = batch.column("keys").type.value_type
            for keys, xyz, places in zip(*(batch.column(c).to_pylist() for c in ("keys", "xyz", "places")), strict=True):
                table = _Table([tuple(p.values()) for p in places])
                best, distance = _closest(np.frombuffer(xyz).reshape(-1, 3), table.xyz, table.ids)
                yield pa.RecordBatch.from_arrays([pa.array(keys, kind), *table.arrays(best, distance)], names=[key, *(c.split()[0] for c in _FOUND.split(", "))])

    return stage


def nearest(points: DataFrame, places: DataFrame, key: str = "key", broadcast_places: int = BROADCAST_PLACES) -> DataFrame:
    """points(key, lat, lon) with location, of places(place_id, lat, lon, name, admin1, cc); ties go to the smaller place_id.

    Points and places without coordinates meet nothing. Each point has a key of its own. Beyond broadcast_places places,
    what a block has to compare is counted first, and a block that very many points ask for goes to several tasks.
    """
    spark = points.sparkSession
    ship_package(spark)
    known = places.where(F.col("lat").isNotNull() & F.col("lon").isNotNull()).select(*(F.col(c.split()[0]).cast(c.split()[1]).alias(c.split()[0]) for c in _PLACE.split(", ")))
    n = known.count()
    location = place(F.col("name"), F.col("admin1"), F.col("cc"))
    told = F.when(F.col("place_id").isNotNull(), location).alias("location")
    if not n:
        return points.withColumn("location", F.lit(None).cast("struct<city:string,region:string,country:string>")).withColumn("place_id", F.lit(None).cast("long"))
    if n <= broadcast_places:
        table = _Table([tuple(r) for r in known.collect()])
        own = [F.col(c).alias(f"__{c}") if c not in ("lat", "lon") else F.col(c) for c in points.columns]
        rows = points.select(*own)
        ddl = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields), _FOUND])
        back = [F.col(c if c in ("lat", "lon") else f"__{c}").alias(c) for c in points.columns]
        return rows.mapInArrow(_by_all(table), ddl).select(*back, told, "place_id")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sample = known.orderBy(F.xxhash64("place_id", "lat", "lon")).limit(SAMPLE).select("lat", "lon").collect()
    most = max(BLOCK_PLACES, n // BLOCKS) if broadcast_places >= BLOCK_PLACES else max(1, broadcast_places)
    splits = Splits(_axes(np.array([r.lat for r in sample]), np.array([r.lon for r in sample])), min(BLOCKS, -(-n // most)))
    leaves = known.mapInArrow(_leaves(splits), _PLACE + ", leaf int").repartition(parts, "leaf").sortWithinPartitions("leaf")
    blocks = kept(leaves.mapInArrow(_blocks(most), _BLOCK), "places")
    boxes = blocks.select("block", "box").orderBy("block").collect()  # at most about 2 * BLOCKS small rows
    kind = points.schema[key].dataType.simpleString()
    asked = points.select(key, "lat", "lon").mapInArrow(_sent(np.array([b.block for b in boxes]), np.array([b.box for b in boxes]), key), f"block long, keys array<{kind}>, xyz binary")
    asked = kept(asked, "points")
    shares = asked.groupBy("block").agg(F.ceil(F.count(F.lit(1)) / MESSAGES).cast("int").alias("shares"))
    sent = asked.join(shares, "block").withColumn("share", F.pmod(F.xxhash64("xyz"), F.col("shares")).cast("int")).drop("shares")
    copies = blocks.drop("box").join(shares, "block").select("block", "places", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("share"))
    met = sent.join(copies, ["block", "share"]).select("keys", "xyz", "places").mapInArrow(_met(key), f"`{key}` {kind}, {_FOUND}")
    best = met.groupBy(key).agg(F.min(F.struct("d", "place_id", *_NAMES)).alias("c")).select(key, "c.place_id", *(f"c.{c}" for c in _NAMES))
    return points.join(best.select(key, told, "place_id"), key, "left")
