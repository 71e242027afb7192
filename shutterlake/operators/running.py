"""Running sums and ranks in two levels, so that neither a hot key nor the whole table is one task's.

Rows are dealt by ranges of key and order, and each task counts on its own. Only a task's first key can have begun in an
earlier one; what it had there follows from one small row per task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, IntegerType, LongType, StructField, StructType
from pyspark.sql.window import Window

from shutterlake.session import ship_package
from shutterlake.sources.kept import kept

_TASK, _AT, _FIRST, _BEFORE, _VALUE = "__task", "__at", "__first", "__before", "__value"


def _changes(batch: pa.RecordBatch, by: list[str], last: pa.RecordBatch | None) -> np.ndarray:
    """For each row whether its key differs from that of the row before it, null equal to null."""
    out = np.zeros(len(batch), bool)
    out[0] = last is None
    for name in by:
        column = batch.column(name)
        if last is not None:
            column = pa.concat_arrays([last.column(name), column])
        if len(column) > 1:
            a, b = column.slice(0, len(column) - 1), column.slice(1)
            same = pc.if_else(pc.or_(a.is_null(), b.is_null()), pc.and_(a.is_null(), b.is_null()), pc.equal(a, b))
            out[len(out) - len(same) :] |= ~same.to_numpy(zero_copy_only=False)
    return out


def _count(by: list[str]):
    def stage(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, at, total, first, last = TaskContext.get().partitionId(), 0, 0, True, None
        for batch in batches:
            if not len(batch):
                continue
            value = batch.column(_VALUE).to_numpy(zero_copy_only=False)
            fresh = _changes(batch, by, last)
            sums = np.cumsum(value) - value
            begins = np.flatnonzero(fresh)
            run = np.searchsorted(begins, np.arange(len(batch)), side="right")
            before = np.where(run > 0, sums - sums[begins[np.maximum(run, 1) - 1]] if len(begins) else 0, sums + total)
            is_first = first & (run <= (1 if last is None else 0))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(np.full(len(batch), task, np.int32)), pa.array(np.arange(at, at + len(batch))), pa.array(before.astype(np.int64)), pa.array(is_first)],
                names=[*batch.schema.names, _TASK, _AT, _BEFORE, _FIRST],
            )
            total, first, at, last = int(before[-1] + value[-1]), bool(is_first[-1]), at + len(batch), batch.slice(len(batch) - 1)

    return stage


def running(rows: DataFrame, by: list[str], order: list[str], out: str, value: Column | None = None, parts: int | None = None) -> DataFrame:
    """rows with `out`: the sum of `value` (1 unless given) over the rows of the same key that come before in the order.

    Without keys that is over all rows. Rows that tie in the order count one after another, in any order. The rows are
    computed once and kept, as their sums are read back task by task.
    """
    spark = rows.sparkSession
    ship_package(spark)
    n = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    valued = rows.withColumn(_VALUE, (F.lit(1) if value is None else value).cast("long"))
    ranged = valued.repartitionByRange(n, *by, *order).sortWithinPartitions(*by, *order)
    added = [StructField(_TASK, IntegerType()), StructField(_AT, LongType()), StructField(_BEFORE, LongType()), StructField(_FIRST, BooleanType())]
    counted = kept(ranged.mapInArrow(_count(by), StructType([*ranged.schema.fields, *added])), "running", free=True)
    key = F.struct(*by) if by else F.struct(F.lit(0).alias("all"))
    # One row per task: the key that it begins with, and the one that it ends with and how much that has in it.
    edges = counted.groupBy(_TASK).agg(F.min_by(key, _AT).alias("begins"), F.max_by(key, _AT).alias("ends"), F.max_by(F.col(_BEFORE) + F.col(_VALUE), _AT).alias("held"))
    asked = edges.select(F.col("begins").alias("key"), _TASK, F.lit(False).alias("tells"), F.lit(0).cast("long").alias("held"))
    told = edges.select(F.col("ends").alias("key"), _TASK, F.lit(True).alias("tells"), "held")
    earlier = F.sum("held").over(Window.partitionBy("key").orderBy(_TASK, "tells").rowsBetween(Window.unboundedPreceding, -1))
    base = asked.unionByName(told).withColumn("base", F.coalesce(earlier, F.lit(0))).where("NOT tells").select(F.col(_TASK).alias("__of"), "base")
    # As many rows as tasks.
    joined = counted.join(F.broadcast(base), F.col(_TASK) == F.col("__of"), "left")
    total = F.col(_BEFORE) + F.when(F.col(_FIRST), F.col("base")).otherwise(0)
    result = joined.select(*rows.columns, total.alias(out))
    result._kept_path = counted._kept_path
    return result


def dealt_by_size(rows: DataFrame, size: str, order: list[str], parts: int) -> DataFrame:
    """rows in `parts` partitions of about equal sums of `size`: none has more than the mean and one row's size beyond it."""
    total = rows.agg(F.sum(size)).first()[0] or 0
    placed = running(rows, [], order, "__place", F.coalesce(F.col(size), F.lit(0)), parts)
    share = max(1, -(-total // parts))
    dealt = placed.repartitionById(parts, F.least(F.lit(parts - 1), F.floor(F.col("__place") / share)).cast("int"))
    out = dealt.drop("__place")
    out._kept_path = placed._kept_path
    return out
