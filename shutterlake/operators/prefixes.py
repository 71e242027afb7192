"""Names that begin with other names, by one pass over them in order.

In order, all names that begin with a name follow it at once. So the names that are open as prefixes are a stack, and
each name meets those on it. Names travel as they are, once for the order and once for the pass, whatever their length.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from shutterlake.session import ship_package
from shutterlake.sources.kept import kept


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    task = TaskContext.get().partitionId()
    for batch in batches:
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([task] * len(batch), pa.int32())], names=[*batch.schema.names, "__task"])


def _stacked(by: list[str]):
    def stage(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, stack = None, []
        for batch in batches:
            found: list[tuple[int, str, int]] = []
            keys = list(zip(*(batch.column(c).to_pylist() for c in by), strict=True))
            for at, (name, here, carried) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("name", "sides", "carried")), strict=True)):
                if keys[at] != key:
                    key, stack = keys[at], []
                while stack and not name.startswith(stack[-1][0]):
                    stack.pop()
                if not carried:
                    found += [(at, short, sides) for short, sides in stack if sides | here == 3]
                stack.append((name, here))
            rows = pa.array([at for at, _, _ in found], pa.int64())
            columns = [batch.column(c).take(rows) for c in (*by, "name", "sides")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array([s for _, s, _ in found], pa.string()), pa.array([m for _, _, m in found], pa.int32())], names=[*by, "long", "long_sides", "short", "short_sides"])

    return stage


def prefix_pairs(names: DataFrame, by: list[str], parts: int | None = None) -> DataFrame:
    """(by, long, long_sides, short, short_sides): every two names of one key of which the long one begins with the short one.

    `names` has each name of a key once, with the set of sides that it is on (1, 2 or both as 3); only pairs that have
    both sides between them are told. Names that run on from one range of the order to the next meet the prefixes that
    were open there: those are looked up among all names, a few for each range.
    """
    spark = names.sparkSession
    ship_package(spark)
    n = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = names.select(*by, "name", F.col("sides").cast("int").alias("sides"))
    schema = StructType([*rows.schema.fields, StructField("__task", IntegerType())])
    placed = kept(rows.repartitionByRange(n, *by, "name").sortWithinPartitions(*by, "name").mapInArrow(_numbered, schema), "names")
    first = placed.groupBy("__task").agg(F.min(F.struct(*by, "name")).alias("f")).select(F.col("__task").alias("__to"), "f.*")
    # For each task as many rows as its first name has characters.
    proper = first.where(F.length("name") > 0).select("__to", *by, F.explode(F.sequence(F.lit(0), F.length("name") - 1)).alias("k"), "name").select("__to", *by, F.expr("substring(name, 1, k)").alias("name"))
    carried = placed.join(F.broadcast(proper), [*by, "name"]).select(*rows.columns, F.col("__to").alias("__task"), F.lit(True).alias("carried"))
    both = placed.withColumn("carried", F.lit(False)).unionByName(carried)
    pairs = both.repartitionById(n, F.col("__task")).sortWithinPartitions(*by, "name").mapInArrow(
        _stacked(by),
        StructType([*(rows.schema[c] for c in by), StructField("long", StringType()), StructField("long_sides", IntegerType()), StructField("short", StringType()), StructField("short_sides", IntegerType())]),
    )
    pairs._kept_path = placed._kept_path
    return pairs
