"""Vectors kept as a numpy matrix beside a JSON list of as many names: a data source that tasks read by ranges of rows."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from shutterlake.session import ship_package

#: Rows of the matrix that one task reads, of which so many are in a batch.
ROWS, BATCH = 1 << 16, 1 << 12
_NAME = re.compile(rb'"(?:[^"\\]|\\.)*"', re.S)


def name_offsets(path: str, every: int, piece: int = 1 << 20) -> tuple[list[int], int]:
    """Where in a JSON list of strings each `every`-th one begins, and how many there are; the file passes in pieces."""
    offsets: list[int] = []
    n = at = 0
    held = b""
    with open(path, "rb") as file:
        while more := file.read(piece):
            held += more
            end = 0
            for m in _NAME.finditer(held):
                if n % every == 0:
                    offsets.append(at + m.start())
                n, end = n + 1, m.end()
            # What comes after the last whole name may be the beginning of the next one.
            at, held = at + end, held[end:]
    return offsets, n


class Rows(InputPartition):
    """A range of rows, and the bytes of the list that have their names."""

    def __init__(self, first: int, end: int, start: int, stop: int | None) -> None:
        self.first, self.end, self.start, self.stop = first, end, start, stop


class MatrixReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.matrix, self.names, self.rows = options["matrix"], options["names"], int(options.get("rows", ROWS))

    def partitions(self) -> list[InputPartition]:
        rows = len(np.load(self.matrix, mmap_mode="r"))
        offsets, listed = name_offsets(self.names, self.rows)
        if listed != rows:
            raise RuntimeError(f"{rows} vectors have {listed} names")
        return [Rows(k * self.rows, min(rows, (k + 1) * self.rows), a, b) for k, (a, b) in enumerate(zip(offsets, [*offsets[1:], None], strict=True))]

    def read(self, partition: Rows) -> Iterator[pa.RecordBatch]:
        with open(self.names, "rb") as file:
            file.seek(partition.start)
            text = file.read(-1 if partition.stop is None else partition.stop - partition.start)
        names = json.loads(b"[" + text.rstrip(b", \t\r\n]") + b"]")
        x = np.load(self.matrix, mmap_mode="r")
        for a in range(partition.first, partition.end, BATCH):
            b = min(a + BATCH, partition.end)
            part = np.ascontiguousarray(x[a:b], np.float32)
            vectors = pa.ListArray.from_arrays(pa.array(np.arange(b - a + 1, dtype=np.int32) * part.shape[1]), pa.array(part.reshape(-1)))
            yield pa.RecordBatch.from_arrays([pa.array(names[a - partition.first : b - partition.first], pa.string()), vectors], names=["path", "embedding"])


class Matrix(DataSource):
    """spark.read.format("named_matrix") with options matrix, names and rows (of a task)."""

    @classmethod
    def name(cls) -> str:
        return "named_matrix"

    def schema(self) -> str:
        return "path string, embedding array<float>"

    def reader(self, schema) -> DataSourceReader:
        return MatrixReader(self.options)


def read_matrix(spark: SparkSession, matrix: str, names: str, rows_per_task: int = ROWS) -> DataFrame:
    """(path, embedding) of a numpy matrix and a JSON list of as many names; no task reads more than its rows of either."""
    ship_package(spark)
    spark.dataSource.register(Matrix)
    found = len(np.load(matrix, mmap_mode="r"))
    if (listed := name_offsets(names, rows_per_task)[1]) != found:
        raise RuntimeError(f"{found} vectors have {listed} names")
    return spark.read.format("named_matrix").options(matrix=matrix, names=names, rows=rows_per_task).load()
