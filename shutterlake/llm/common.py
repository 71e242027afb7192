"""What the corpus operators share: reading, shared-folder tables, Arrow limits."""

from __future__ import annotations

import atexit
import gc
import json
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from shutterlake.session import ship_package


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A table of the input folder, after the session was made ready for Python stages."""
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def prepare(spark: SparkSession) -> None:
    """Ship the code and bound what one Arrow batch may hold (long documents travel few at a time).

    The session's own limits stay if they are lower; they are lowered for good, as plans run later than they are made.
    """
    ship_package(spark)
    for name, most in (("maxBytesPerBatch", 8 << 20), ("maxRecordsPerBatch", 4096)):
        setting = f"spark.sql.execution.arrow.{name}"
        now = re.fullmatch(r"[0-9]+", str(spark.conf.get(setting, None)))
        if not now or not 0 < int(now[0]) <= most:
            spark.conf.set(setting, str(most))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, which spark.checkpoint.dir names.

    Where it isn't set, a temporary one serves a session on one machine, as in tests; on a cluster this raises.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="shutterlake-shared-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def partitions_of(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def stored(df: DataFrame, name: str, parts: str | None = None) -> DataFrame:
    """The frame written as a Parquet table in the shared folder and read again: lineage ends here and survives lost executors.

    With `parts`, a column of few values, the rows of each value are apart, for forget_part().
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/shutterlake-{name}-{uuid.uuid4().hex}"
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(parts) if parts else writer).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._shutterlake_paths = [path]
    return out


#: A key is hot with more rows than HOT_ROWS and more than 1 / HOT_KEYS of all: fewer than HOT_KEYS keys can be.
HOT_ROWS, HOT_KEYS = 128, 4096


def hot_limit(rows: int) -> int:
    """Keys with more rows than this, among so many rows, are hot."""
    return max(HOT_ROWS, rows // HOT_KEYS)


def spread_join(rows: DataFrame, facts: DataFrame, key: str, hot: F.Column, salt: list[str]) -> DataFrame:
    """rows left-joined with facts(key, ...), one row for each key, however many rows a key has.

    `hot` says of a fact whether its key is hot; by hot_limit() these are fewer than HOT_KEYS, and they are sent to the
    tasks. The rows that met one go through the shuffle of the others by a hash of their `salt` columns, and meet
    nothing there. Null keys meet nothing.
    """
    values = [c for c in facts.columns if c != key]
    fact = F.struct(*values) if values else F.struct(F.lit(True).alias("known"))
    facts = facts.where(F.col(key).isNotNull())
    sent = facts.where(hot).select(F.col(key).alias("__hot"), fact.alias("__hot_fact"))
    met = rows.join(F.broadcast(sent), F.col(key) == F.col("__hot"), "left")
    cold = F.col("__hot").isNull() & F.col(key).isNotNull()
    # Key and salt are one value: as two, the side whose salt is always 0 would have the rows dealt by the key alone.
    salted = lambda k, s: F.struct(k.alias("key"), s.alias("salt"))
    met = met.withColumn("__key", salted(F.when(cold, F.col(key)), F.when(cold, F.lit(0).cast("long")).otherwise(F.xxhash64(*salt))))
    rest = facts.where(~hot).select(salted(F.col(key), F.lit(0).cast("long")).alias("__key"), fact.alias("__fact"))
    joined = met.join(rest, "__key", "left").withColumn("__fact", F.coalesce("__hot_fact", "__fact"))
    return joined.select(*rows.columns, *[F.col("__fact")[c].alias(c) for c in values])


def shares_of(rows: DataFrame, key: str, limit: int) -> DataFrame:
    """(key, shares) of the hot keys among the rows, by hot_limit() fewer than HOT_KEYS: as many shares as tasks should have of each."""
    counted = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > limit)
    return counted.select(key, F.ceil(F.col("n") / limit).cast("int").alias("shares"))


def copied_join(rows: DataFrame, facts: DataFrame, key: str, salt: list[str], shares: DataFrame) -> DataFrame:
    """rows joined with facts(key, ...), which may be large: a hot key's facts are copied, once for each share.

    What is broadcast are the hot keys' numbers of shares alone. With one fact a key, the copies are fewer than HOT_KEYS
    twice.
    """
    hot = F.broadcast(shares)
    dealt = rows.join(hot, key, "left").withColumn("__share", F.pmod(F.xxhash64(*salt), F.coalesce("shares", F.lit(1))).cast("int")).drop("shares")
    copies = facts.join(hot, key, "left").withColumn("__share", F.explode(F.sequence(F.lit(0), F.coalesce("shares", F.lit(1)) - 1))).drop("shares")
    # Key and share are one value: else the rows would be dealt by the key alone where an order by it is at hand.
    both = lambda df: df.withColumn("__at", F.struct(key, "__share")).drop("__share")
    return both(dealt).join(both(copies).drop(key), "__at").drop("__at")


def write_buckets(df: DataFrame, path: str, column: str, buckets: int) -> None:
    """The frame as Parquet files bucketed by a column, for read_buckets(). The catalogue keeps no table of them."""
    name = f"shutterlake_{uuid.uuid4().hex}"
    writer = df.write.bucketBy(buckets, column).option("path", path).option("compression", "zstd").option("parquet.enable.dictionary", "false")
    writer.saveAsTable(name)
    df.sparkSession.sql(f"DROP TABLE {name}")  # an external table: its files stay
    layout = json.dumps({"schema": df.schema.jsonValue(), "column": column, "buckets": buckets})
    files, at = _files(df.sparkSession, f"{path}-layout")
    with_end = files.create(at)
    with_end.write(bytearray(layout.encode()))
    with_end.close()


def read_buckets(spark: SparkSession, path: str) -> DataFrame:
    """A frame of files that write_buckets() wrote; joins of it on its column needn't move it."""
    files, at = _files(spark, f"{path}-layout")
    begun = files.open(at)
    layout = json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(begun, "UTF-8"))
    begun.close()
    schema = StructType.fromJson(layout["schema"])
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
    name = f"shutterlake_{uuid.uuid4().hex}"
    spark.sql(f"CREATE TABLE {name} ({columns}) USING parquet CLUSTERED BY (`{layout['column']}`) INTO {layout['buckets']} BUCKETS LOCATION '{path}'")
    out = spark.table(name)
    out.schema  # noqa: B018  resolved before its name goes
    spark.sql(f"DROP TABLE {name}")
    out._shutterlake_paths = [path, f"{path}-layout"]
    return out


def release(spark: SparkSession) -> None:
    """Let go of the shuffle files of frames that were stored and aren't referenced any more: Spark drops them on collection."""
    gc.collect()
    spark._jvm.System.gc()


def _files(spark: SparkSession, path: str):
    """The file system that a path is in, and the path for it."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def remove(spark: SparkSession, path: str) -> None:
    """Delete a file or folder, wherever Spark keeps it."""
    files, at = _files(spark, path)
    files.delete(at, True)


def standing_on(df: DataFrame, *tables: DataFrame) -> DataFrame:
    """The same frame, whose forget() deletes these tables that it reads."""
    df._shutterlake_paths = [p for t in tables for p in getattr(t, "_shutterlake_paths", [])]
    return df


def forget_part(df: DataFrame, part: str) -> None:
    """Delete the rows of one value of stored()'s `parts`, given as name=value."""
    remove(df.sparkSession, f"{df._shutterlake_paths[0]}/{part}")


def forget(df: DataFrame) -> None:
    """Delete the tables behind a frame of stored(), read_buckets() or standing_on(); only once nothing can read it any more."""
    for path in getattr(df, "_shutterlake_paths", []):
        remove(df.sparkSession, path)
