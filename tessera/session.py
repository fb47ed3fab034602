"""Session helpers: the shared folder, and tables that cut a long lineage."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    ``spark.checkpoint.dir``, or the context's checkpoint folder, names it on a cluster; without either this fails there. On a
    single machine (tests) a temporary folder is made once for the session.
    """
    context = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path and context.getCheckpointDir() is None and not re.fullmatch(r"local(\[.*\])?", context.master):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(path or "file://" + tempfile.mkdtemp(prefix="tessera-"))
    return (path or context.getCheckpointDir()).rstrip("/")


def fresh_path(spark: SparkSession, tag: str) -> str:
    """A path below the shared folder that nothing else uses."""
    return f"{shared_dir(spark)}/tessera/{tag}-{uuid.uuid4().hex}"


def _place(spark: SparkSession, path: str):
    """(file system, path) of the JVM."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place


def until_exit(spark: SparkSession, path: str) -> str:
    """The path, which is there and will be deleted when the driver's JVM ends."""
    store, place = _place(spark, path)
    store.deleteOnExit(place)
    return path


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    Later stages read the files, so a lost executor costs a read and not the whole
    lineage; rows are computed once however often the result is used. The files are
    deleted when the driver's JVM ends.
    """
    spark = df.sparkSession
    path = fresh_path(spark, tag)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(until_exit(spark, path))


class Scratch:
    """Written tables of one computation, deleted at its end but for those that are kept."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark
        self.paths: list[str] = []

    def table(self, df: DataFrame, tag: str) -> DataFrame:
        """As :func:`materialize`, until the end."""
        path = fresh_path(self.spark, tag)
        self.paths.append(path)
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def folder(self, tag: str) -> str:
        """A folder for tables of one kind, read together."""
        path = fresh_path(self.spark, tag)
        self.paths.append(path)
        return path

    def part(self, df: DataFrame, folder: str, number: int) -> DataFrame:
        """One of the tables of a folder, written."""
        path = f"{folder}/part={number}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *error: object) -> None:
        for path in self.paths:
            store, place = _place(self.spark, path)
            store.delete(place, True)
        self.paths.clear()


def in_order(df: DataFrame, *order: Column | str) -> DataFrame:
    """``df`` with ``place``, from 0, in an order over all its rows that no task holds: ranges are sorted apart and then counted.

    What precedes a range comes from a row a task. There are more ranges the more rows there are. ``df`` is gone over three times, as
    it is counted and sampled before; what is costly to make should be written.
    """
    parts = parts_of(df)
    ranges = df.repartitionByRange(parts, *order) if parts else df.repartitionByRange(*order)
    placed = materialize(ranges.sortWithinPartitions(*order).withColumns({"mid_": F.monotonically_increasing_id(), "part_": F.spark_partition_id()}), "ordered")
    sizes = placed.groupBy("part_").agg(F.min("mid_").alias("first_"), F.count("*").alias("n_"))
    before = F.sum("n_").over(Window.orderBy("part_").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sizes.select("part_", (F.coalesce(before, F.lit(0)) - F.col("first_")).alias("offset_"))
    return placed.join(F.broadcast(offsets), "part_").withColumn("place", F.col("mid_") + F.col("offset_")).drop("part_", "mid_", "offset_")


def broadcast_if_few(df: DataFrame, most: int = 500_000) -> DataFrame:
    """``df``, written, and broadcast in a join while it has so many rows at most."""
    held = materialize(df, "few")
    return F.broadcast(held) if held.count() <= most else held


def dealt(df: DataFrame, parts: int | None, *keys: Column | str) -> DataFrame:
    """``df`` by its keys in so many parts, or as it is without a number.

    Where each row of a part makes several, or a group of its own, adaptive execution, which goes by the bytes that are
    shuffled, and a fixed number of partitions would give a task more the larger the input is.
    """
    return df.repartition(parts, *keys) if parts else df


def parts_of(df: DataFrame, rows: int = 250_000) -> int | None:
    """In how many parts of about ``rows`` rows to deal ``df``; None where one is enough."""
    parts = -(-df.count() // rows)
    return max(parts, df.sparkSession.sparkContext.defaultParallelism) if parts > 1 else None


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's tables."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def local_session(cores: int | str = "*", partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A session for tests and for bench.py."""
    os.environ.setdefault("PYSPARK_PYTHON", os.sys.executable)
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("tessera")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.driver.memory", memory)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark
