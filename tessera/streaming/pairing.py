"""Mates over streams: records s -> d become pairs as they come, the same ones as in a batch of all.

What a record does depends on two positions, so no key keeps it in one group. The state is therefore a table of entries in the
shared folder, and each micro-batch is reconciled with it by the rounds of the batch operator.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import DataStreamWriter

from tessera.operators.pairing import RECORD, TAIL, as_pairs, directions, entries_of, met
from tessera.session import Scratch


def _schemas(records: T.StructType) -> dict[str, T.StructType]:
    """Those of the tables ``entries`` (p, at, mate) and ``pairs`` (s, d)."""
    place = T.StructType([T.StructField("file", records["file"].dataType), T.StructField("id", records["ref_id"].dataType), T.StructField("at", records["pos"].dataType)])
    return {"entries": T.StructType([T.StructField("p", place), T.StructField("at", T.LongType()), T.StructField("mate", place)]), "pairs": T.StructType([T.StructField("s", place), T.StructField("d", place)])}


def _before(spark: SparkSession, folder: str, name: str, schema: T.StructType, batch: int) -> DataFrame:
    """The parts of a state table that batches before this one wrote."""
    held = spark.read.schema(T.StructType([*schema.fields, T.StructField("part", T.LongType())])).parquet(f"{folder}/{name}")
    return held.where(F.col("part") < batch).drop("part")


def _fold(folder: str, tail: int) -> Callable[[DataFrame, int], None]:
    folder = folder.rstrip("/")

    def run(records: DataFrame, batch: int) -> None:
        spark, schemas = records.sparkSession, _schemas(records.schema)
        if batch == 0:
            for name, schema in schemas.items():
                spark.createDataFrame([], schema).write.mode("overwrite").parquet(f"{folder}/{name}/part=-1")
        old, told = (_before(spark, folder, name, schemas[name], batch) for name in ("entries", "pairs"))
        with Scratch(spark) as scratch:
            pairs = scratch.table(directions(records.dropna(subset=list(RECORD))), "mates")
            positions = pairs.select(F.col("s").alias("p")).union(pairs.select("d")).distinct()
            known = scratch.table(old.join(positions, "p", "left_semi"), "known")
            entered = known.select("p")
            fresh = pairs.join(entered.withColumnRenamed("p", "s"), "s", "left_anti").join(entered.withColumnRenamed("p", "d"), "d", "left_anti")
            new = entries_of(scratch, fresh, tail)
            new.write.mode("overwrite").parquet(f"{folder}/entries/part={batch}")
            made = met(pairs, known.unionByName(new)).join(told, ["s", "d"], "left_anti")
            made.select("s", "d").write.mode("overwrite").parquet(f"{folder}/pairs/part={batch}")

    return run


def pair_stream(records: DataFrame, folder: str, tail: int = TAIL) -> DataStreamWriter:
    """A writer, not started, that keeps the pairs of a stream of records (file, rec_no, ref_id, pos, next_ref_id, next_pos) in ``folder``.

    A file's records must come in the order of ``rec_no`` from one micro-batch to the next; inside one they may stand in any order, and files may
    mix. Whatever the cuts, the pairs are those of :func:`tessera.operators.pairing.mate_pairs` over all records so far: an entry is made
    once, by the first record that may, and no later batch changes it. A batch without rows changes nothing; rows with a null in any of these columns are left out, and other columns aren't read.

    ``folder`` must be shared, as it holds state and checkpoint. The state is a row for each position that has made an entry and one for each pair, in
    a part a batch. A batch reads earlier parts and replaces its own, so one that is run again after a failure leaves the same tables.
    """
    return records.writeStream.foreachBatch(_fold(folder, tail)).option("checkpointLocation", f"{folder.rstrip('/')}/checkpoint")


def streamed_pairs(spark: SparkSession, folder: str, records: T.StructType) -> DataFrame:
    """``(ref_id, pos, next_ref_id, next_pos)`` of all pairs so far, for a stream of the schema ``records``."""
    return as_pairs(spark.read.schema(_schemas(records)["pairs"]).parquet(f"{folder.rstrip('/')}/pairs"))
