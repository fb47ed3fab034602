"""Motif sites of sequences, and the windows around them."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _found(sequence: Column, motif: str, ignore_case: bool) -> tuple[Column, str]:
    return (F.upper(sequence), motif.upper()) if ignore_case else (sequence, motif)


def site_count(sequence: Column, motif: str, ignore_case: bool = False) -> Column:
    """How often a motif occurs, from left to right without overlap; null for null."""
    text, m = _found(sequence, motif, ignore_case)
    return ((F.char_length(text) - F.char_length(F.replace(text, F.lit(m), F.lit("")))) / len(m)).cast("bigint")


def sites(contigs: DataFrame, motif: str, ignore_case: bool = False) -> DataFrame:
    """``(contig_id, pos, length)``: a row for each site of ``contigs`` (id, seq).

    Long sequences are cut by an exploded split and a running sum within each, so a sequence of many sites needs
    no growing array.
    """
    text, m = _found(F.col("seq"), motif, ignore_case)
    parts = contigs.where("seq IS NOT NULL").select(F.col("id").alias("contig_id"), F.char_length("seq").alias("length"), F.posexplode(F.transform(F.split(text, "\\Q" + m + "\\E", -1), lambda p: F.char_length(p))).alias("k", "n"))
    before = Window.partitionBy("contig_id").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    placed = parts.select("contig_id", "length", "k", (F.sum("n").over(before) + F.col("k") * len(m)).cast("int").alias("pos"), F.max("k").over(Window.partitionBy("contig_id")).alias("last"))
    return placed.where("k < last").select("contig_id", "pos", "length")


def site_windows(found: DataFrame, half_range: int) -> DataFrame:
    """``(contig_id, start, end)``: ``half_range`` either side of each site, cut at the ends, merged where they meet.

    ``found``: (contig_id, pos, length). A window that starts at or before the end of the one before is merged with it;
    as ends only grow, the one before is enough to look at.
    """
    clamped = found.select("contig_id", F.greatest(F.lit(0), F.col("pos") - half_range).alias("s"), F.least(F.col("pos") + half_range, F.col("length")).alias("e"))
    ordered = Window.partitionBy("contig_id").orderBy("s", "e")
    starts = F.when(F.col("s") <= F.lag("e").over(ordered), 0).otherwise(1)
    numbered = clamped.withColumn("starts", starts).withColumn("island", F.sum("starts").over(ordered.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy("contig_id", "island").agg(F.min("s").cast("int").alias("start"), F.max("e").cast("int").alias("end")).drop("island")


def windows_around_sites(contigs: DataFrame, motif: str, half_range: int, ignore_case: bool = False) -> DataFrame:
    """``(contig_id, start, end)``: the windows of :func:`site_windows` around the sites of ``contigs`` (id, seq).

    Sites are found and windows merged where a sequence is, so nothing is shuffled or sorted, and a chromosome's many
    sites are a task's work that is in proportion to its length. Null sequences, and those without a site, have no window.
    """
    text, m = _found(F.col("seq"), motif, ignore_case)
    rows = contigs.where("seq IS NOT NULL").select(F.col("id").alias("contig_id"), text.cast("string").alias("seq"))
    schema = T.StructType([rows.schema["contig_id"], T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])
    pattern = re.compile(re.escape(m))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows_: list[np.ndarray] = []
            lows: list[np.ndarray] = []
            highs: list[np.ndarray] = []
            for k in range(batch.num_rows):
                seq = batch.column(1)[k].as_py()
                at = np.fromiter((x.start() for x in pattern.finditer(seq)), np.int64)
                if not len(at):
                    continue
                low, high = np.maximum(at - half_range, 0), np.minimum(at + half_range, len(seq))
                first = np.flatnonzero(np.concatenate([[True], low[1:] > high[:-1]]))
                rows_.append(np.full(len(first), k))
                lows.append(low[first])
                highs.append(high[np.concatenate([first[1:] - 1, [len(at) - 1]])])
            if rows_:
                ids = batch.column(0).take(pa.array(np.concatenate(rows_)))
                yield pa.RecordBatch.from_arrays([ids, pa.array(np.concatenate(lows), pa.int32()), pa.array(np.concatenate(highs), pa.int32())], names=schema.names)

    return rows.mapInArrow(run, schema)


def contig_sites(contigs: DataFrame, motif: str, ignore_case: bool = False) -> DataFrame:
    """``(contig_id, n_sites)`` for each contig, those without a site too."""
    return contigs.select(F.col("id").alias("contig_id"), F.coalesce(site_count(F.col("seq"), motif, ignore_case), F.lit(0)).cast("bigint").alias("n_sites"))


def invalid_contigs(counts: DataFrame, least: int) -> DataFrame:
    """Ids of contigs with fewer sites than ``least``; none for a ``least`` below 1."""
    return counts.where(F.col("n_sites") < least).select("contig_id")
