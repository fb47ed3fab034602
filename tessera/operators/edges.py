"""Edges of the contact graph: canonical keys, counts and weights."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.session import dealt


def canonical(df: DataFrame, a: str = "ref_id", b: str = "next_ref_id") -> DataFrame:
    """Add ``start`` and ``end``: the smaller and the larger of two ids."""
    return df.withColumns({"start": F.least(a, b), "end": F.greatest(a, b)})


def edge_counts(pairs: DataFrame, a: str = "ref_id", b: str = "next_ref_id", parts: int | None = None) -> DataFrame:
    """``(start, end, n)``: how many pairs join two contigs, in either direction; self edges count too. ``parts`` tasks count, if given."""
    return dealt(canonical(pairs, a, b), parts, "start", "end").groupBy("start", "end").agg(F.count("*").alias("n"))


def edge_weights(counts: DataFrame, sites: DataFrame) -> DataFrame:
    """``(start, end, weight)``: a count over the sites of both ends.

    A self edge is divided by twice its contig's sites. Ends without a row in ``sites`` are left out.
    ``sites`` has a row per contig; whether it is broadcast is left to its size as Spark measures it.
    """
    first = sites.select(F.col("contig_id").alias("start"), F.col("n_sites").alias("sites_start"))
    second = sites.select(F.col("contig_id").alias("end"), F.col("n_sites").alias("sites_end"))
    total = F.col("sites_start") + F.col("sites_end")
    return counts.join(first, "start").join(second, "end").select("start", "end", (F.col("n").cast("double") / total).alias("weight"))


def inter_contig(pairs: DataFrame) -> DataFrame:
    """Pairs that join two different contigs."""
    return pairs.where("ref_id <> next_ref_id")


def directed(edges: DataFrame) -> DataFrame:
    """Each edge and its reverse, ``(src, dst, weight)``; a self edge comes twice."""
    there = edges.select(F.col("start").alias("src"), F.col("end").alias("dst"), "weight")
    return there.unionAll(edges.select(F.col("end").alias("src"), F.col("start").alias("dst"), "weight"))
