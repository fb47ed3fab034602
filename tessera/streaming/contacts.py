"""The aggregates of the contact graph over streams of records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.contacts import contact_histogram
from tessera.operators.edges import edge_counts


def streaming_edge_counts(pairs: DataFrame) -> DataFrame:
    """``(start, end, n)`` so far; for complete or update mode. The state is a row for each edge."""
    return edge_counts(pairs)


def streaming_histogram(records: DataFrame, bins: list[int]) -> DataFrame:
    """``(contig_id, res, a, b, cnt)`` so far; for complete or update mode."""
    return contact_histogram(records, bins)


def windowed_edge_counts(pairs: DataFrame, time: str, width: str, late: str) -> DataFrame:
    """``(window, start, end, n)``: edges by tumbling windows of event time; windows close ``late`` behind the latest row."""
    keyed = pairs.withWatermark(time, late).withColumns({"start": F.least("ref_id", "next_ref_id"), "end": F.greatest("ref_id", "next_ref_id")})
    return keyed.groupBy(F.window(time, width).alias("window"), "start", "end").agg(F.count("*").alias("n"))
