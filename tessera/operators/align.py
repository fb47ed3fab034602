"""Alignment records: quality filters, names to ids, and positions inside windows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The quality that stands for "not available" in alignment files.
NO_QUALITY = 255


def quality_filter(records: DataFrame, least: int) -> DataFrame:
    """Records of at least this quality, without those whose quality isn't available."""
    return records.where((F.col("mapq") >= least) & (F.col("mapq") != NO_QUALITY))


def same_contig_filter(records: DataFrame, least: int) -> DataFrame:
    """Records of at least this quality (one that isn't available is kept) with both ends placed on one contig."""
    placed = F.col("pos").isNotNull() & F.col("next_pos").isNotNull() & (F.col("pos") != -1) & (F.col("next_pos") != -1)
    return records.where((F.col("mapq") >= least) & placed & (F.col("ref_name") == F.col("next_ref_name")))


def contig_ids(contigs: DataFrame) -> DataFrame:
    """(name, id), the first id of a name that comes twice."""
    return contigs.groupBy("name").agg(F.min("id").alias("id"))


def assert_unique_names(contigs: DataFrame) -> DataFrame:
    """``contigs``; an action fails on a name that comes twice."""
    doubles = contigs.groupBy("name").count().where("count > 1").limit(1).collect()
    if doubles:
        raise ValueError(f"contig {doubles[0]['name']!r} comes more than once")
    return contigs


def named_to_ids(records: DataFrame, contigs: DataFrame) -> DataFrame:
    """Records with ``ref_id`` and ``next_ref_id`` instead of names; records with an unknown or missing name go."""
    ids = contig_ids(contigs)
    first = ids.select(F.col("name").alias("ref_name"), F.col("id").alias("ref_id"))
    second = ids.select(F.col("name").alias("next_ref_name"), F.col("id").alias("next_ref_id"))
    return records.join(first, "ref_name").join(second, "next_ref_name").drop("ref_name", "next_ref_name")


def without_contigs(records: DataFrame, invalid: DataFrame) -> DataFrame:
    """Records neither of whose ends lies on one of the given contigs (contig_id)."""
    a, b = invalid.select(F.col("contig_id").alias("ref_id")), invalid.select(F.col("contig_id").alias("next_ref_id"))
    return records.join(a, "ref_id", "left_anti").join(b, "next_ref_id", "left_anti")


def positions_in_windows(records: DataFrame, windows: DataFrame, *, contig: str = "ref_id", pos: str = "pos", bucket: int = 1 << 16) -> DataFrame:
    """Records whose position lies in a window of its contig, both ends included.

    ``windows``: (contig_id, start, end). Windows are dealt to the buckets of ``bucket`` positions that they
    touch, so that the join's keys are (contig, bucket) and a contig of many windows isn't one key. Contigs
    without windows have no positions inside one.
    """
    cut = windows.select(F.col("contig_id").alias("w_contig"), F.col("start").alias("w_start"), F.col("end").alias("w_end"), F.explode(F.expr(f"sequence(cast(floor(start / {bucket}) AS bigint), cast(floor(end / {bucket}) AS bigint))")).alias("w_bucket"))
    on = (F.col(contig) == F.col("w_contig")) & (F.floor(F.col(pos) / bucket) == F.col("w_bucket")) & F.col(pos).between(F.col("w_start"), F.col("w_end"))
    return records.join(cut, on, "left_semi")
