"""Binned contacts within contigs: histogram, saturation, spanning score and its grid."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.motifs import truncated5
from tessera.session import dealt


def contact_histogram(records: DataFrame, bins: list[int], contig: str = "contig_id", parts: int | None = None) -> DataFrame:
    """``(contig_id, res, a, b, cnt)``: records (contig, pos, next_pos) counted by bins of both positions.

    All bin sizes come from one pass. The direction is kept: (a, b) and (b, a) are two bins. ``parts`` tasks count, if given.
    """
    each = records.select(F.col(contig).alias("contig_id"), "pos", "next_pos", F.explode(F.array(*map(F.lit, bins))).alias("res"))
    binned = each.select("contig_id", "res", (F.col("pos") - F.col("pos") % F.col("res")).alias("a"), (F.col("next_pos") - F.col("next_pos") % F.col("res")).alias("b"))
    return dealt(binned, parts, "contig_id", "res", "a", "b").groupBy("contig_id", "res", "a", "b").agg(F.count("*").alias("cnt"))


def saturation(hist: DataFrame, percent: float) -> DataFrame:
    """``(contig_id, res, sat)``: the count at rank ``(n + 1) * percent`` among bins off the diagonal.

    Between two ranks it is interpolated, below rank 1 it is the least, from rank n on the greatest; -1 without
    such bins. Ranks come from how many bins have each count, so a contig's bins aren't sorted in one task.
    """
    all_ = hist.select("contig_id", "res").distinct()
    levels = hist.where("a <> b").groupBy("contig_id", "res", "cnt").agg(F.count("*").alias("m"))
    by = Window.partitionBy("contig_id", "res")
    upto = levels.withColumn("upto", F.sum("m").over(by.orderBy("cnt").rowsBetween(Window.unboundedPreceding, 0))).withColumn("n", F.sum("m").over(by))
    rank = (F.col("n") + 1) * F.lit(float(percent))
    ranked = upto.withColumn("rank", F.greatest(F.lit(1.0), F.least(rank, F.col("n").cast("double")))).withColumn("low", F.floor("rank"))
    met = ranked.groupBy("contig_id", "res").agg(
        F.min(F.when(F.col("upto") >= F.col("low"), F.col("cnt"))).alias("x"), F.min(F.when(F.col("upto") >= F.col("low") + 1, F.col("cnt"))).alias("y"), F.first("rank").alias("rank"), F.first("low").alias("low")
    )
    x = F.col("x").cast("double")
    sat = x + F.coalesce((F.col("rank") - F.col("low")) * (F.col("y").cast("double") - x), F.lit(0.0))
    return all_.join(met.select("contig_id", "res", sat.alias("sat")), ["contig_id", "res"], "left").select("contig_id", "res", F.coalesce("sat", F.lit(-1.0)).alias("sat"))


def spanning_score(hist: DataFrame, sat: DataFrame, bin_size: int, depth: int) -> DataFrame:
    """``(contig_id, pos, score)``: for each bin pair a < b no further apart than ``depth``, its count, at most the
    whole part of the saturation, is added to every grid point strictly between."""
    caps = sat.where(F.col("res") == bin_size).select("contig_id", F.col("sat").cast("int").alias("cap"))
    spans = hist.where((F.col("res") == bin_size) & (F.col("b") - F.col("a") <= depth) & (F.col("b") - F.col("a") >= 2 * bin_size))
    capped = spans.join(caps, "contig_id").select("contig_id", F.least("cnt", F.col("cap").cast("bigint")).alias("v"), F.explode(F.sequence(F.col("a") + bin_size, F.col("b") - bin_size, F.lit(bin_size))).alias("pos"))
    return capped.groupBy("contig_id", "pos").agg(F.sum("v").cast("double").alias("score"))


def score_grid(score: DataFrame, bin_size: int, depth: int) -> DataFrame:
    """``(contig_id, pos, score)`` at every grid point of a contig but those near its ends, 0 where there is no score.

    The grid goes from ``min + depth - 2 * bin_size`` up to but not including ``max - depth + 3 * bin_size``; where
    ``bin_size`` doesn't divide ``depth`` it meets no score.
    """
    ends = score.groupBy("contig_id").agg((F.min("pos") + depth - 2 * bin_size).alias("lo"), (F.max("pos") - depth + 3 * bin_size - 1).alias("hi")).where("lo <= hi")
    grid = ends.select("contig_id", F.explode(F.sequence("lo", "hi", F.lit(bin_size))).alias("pos"))
    return grid.join(score, ["contig_id", "pos"], "left").select("contig_id", "pos", F.coalesce("score", F.lit(0.0)).alias("score"))


def wide_saturation(sat: DataFrame, bin_size: int) -> DataFrame:
    """(contig_id, res, sat) of one bin size, cut to five decimals."""
    return sat.where(F.col("res") == bin_size).withColumn("sat", truncated5(F.col("sat")))
