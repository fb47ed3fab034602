"""Depleted segments: runs of low score, refined on a narrower grid. Contigs are scanned in ranges, see :mod:`tessera.operators.ranges`."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.ranges import neighbours, running
from tessera.session import materialize

#: Grid cells of a contig that are scanned together.
CELLS = 4_096
_BY = ["contig_id"]


def wide_regions(grid: DataFrame, sat: DataFrame, sensitivity: float, bin_size: int, depth: int, *, cells: int = CELLS) -> DataFrame:
    """``(contig_id, a, b)``: from the first grid point below the threshold to the next that isn't.

    A region open at the last point ends a bin after it. The threshold is
    ``sensitivity * sat * 0.5 * depth / bin * (depth / bin - 1)``; ``sat`` has a row per contig, -1 for none.
    """
    ratio, span = float(depth) / float(bin_size), cells * bin_size
    threshold = F.lit(float(sensitivity)) * F.col("sat") * 0.5 * float(depth) / float(bin_size) * (ratio - 1.0)
    marked = grid.join(sat.where("sat <> -1").select("contig_id", threshold.alias("t")), "contig_id").select("contig_id", "pos", (F.col("score") < F.col("t")).alias("below"))
    near = neighbours(materialize(marked, "marked"), _BY, "pos", span, before=["below"], after=["pos"])
    opens = F.when(F.coalesce("before_below", F.lit(False)), 0).otherwise(1)
    low = materialize(near.where("below").select("contig_id", "pos", opens.alias("opens"), F.coalesce("after_pos", F.col("pos") + bin_size).alias("end")), "low")
    islands = running(low, _BY, "pos", span, F.col("opens"), F.sum, "island")
    return islands.groupBy("contig_id", "island").agg(F.min("pos").alias("a"), F.max("end").alias("b")).drop("island")


def _merged(cells: DataFrame, span: int) -> DataFrame:
    """Cells (contig_id, a, b) whose ends meet become one."""
    near = neighbours(cells, _BY, "a", span, before=["b"])
    opens = materialize(near.select("contig_id", "a", "b", F.when(F.col("before_b") == F.col("a"), 0).otherwise(1).alias("opens")), "opens")
    islands = running(opens, _BY, "a", span, F.col("opens"), F.sum, "island")
    return islands.groupBy("contig_id", "island").agg(F.min("a").alias("a"), F.max("b").alias("b")).drop("island")


def least_scores(regions: DataFrame, grid: DataFrame, bin_size: int, *, cells: int = CELLS) -> DataFrame:
    """``(contig_id, a, b, least)``: the least score that a region is held against, of the regions that are looked at.

    A region takes the grid's points after those of the region before, through the first at or after its end; one at
    least. Where some of them are at or before its start, its least score is that of the points from the last of these on; else the least
    of the region before (0 before the first) counts too. The region that the grid's last point leaves open is the last looked at.

    The grid has all multiples of ``bin_size`` from its first point to its last, so points are numbers. With the region's
    number k and the number e of the first point at or after its end, its last point is ``k + max(e - k)`` over the regions up to it.
    """
    span = cells * bin_size
    reach = grid.groupBy("contig_id").agg(F.min("pos").alias("lo"), F.max("pos").alias("hi")).select("contig_id", "lo", ((F.col("hi") - F.col("lo")) / bin_size).cast("long").alias("top"))
    kth = running(regions.select("contig_id", "a", "b"), _BY, "a", span, F.lit(1), F.sum, "k").join(reach, "contig_id")
    numbered = kth.withColumns({"first": F.floor((F.col("a") - F.col("lo")) / bin_size), "e": F.greatest(F.lit(0), F.ceil((F.col("b") - F.col("lo")) / bin_size))})
    ended = running(materialize(numbered, "numbered"), _BY, "a", span, F.col("e") - F.col("k"), F.max, "lag").withColumn("last", F.col("k") + F.col("lag"))
    after = neighbours(materialize(ended, "ended"), _BY, "a", span, before=["last"]).withColumn("before", F.coalesce("before_last", F.lit(-1))).where("before <= top")
    start = F.least("first", "top")
    taken = after.withColumn("anew", (start > F.col("before")).cast("int")).withColumns({"from": F.when(start > F.col("before"), start).otherwise(F.col("before") + 1), "to": F.least("last", "top")})
    taken = materialize(running(materialize(taken.select("contig_id", "a", "b", "lo", "from", "to", "anew"), "taken"), _BY, "a", span, F.col("anew"), F.sum, "chain"), "chains")
    points = taken.where("from <= to").select("contig_id", "a", F.explode(F.sequence("from", "to")).alias("i"), "lo").select("contig_id", "a", (F.col("lo") + F.col("i") * bin_size).alias("pos"))
    own = points.join(grid.select("contig_id", F.col("pos").cast("long").alias("pos"), "score"), ["contig_id", "pos"]).groupBy("contig_id", "a").agg(F.min("score").alias("own"))
    scored = materialize(taken.select("contig_id", "a", "b", "chain").join(own, ["contig_id", "a"], "left"), "scored")
    carried = running(scored, ["contig_id", "chain"], "a", span, F.col("own"), F.min, "least")
    return carried.select("contig_id", "a", "b", F.when(F.col("chain") == 0, F.least("least", F.lit(0.0))).otherwise(F.col("least")).alias("least"))


def narrow_cells(regions: DataFrame, grid: DataFrame, bin_size: int, *, cells: int = CELLS) -> DataFrame:
    """``(contig_id, a, b)``: cells of each region, from its start on, whose score is the least of :func:`least_scores`."""
    kind = regions.schema["a"].dataType
    each = least_scores(regions, grid, bin_size, cells=cells).select("contig_id", "least", F.explode(F.sequence(F.col("a"), F.col("b") - 1, F.lit(bin_size).cast(kind))).alias("pos"))
    met = each.join(grid, ["contig_id", "pos"]).where("score = least")
    return met.select("contig_id", F.col("pos").cast(kind).alias("a"), (F.col("pos") + bin_size).cast(kind).alias("b"))


def narrow_regions(regions: DataFrame, grid: DataFrame, bin_size: int, *, cells: int = CELLS) -> DataFrame:
    """``(contig_id, a, b)``: regions, apart from one another, refined on the narrow grid; a contig without any refined cell keeps its regions.

    Points meet regions by contig and position, so no task holds a contig.
    """
    regions, grid = materialize(regions.select("contig_id", "a", "b"), "regions"), materialize(grid, "grid")
    found = materialize(narrow_cells(regions, grid, bin_size, cells=cells), "cells")
    kept = regions.join(found.select("contig_id").distinct(), "contig_id", "left_anti")
    return _merged(found, cells * bin_size).unionByName(kept)
