"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.session import broadcast_if_few, shared_dir


def _links(edges: DataFrame) -> DataFrame:
    return edges.where("a <> b").select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).distinct()


def _large_star(links: DataFrame) -> DataFrame:
    """Every neighbour larger than a node moves to the least node of its neighbourhood."""
    both = links.union(links.select(F.col("u").alias("v"), F.col("v").alias("u")))
    least = both.groupBy("v").agg(F.least(F.min("u"), F.col("v")).alias("m"))
    larger = links.select(F.col("u").alias("v"), F.col("v").alias("w"))
    return larger.join(least, "v").select(F.col("w").alias("a"), F.col("m").alias("b"))


def _small_star(links: DataFrame) -> DataFrame:
    """Every smaller neighbour of a node, and the node, move to the least of them."""
    least = links.groupBy("v").agg(F.min("u").alias("m"))
    moved = links.join(least, "v").select(F.col("u").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select(F.col("v").alias("a"), F.col("m").alias("b")))


def _mark(links: DataFrame) -> tuple:
    row = links.agg(F.count("*"), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).first()
    return tuple(row)


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """``(node, component)`` for every node of ``edges``; component is the least node reachable.

    Edges are undirected. Rows with a null end are ignored, repeated and self edges change
    nothing (a node that has only self edges is its own component); an empty table gives an
    empty result. Each round is checkpointed in the shared folder; the number of rounds grows
    with the logarithm of the longest path, and no round gathers a node's neighbours.
    """
    shared_dir(edges.sparkSession)
    pairs = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a IS NOT NULL AND b IS NOT NULL")
    nodes = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    links = _links(pairs).checkpoint()
    mark = _mark(links)
    for _ in range(max_rounds):
        if not mark[0]:
            break
        links = _links(_small_star(_links(_large_star(links)))).checkpoint()
        before, mark = mark, _mark(links)
        if mark == before:
            break
    else:
        raise RuntimeError("components did not settle")
    roots = links.select(F.col("v").alias("node"), F.col("u").alias("component"))
    return nodes.join(roots, "node", "left").select("node", F.coalesce("component", "node").alias("component"))


def fewer_links(directed: DataFrame) -> DataFrame:
    """``(a, b)``: fewer edges with the components of ``directed`` (src, dst), which has the reverse of each of its edges.

    Each node's least neighbour, and the edges between these: of a dense graph about an edge a node is left.
    """
    least = broadcast_if_few(directed.groupBy("src").agg(F.least(F.min("dst"), F.col("src")).alias("m")))
    ends = directed.where("src < dst").join(least.select("src", F.col("m").alias("a")), "src").join(least.select(F.col("src").alias("dst"), F.col("m").alias("b")), "dst")
    return least.select(F.col("src").alias("a"), F.col("m").alias("b")).unionAll(ends.where("a <> b").select("a", "b").distinct())
