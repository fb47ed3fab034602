"""The contact graph: ranks, trusted edges, seeds, votes, candidate kernels, and evidence for groups.

Ties, where the order of equals would otherwise be chance, go to the smaller id or the lexicographically smaller set.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.session import broadcast_if_few, in_order, materialize


def adjacency_rank(directed: DataFrame) -> DataFrame:
    """``(src, dst, weight, rnk)``: each contig's neighbours, from 1, heaviest first."""
    return directed.withColumn("rnk", F.row_number().over(Window.partitionBy("src").orderBy(F.desc("weight"), "dst")))


def trust_positions(ranked: DataFrame, contigs: DataFrame | None = None, steepest: bool = False) -> DataFrame:
    """``(contig_id, trust_pos)``: the rank after which the weight falls least, or, ``steepest``, most.

    Contigs of at most two neighbours have 1; so have those of ``contigs`` (id) that have none.
    """
    step = F.col("weight") - F.lag("weight").over(Window.partitionBy("src").orderBy("rnk"))
    steps = ranked.select("src", "rnk", (-step if steepest else step).alias("d"))
    best = steps.groupBy("src").agg(F.count("*").alias("n"), F.max(F.when(F.col("d").isNotNull(), F.struct("d", (-F.col("rnk")).alias("k")))).alias("best"))
    found = best.select(F.col("src").alias("contig_id"), F.when(F.col("n") > 2, -F.col("best.k") - 1).otherwise(1).cast("int").alias("trust_pos"))
    if contigs is None:
        return found
    return contigs.select(F.col("id").alias("contig_id")).join(found, "contig_id", "left").select("contig_id", F.coalesce("trust_pos", F.lit(1)).alias("trust_pos"))


def top_trust_edges(directed: DataFrame, n_contigs: int) -> DataFrame:
    """The heaviest directed edges, a quarter of ``n_contigs`` squared; where there are no more, they needn't be put in order."""
    most, directed = n_contigs * n_contigs // 4, directed.select("src", "dst", "weight")
    if directed.count() <= most:
        return directed
    ordered = in_order(directed, F.desc("weight"), F.col("src"), F.col("dst"))
    return ordered.where(F.col("place") < most).select("src", "dst", "weight")


def seed_contigs(trusted: DataFrame, n_contigs: int, heaviest_first: bool = False) -> DataFrame:
    """``(contig_id)``: ends of trusted edges, lightest edge first, until half of the contigs are met.

    The last edge may bring one more. Each end keeps the first edge that it appears on; only those, a row per
    contig, are put in order. Least weights come first, as a number is kept by hash; a least edge is found by sorting, which is
    left to the edges that have their contig's least weight. No such edge is beyond the greatest of these.
    """
    trusted = trusted.select("src", "dst", (-F.col("weight") if heaviest_first else F.col("weight")).alias("w"))
    ends_of = lambda df: df.select(F.explode(F.array("src", "dst")).alias("contig_id"), "w", F.col("src").alias("s"), F.col("dst").alias("d"))
    least = broadcast_if_few(ends_of(trusted).groupBy("contig_id").agg(F.min("w").alias("least")).withColumnRenamed("contig_id", "of"))
    some, all_, bound = least.agg(F.count("least"), F.count("*"), F.max("least")).first()
    met = ends_of(trusted.where(F.col("w") <= bound) if some == all_ > 0 else trusted)
    # No weight is less than the least; as a bound it isn't a key of the join, which would be slow.
    first = met.join(least, F.col("contig_id").eqNullSafe(F.col("of")) & ((F.col("w") <= F.col("least")) | F.col("least").isNull()))
    ends = materialize(first.groupBy("contig_id").agg(F.min(F.struct("w", "s", "d")).alias("key")), "ends")
    last = ends.orderBy("key").limit(n_contigs // 2).agg(F.max("key")).first()[0]
    if last is None:
        return ends.select("contig_id").limit(0)
    upto = F.struct(*(F.lit(v).cast(ends.schema["key"].dataType[k].dataType).alias(k) for k, v in last.asDict().items()))
    return ends.where(F.col("key") <= upto).select("contig_id")


def edge_votes(ranked: DataFrame, seeds: DataFrame, window: int) -> DataFrame:
    """``(start, end, supporters)``: seeds that vote for an edge, as a sorted array.

    A seed votes for its edges to seeds among its first ``window`` neighbours, and for each two of those.
    """
    near = ranked.where(F.col("rnk") <= window)
    hosts = near.join(seeds.select(F.col("contig_id").alias("src")), "src", "left_semi").join(seeds.select(F.col("contig_id").alias("dst")), "dst", "left_semi").select(F.col("src").alias("host"), "dst", "rnk")
    own = hosts.select("host", F.least("host", "dst").alias("start"), F.greatest("host", "dst").alias("end"))
    i, j = hosts.select("host", F.col("dst").alias("x"), F.col("rnk").alias("i")), hosts.select("host", F.col("dst").alias("y"), F.col("rnk").alias("j"))
    pairs = i.join(j, "host").where("i < j").select("host", F.least("x", "y").alias("start"), F.greatest("x", "y").alias("end"))
    return own.unionAll(pairs).groupBy("start", "end").agg(F.sort_array(F.collect_set("host")).alias("supporters"))


def contained(sets: DataFrame) -> DataFrame:
    """``(child, parent)`` for each two of the distinct ``sets`` (ids) of which the second contains the first, itself included.

    A set can only lie in sets that have its rarest member, so that member is the join's key.
    """
    members = sets.select("ids", F.explode("ids").alias("member"))
    counts = members.groupBy("member").agg(F.count("*").alias("df"))
    rarest = members.join(counts, "member").groupBy("ids").agg(F.min(F.struct("df", "member")).alias("r")).select(F.col("ids").alias("child"), F.col("r.member").alias("member"))
    inside = rarest.join(members.select(F.col("ids").alias("parent"), "member"), "member").where("size(parent) >= size(child) AND size(array_except(child, parent)) = 0")
    return inside.select("child", "parent")


def kernel_candidates(votes: DataFrame) -> DataFrame:
    """``(ids, subsets)``: supporter sets that no other contains, and how many further votes' sets each contains."""
    sets = materialize(votes.groupBy(F.col("supporters").alias("ids")).agg(F.count("*").alias("m")).where("size(ids) > 0"), "sets")
    inside = contained(sets)
    below = inside.where("child <> parent").select(F.col("child").alias("ids")).distinct()
    counted = inside.join(sets.select(F.col("ids").alias("child"), "m"), "child").groupBy(F.col("parent").alias("ids")).agg((F.sum("m") - 1).alias("subsets"))
    return counted.join(below, "ids", "left_anti")


def numbered_candidates(candidates: DataFrame) -> DataFrame:
    """``(set_id, ids)``: candidates from 0, most subsets first."""
    return in_order(candidates, F.desc("subsets"), F.col("ids")).select(F.col("place").cast("int").alias("set_id"), "ids")


def sharing_pairs(numbered: DataFrame) -> DataFrame:
    """``(set_a, set_b)`` for each two sets that share a contig which is neither's commonest: all that share two, and few others.

    Two sets that share two contigs share the rarer of these, and of neither set that is the commonest one. So a
    contig that very many sets have is the commonest of most of them, and joins none of those.
    """
    long = numbered.select("set_id", F.explode("ids").alias("member"))
    counts = long.groupBy("member").agg(F.count("*").alias("df"))
    most = long.join(counts, "member").groupBy("set_id").agg(F.max(F.struct("df", "member")).alias("most"))
    rarer = numbered.join(most, "set_id").select("set_id", F.explode(F.array_remove("ids", F.col("most.member"))).alias("member"))
    a, b = rarer.select(F.col("set_id").alias("set_a"), "member"), rarer.select(F.col("set_id").alias("set_b"), "member")
    return a.join(b, "member").where("set_a < set_b").select("set_a", "set_b").distinct()


def kernel_intersections(numbered: DataFrame) -> DataFrame:
    """``(set_a, set_b, ids)`` for each two candidates that share more than one contig."""
    numbered = materialize(numbered, "numbered")
    a, b = numbered.select(F.col("set_id").alias("set_a"), F.col("ids").alias("ids_a")), numbered.select(F.col("set_id").alias("set_b"), F.col("ids").alias("ids_b"))
    met = sharing_pairs(numbered).join(a, "set_a").join(b, "set_b")
    return met.select("set_a", "set_b", F.sort_array(F.array_intersect("ids_a", "ids_b")).alias("ids")).where("size(ids) > 1")


def group_relation(groups: DataFrame, directed: DataFrame, k: int) -> DataFrame:
    """``(group_a, group_b, relation)``, a < b: the sum of the ``k`` heaviest edges from the second to the first.

    ``groups``: (group_id, contig_id). Of a contig that is its own neighbour one edge counts.
    """
    edges = directed.groupBy("src", "dst").agg(F.max("weight").alias("weight"))
    a, b = groups.select(F.col("group_id").alias("group_a"), F.col("contig_id").alias("dst")), groups.select(F.col("group_id").alias("group_b"), F.col("contig_id").alias("src"))
    met = edges.join(a, "dst").join(b, "src").where("group_a < group_b")
    ranked = met.withColumn("k", F.row_number().over(Window.partitionBy("group_a", "group_b").orderBy(F.desc("weight"), "src", "dst")))
    return ranked.where(F.col("k") <= k).groupBy("group_a", "group_b").agg(F.sum("weight").alias("relation"))


def group_evidence(ranked: DataFrame, groups: DataFrame, k: int, counted: bool = False) -> DataFrame:
    """``(contig_id, group_id, mark)``: the sum of a contig's first ``k`` edges into each group it has edges into.

    ``groups``: (group_id, contig_id), each contig in one group; no row is no evidence. ``counted`` adds ``n``, the edges summed.
    """
    met = ranked.join(groups.select("group_id", F.col("contig_id").alias("dst")), "dst")
    nth = F.row_number().over(Window.partitionBy("src", "group_id").orderBy("rnk"))
    more = [F.count("*").alias("n")] if counted else []
    return met.withColumn("k", nth).where(F.col("k") <= k).groupBy(F.col("src").alias("contig_id"), "group_id").agg(F.sum("weight").alias("mark"), *more)


def least_group_size(groups: DataFrame) -> DataFrame:
    """``(edge_limit)``: the size of the smallest group."""
    return groups.groupBy("group_id").agg(F.count("*").alias("n")).agg(F.min("n").alias("edge_limit"))


def group_lengths(groups: DataFrame, contigs: DataFrame) -> DataFrame:
    """``(group_id, length)``: the summed lengths of a group's contigs (id, length)."""
    return groups.join(contigs.select(F.col("id").alias("contig_id"), "length"), "contig_id").groupBy("group_id").agg(F.sum("length").alias("length"))


def partition_balance(lengths: DataFrame) -> DataFrame:
    """``(mark)``: the population standard deviation of the groups' lengths."""
    return lengths.agg(F.stddev_pop(F.col("length").cast("double")).alias("mark"))


def unassigned(contigs: DataFrame, groups: DataFrame) -> DataFrame:
    """Contigs (id) in no group."""
    return contigs.join(groups.select(F.col("contig_id").alias("id")), "id", "left_anti")
