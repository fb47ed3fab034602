"""Partition of the contact graph into K groups: kernels by votes, merging, greedy assignment, sweep of windows.

All of it is in DataFrames. Merging and assignment are greedy by definition, one step after another: here a step is a job over the
edges, and an assignment makes many moves in one where none can change another. For a graph of few edges the same steps are made at once.
"""

from __future__ import annotations

import bisect
import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations, count

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators import graph as G
from tessera.operators.components import connected_components, fewer_links
from tessera.operators.edges import directed
from tessera.session import Scratch, broadcast_if_few, in_order, materialize

#: Directed edges and contigs of a graph whose steps are made at once, and moves that a round looks at.
FEW, AHEAD = 1_000_000, 64
#: Edges between remaining contigs that a task may go through, and edges from them where the limit counts.
HELD, ALONE = 4_000_000, 16_000_000


@dataclass
class Neighbours:
    """Each contig's neighbours, heaviest first, and their weights."""

    order: dict[int, list[tuple[int, float]]]

    def weight(self, a: int, b: int) -> float | None:
        return self._maps.get(a, {}).get(b)

    def __post_init__(self) -> None:
        self._maps = {a: dict(reversed(n)) for a, n in self.order.items()}


def absorbed(intersections: DataFrame) -> DataFrame:
    """``(mark, ids, set_ids)``: intersections (set_a, set_b, ids), largest first, each joined to the first that contains it.

    Marks are numbered in that order; ``set_ids`` are the candidates of all that a mark has taken in. An intersection is a mark if
    none before it contains it, so marks are the sets that lie in no other, and the first mark that contains another one
    is a minimum: no step of this depends on the one before.
    """
    intersections = materialize(intersections, "intersections")
    sets = materialize(intersections.select("ids").distinct(), "intersected")
    inside = materialize(G.contained(sets), "contained")
    below = inside.where("child <> parent").select(F.col("child").alias("ids")).distinct()
    whole = materialize(sets.join(below, "ids", "left_anti"), "whole")
    marks = in_order(whole, F.desc(F.size("ids")), F.col("ids")).select(F.col("place").alias("mark"), "ids")
    homes = inside.join(marks.withColumnRenamed("ids", "parent"), "parent").groupBy(F.col("child").alias("ids")).agg(F.min("mark").alias("mark"))
    taken = intersections.join(homes, "ids").select("mark", F.explode(F.array("set_a", "set_b")).alias("set_id"))
    return marks.join(taken.groupBy("mark").agg(F.sort_array(F.collect_set("set_id")).alias("set_ids")), "mark").select("mark", "ids", "set_ids")


def connected(marks: DataFrame) -> DataFrame:
    """``(group_id, contig_id)``: unions of the contigs of :func:`absorbed` marks that share a candidate, directly or through others.

    Groups are numbered by their least contig, then by their first mark. A contig may be in several.
    """
    marks = materialize(marks.select((-F.col("mark") - 1).alias("node"), "ids", "set_ids"), "marks")
    links = marks.select("node", F.explode(F.col("set_ids").cast("array<bigint>")).alias("set_id"))
    reached = connected_components(links, "node", "set_id")
    told = materialize(marks.join(reached, "node").select("node", "component", F.explode("ids").alias("contig_id")), "core")
    order = materialize(told.groupBy("component").agg(F.min("contig_id").alias("least"), F.max("node").alias("first")), "components")
    numbered = in_order(order, F.col("least"), F.desc("first")).select("component", F.col("place").cast("int").alias("group_id"))
    return told.join(numbered, "component").select("group_id", "contig_id").distinct()


def relation(left: set[int], right: set[int], near: Neighbours, limit: int) -> float:
    """The sum of the ``limit`` heaviest edges from ``right`` to ``left``."""
    found = (w for r in sorted(right) for w in [near.weight(r, x) for x in left] if w is not None)
    return math.fsum(heapq.nlargest(limit, found))


def merged(groups: list[set[int]], k: int, near: Neighbours) -> list[set[int]]:
    """Groups merged, the two of the best relation by the smaller one's size first, until ``k`` are left."""
    groups = [set(g) for g in groups]
    while len(groups) > k:
        limit = min(map(len, groups))
        best, pair = -1.0, (0, 1)
        for i in range(len(groups) - 1):
            for j in range(i + 1, len(groups)):
                score = relation(groups[i], groups[j], near, limit) / min(len(groups[i]), len(groups[j]))
                if score > best:
                    best, pair = score, (i, j)
        groups[pair[0]] |= groups.pop(pair[1])
    return groups


def evidence(contig: int, limit: int, near: Neighbours, groups: list[set[int]]) -> list[float]:
    """For each group the sum of the contig's first ``limit`` edges into it, -1 without any.

    A neighbour in several groups counts for the first that has room.
    """
    marks, used = [-1.0] * len(groups), [0] * len(groups)
    for other, weight in near.order.get(contig, ()):
        for i, group in enumerate(groups):
            if used[i] < limit and other in group:
                marks[i] = max(marks[i], 0.0) + weight
                used[i] += 1
                break
        if all(u == limit for u in used):
            break
    return marks


def assigned(groups: list[set[int]], contigs: list[int], near: Neighbours) -> list[set[int]]:
    """Groups with the remaining contigs, each round the one of most evidence, while there is any.

    Between two rounds evidence changes only for contigs with an edge to the one that moved, or when the smallest
    group grows; only those are looked at again. Where no contig is in two groups, sums are kept up to date instead.
    """
    groups = [set(g) for g in groups]
    if sum(map(len, groups)) == len(set().union(*groups)):
        return _assigned_apart(groups, contigs, near)
    rest = set(contigs).difference(*groups)
    to: dict[int, set[int]] = {}
    for a in rest:
        for b, _ in near.order.get(a, ()):
            to.setdefault(b, set()).add(a)
    marks: dict[int, tuple[float, int]] = {}
    stale, before = set(rest), -1
    while rest:
        limit = min(map(len, groups))
        if limit != before:
            stale, before = set(rest), limit
        for c in stale & rest:
            found = evidence(c, limit, near, groups)
            best = max(range(len(groups)), key=lambda i: (found[i], -i))
            marks[c] = (found[best], best)
        move = max(rest, key=lambda c: (marks[c][0], -c))
        mark, group = marks[move]
        if mark < 0:
            break
        groups[group].add(move)
        rest.discard(move)
        stale = to.get(move, set())
    return groups


def _assigned_apart(groups: list[set[int]], contigs: list[int], near: Neighbours) -> list[set[int]]:
    """:func:`assigned` for groups that share no contig: of each contig and group the edges by rank, and the sum of the first."""
    home = {c: i for i, g in enumerate(groups) for c in g}
    rest = sorted(set(contigs) - home.keys())
    limit = min(map(len, groups))
    inward: dict[int, list[tuple[int, int, float]]] = {}
    edges = {c: [[] for _ in groups] for c in rest}
    for c in rest:
        for rank, (other, weight) in enumerate(near.order.get(c, ())):
            inward.setdefault(other, []).append((c, rank, weight))
            if other in home:
                edges[c][home[other]].append((rank, weight))
    sums = {c: [sum(w for _, w in e[:limit]) for e in edges[c]] for c in rest}

    def mark(c: int) -> tuple[float, int]:
        return max(((sums[c][i] if edges[c][i] else -1.0), -i) for i in range(len(groups)))

    open_ = dict.fromkeys(rest)
    while open_:
        move = max(open_, key=lambda c: (mark(c)[0], -c))
        best, group = mark(move)
        if best < 0:
            break
        del open_[move]
        groups[-group].add(move)
        for c, rank, weight in inward.get(move, ()):
            if c in open_:
                own = edges[c][-group]
                at = bisect.bisect(own, (rank, weight))
                own.insert(at, (rank, weight))
                if at < limit:
                    sums[c][-group] += weight - (own[limit][1] if len(own) > limit else 0.0)
        grown = min(map(len, groups))
        if grown > limit:
            for c in open_:
                for i, own in enumerate(edges[c]):
                    sums[c][i] += sum(w for _, w in own[limit:grown])
            limit = grown
    return groups


def merge_groups(groups: DataFrame, both: DataFrame, k: int, *, few: int = FEW) -> DataFrame:
    """:func:`merged` for groups (group_id, contig_id) and directed edges, which are gone over once.

    Contigs that have the same groups are alike: how many edges of each weight lead from one such class to another is all that steps
    need. A step is an aggregate over these counts; ``few`` rows of them at most are stepped through in the driver, with the same results.
    Of a step in jobs the driver holds the two groups that become one, and their number. The groups are numbered from 0 again.
    """
    groups = materialize(groups.select(F.col("group_id").cast("int"), "contig_id").distinct(), "groups")
    classes = broadcast_if_few(groups.groupBy("contig_id").agg(F.sort_array(F.collect_set("group_id")).alias("of")))
    src, dst = classes.select(F.col("contig_id").alias("src"), F.col("of").alias("of_src")), classes.select(F.col("contig_id").alias("dst"), F.col("of").alias("of_dst"))
    held = both.join(src.select("src"), "src", "left_semi").join(dst.select("dst"), "dst", "left_semi")
    within = held.groupBy("src", "dst").agg(F.max("weight").alias("weight")).join(src, "src").join(dst, "dst")
    counts = materialize(within.groupBy("of_src", "of_dst", "weight").agg(F.count("*").alias("n")), "weights")
    # (row, group_b, group_a): a row of counts leads from each group of its first class to each of its second.
    led = counts.withColumn("row", F.monotonically_increasing_id()).select("row", "weight", "n", F.explode("of_src").alias("group_b"), "of_dst").select("row", "weight", "n", "group_b", F.explode("of_dst").alias("group_a"))
    led = materialize(led, "led")
    members = materialize(groups.groupBy("contig_id").agg(F.sort_array(F.collect_set("group_id")).alias("of")).groupBy("of").agg(F.count("*").alias("n")), "classes")
    if led.count() + members.count() <= few:
        homes = _merged_numbers(led.toPandas(), [(list(r["of"]), r["n"]) for r in members.collect()], k)
    else:
        homes = _merged_in_jobs(groups, led, k)
    return groups.join(_numbered_homes(groups, homes), "group_id").select(F.col("number").alias("group_id"), "contig_id").distinct()


def _numbered_homes(groups: DataFrame, homes: DataFrame | dict[int, int]) -> DataFrame:
    """``(group_id, number)``: each group's number after merging, from 0 in the order of the groups that they became."""
    spark = groups.sparkSession
    if isinstance(homes, dict):
        homes = spark.createDataFrame(list(homes.items()), "group_id int, home int")
    homes = materialize(homes, "homes")
    numbers = in_order(homes.select("home").distinct(), F.col("home")).select("home", F.col("place").cast("int").alias("number"))
    return homes.join(numbers, "home").select("group_id", "number")


def _best_relations(pair: np.ndarray, weight: np.ndarray, n: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs, in order, and the sums of their ``limit`` heaviest edges; rows are of falling weight."""
    order = np.argsort(pair, kind="stable")
    pair, weight, n = pair[order], weight[order], n[order]
    starts = np.flatnonzero(np.r_[True, pair[1:] != pair[:-1]])
    upto = np.cumsum(n)
    before = upto - n
    inside = before - np.repeat(before[starts], np.diff(np.r_[starts, len(pair)]))
    return pair[starts], np.add.reduceat(weight * np.clip(limit - inside, 0, n), starts)


def _merged_numbers(led: pd.DataFrame, classes: list[tuple[list[int], int]], k: int) -> dict[int, int]:
    """The group that each group became, by :func:`merged`, from counts (row, weight, n, group_b, group_a) and the classes' sizes."""
    home = {g: g for of, _ in classes for g in of}
    classes_of: dict[int, set[int]] = {}
    sizes = dict.fromkeys(home, 0)
    for i, (of, n) in enumerate(classes):
        for g in of:
            classes_of.setdefault(g, set()).add(i)
            sizes[g] += n
    led = led.sort_values("weight", ascending=False, kind="stable")
    row, weight, n, a, b = (led[c].to_numpy() for c in ("row", "weight", "n", "group_a", "group_b"))
    a, b = a.astype("int64"), b.astype("int64")
    scores: dict[tuple[int, int], float] = {}
    before, touched = -1, None
    while len(sizes) > k:
        limit = min(sizes.values())
        if limit != before:
            scores, touched, before = {}, None, limit
        look = a < b if touched is None else (a < b) & ((a == touched) | (b == touched))
        if look.any():
            pairs, sums = _best_relations(a[look] << 32 | b[look], weight[look], n[look], limit)
            scores |= {(p >> 32, p & 0xFFFFFFFF): s for p, s in zip(pairs.tolist(), sums.tolist(), strict=True)}
        found = max(((s / min(sizes[p[0]], sizes[p[1]]), -p[0], -p[1]) for p, s in scores.items() if s > 0), default=None)
        x, y = (-found[1], -found[2]) if found else sorted(sizes)[:2]
        joined = classes_of[x] & classes_of[y]
        sizes[x] += sizes.pop(y) - sum(classes[i][1] for i in joined)
        classes_of[x] |= classes_of.pop(y)
        home = {g: x if h == y else h for g, h in home.items()}
        scores = {p: s for p, s in scores.items() if x not in p and y not in p}
        a, b, touched = np.where(a == y, x, a), np.where(b == y, x, b), x
        # A row that led to or from both leads to or from the one once.
        mine = np.flatnonzero((a == x) | (b == x))
        again = pd.DataFrame({"row": row[mine], "a": a[mine], "b": b[mine]}).duplicated().to_numpy()
        if again.any():
            keep = np.ones(len(a), bool)
            keep[mine[again]] = False
            row, weight, n, a, b = (v[keep] for v in (row, weight, n, a, b))
    return home


def _merged_in_jobs(groups: DataFrame, led: DataFrame, k: int) -> DataFrame:
    """``(group_id, home)``: the group that each group became, each step a job over the counts."""
    homes = materialize(groups.select("group_id", F.col("group_id").alias("home")).distinct(), "homes")
    while True:
        sizes = materialize(groups.join(homes, "group_id").select(F.col("home").alias("group_id"), "contig_id").distinct().groupBy("group_id").agg(F.count("*").alias("n")), "sizes")
        left, limit, first = sizes.agg(F.count("*"), F.min("n"), F.min("group_id")).first()
        if left <= k:
            return homes
        a, b = sizes.select(F.col("group_id").alias("group_a"), F.col("n").alias("n_a")), sizes.select(F.col("group_id").alias("group_b"), F.col("n").alias("n_b"))
        by = Window.partitionBy("group_a", "group_b").orderBy(F.desc("weight"), "row").rowsBetween(Window.unboundedPreceding, -1)
        room = F.greatest(F.lit(0), F.least("n", F.lit(limit) - F.coalesce(F.sum("n").over(by), F.lit(0))))
        relation_ = led.where("group_a < group_b").withColumn("room", room).groupBy("group_a", "group_b").agg(F.sum(F.col("weight") * F.col("room")).alias("relation"))
        scored = relation_.join(a, "group_a").join(b, "group_b").withColumn("score", F.col("relation") / F.least("n_a", "n_b"))
        best = scored.where("score > 0").orderBy(F.desc("score"), "group_a", "group_b").select("group_a", "group_b").first()
        x, y = best or (first, sizes.where(F.col("group_id") > first).agg(F.min("group_id")).first()[0])
        to = lambda c: F.when(F.col(c) == y, F.lit(x)).otherwise(F.col(c)).cast("int").alias(c)
        homes = materialize(homes.select("group_id", to("home")), "homes")
        led = materialize(led.select("row", "weight", "n", to("group_b"), to("group_a")).distinct(), "led")


def marks_of(ranked: DataFrame, groups: DataFrame, limit: int, apart: bool) -> DataFrame:
    """``(contig_id, group_id, mark)``: each contig's best group and its evidence, as of :func:`evidence`; contigs without any are left out.

    While no contig is in two groups (``apart``) this is an aggregate; else a contig's neighbours are gone through in their order.
    """
    if apart:
        found = G.group_evidence(ranked, groups, limit)
    else:
        homes = groups.groupBy(F.col("contig_id").alias("dst")).agg(F.sort_array(F.collect_set("group_id")).alias("homes"))
        near = ranked.join(homes, "dst").groupBy("src").agg(F.sort_array(F.collect_list(F.struct("rnk", "weight", "homes"))).alias("near"))

        @F.udf("array<struct<group_id: int, mark: double>>", useArrow=True)
        def evidence_of(near: list) -> list:
            marks: dict[int, float] = {}
            used: dict[int, int] = {}
            for _, weight, homes in near:
                home = next((g for g in homes if used.get(g, 0) < limit), None)
                if home is not None:
                    marks[home] = marks.get(home, 0.0) + weight
                    used[home] = used.get(home, 0) + 1
            return sorted(marks.items())

        found = near.select(F.col("src").alias("contig_id"), F.explode(evidence_of("near")).alias("x")).select("contig_id", "x.*")
    best = found.groupBy("contig_id").agg(F.max(F.struct("mark", (-F.col("group_id")).alias("g"))).alias("best"))
    return best.select("contig_id", (-F.col("best.g")).cast("int").alias("group_id"), F.col("best.mark").alias("mark"))


def assign_rest(groups: DataFrame, ranked: DataFrame, ahead: int = AHEAD, *, parts: DataFrame | None = None, few: int = FEW, held: int = HELD, alone: int = ALONE) -> DataFrame:
    """:func:`assigned` for groups (group_id, contig_id) and ranked edges (src, dst, weight, rnk).

    Evidence in the groups as they are is an aggregate. What moves change goes over edges between remaining contigs only, so
    their connected components don't concern one another as long as no contig has more edges into a group than the smallest group's
    size allows: a component is gone through in a task, where it has ``held`` edges at most. Where a contig has more (the limit counts, and
    joins all components), or a component is larger, moves are made in the order of all: in a task if no contig is in two groups and remaining
    contigs have ``alone`` edges at most, at once if they have ``few``, else in rounds. The results are the same.

    ``parts``, if given, are the components (node, component) of a graph that has the reverse of each edge, and no weight below 0. Then edges are looked
    at only in components with contigs of several groups: where all are of one, each contig of the component comes to have evidence for it, and for no other.
    """
    groups = groups.select(F.col("group_id").cast("int"), F.col("contig_id").cast("bigint"))
    with Scratch(groups.sparkSession) as scratch:
        groups = scratch.table(groups, "groups")
        if parts is None:
            return _assign_open(groups, ranked, scratch, ahead, few, held, alone)
        homes = scratch.table(groups.join(parts.withColumnRenamed("node", "contig_id"), "contig_id").groupBy("component").agg(F.min("group_id").alias("group_id"), F.max("group_id").alias("last")), "homes")
        alike = parts.join(homes.where("group_id = last"), "component").select("group_id", F.col("node").alias("contig_id"))
        alike = scratch.table(alike.join(groups.select("contig_id"), "contig_id", "left_anti").select("group_id", "contig_id"), "alike")
        several = homes.where("group_id <> last").select("component")
        if several.isEmpty():
            return materialize(groups.unionByName(alike), "assigned")
        told = _assign_open(groups, ranked.join(broadcast_if_few(parts.join(several, "component").select(F.col("node").alias("src"))), "src", "left_semi"), scratch, ahead, few, held, alone)
        return materialize(told.unionByName(alike), "assigned") if _limits_stand(groups, told, alike) else _assign_open(groups, ranked, scratch, ahead, few, held, alone)


def _limits_stand(groups: DataFrame, told: DataFrame, alike: DataFrame) -> bool:
    """Whether groups that grow by ``alike`` were never smaller than the smallest one of the others, which ended as in ``told``.

    Then what they took in meanwhile, which ``told`` leaves out, was no limit.
    """
    count_ = lambda df, name: df.groupBy("group_id").agg(F.count("*").alias(name))
    grown = alike.select("group_id", F.lit(True).alias("grown")).distinct()
    sizes = count_(groups, "before").join(count_(told, "after"), "group_id").join(grown, "group_id", "left")
    least, most = sizes.agg(F.min(F.when(F.col("grown"), F.col("before"))), F.min(F.when(F.col("grown").isNull(), F.col("after")))).first()
    return least is None or (most is not None and most <= least)


def _assign_open(groups: DataFrame, ranked: DataFrame, scratch: Scratch, ahead: int, few: int, held: int, alone: int) -> DataFrame:
    """:func:`assign_rest` by the edges of contigs in no group."""
    open_ = scratch.table(ranked.join(groups.select(F.col("contig_id").alias("src")), "src", "left_anti"), "open")
    sizes = {r["group_id"]: r["n"] for r in groups.groupBy("group_id").agg(F.count("*").alias("n")).collect()}
    edges, contigs, most = open_.groupBy("src").agg(F.count("*").alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*"), F.max("n")).first()
    fits = max(edges, contigs * len(sizes)) <= alone and not groups.groupBy("contig_id").count().where("count > 1").limit(1).count()
    # Where a contig has more edges than all groups' limits, components would most likely be gone through in vain.
    counts = bool(sizes) and (most or 0) > min(sizes.values()) * len(sizes)
    moved = None if fits and counts else _in_components(groups, open_, scratch, held)
    if moved is None and fits:
        moved = _alone(groups, open_, sizes)
    if moved is not None:
        return materialize(groups.unionByName(moved), "assigned")
    if open_.count() + groups.count() <= few:
        near = Neighbours(_by_source(open_.orderBy("src", "rnk").collect()))
        sets: dict[int, set[int]] = {}
        for g, c in groups.collect():
            sets.setdefault(g, set()).add(c)
        numbers = sorted(sets)
        found = assigned([sets[g] for g in numbers], list(near.order), near)
        return groups.sparkSession.createDataFrame([(g, c) for g, members in zip(numbers, found, strict=True) for c in sorted(members)], groups.schema)
    return _in_rounds(groups, open_, scratch, ahead)


def _by_source(ranked: list) -> dict[int, list[tuple[int, float]]]:
    order: dict[int, list[tuple[int, float]]] = {}
    for r in ranked:
        order.setdefault(r.src, []).append((r.dst, r.weight))
    return order


def _in_components(groups: DataFrame, open_: DataFrame, scratch: Scratch, held: int) -> DataFrame | None:
    """(group_id, contig_id) of all moves; None where the limit counts or a component has more than ``held`` edges.

    A neighbour in several groups counts for the first, as that has room.
    """
    first = scratch.table(groups.groupBy("contig_id").agg(F.min("group_id").alias("group_id")), "first")
    limit = groups.groupBy("group_id").count().agg(F.min("count")).first()[0]
    if limit is None:
        return None
    sums = G.group_evidence(open_, first, limit + 1, counted=True).select("contig_id", F.lit(None).cast("bigint").alias("other"), "group_id", F.col("mark").alias("weight"), "n")
    sums = scratch.table(sums, "sums")
    if sums.where(F.col("n") > limit).limit(1).count():
        return None
    remaining = open_.select(F.col("src").alias("dst")).distinct()
    links = open_.where("src <> dst").join(remaining, "dst", "left_semi")
    links = scratch.table(links.groupBy(F.col("src").alias("contig_id"), F.col("dst").alias("other")).agg(F.sum("weight").alias("weight"), F.count("*").alias("n")), "links")
    parts = scratch.table(connected_components(links, "contig_id", "other").withColumnRenamed("node", "contig_id"), "components")
    largest = links.join(parts, "contig_id").groupBy("component").count().agg(F.max("count")).first()[0] or 0
    if largest > held:
        return None
    rows = sums.unionByName(links.withColumn("group_id", F.lit(None).cast("int"))).join(parts, "contig_id", "left")
    keyed = rows.select(F.coalesce("component", "contig_id").alias("component"), *sums.columns)
    moved = scratch.table(keyed.groupBy("component").applyInPandas(lambda rows: _component_moves(rows, limit), "group_id int, contig_id bigint"), "moves")
    if moved.where("group_id IS NULL").limit(1).count():
        return None
    return moved


def _component_moves(rows: pd.DataFrame, limit: int) -> pd.DataFrame:
    """:func:`assigned` for one component: (contig_id, null, group_id, evidence, edges) and (contig_id, other, null, weight, edges).

    One row without a group where a contig has more edges into a group than ``limit``.
    """
    told = rows[rows["other"].isna()]
    ids = np.unique(rows["contig_id"].to_numpy())
    numbers = np.unique(told["group_id"].to_numpy().astype("int64"))
    none = pd.DataFrame({"group_id": np.empty(0, "int32"), "contig_id": np.empty(0, "int64")})
    if not len(numbers):
        return none
    sums, edges = np.zeros((len(ids), len(numbers))), np.zeros((len(ids), len(numbers)), "int64")
    at = np.searchsorted(ids, told["contig_id"].to_numpy()), np.searchsorted(numbers, told["group_id"].to_numpy().astype("int64"))
    sums[at], edges[at] = told["weight"].to_numpy(), told["n"].to_numpy()
    links = rows[rows["other"].notna()]
    to = np.searchsorted(ids, links["other"].to_numpy().astype("int64"))
    order = np.argsort(to, kind="stable")
    of, weight, n = np.searchsorted(ids, links["contig_id"].to_numpy())[order], links["weight"].to_numpy()[order], links["n"].to_numpy()[order]
    starts = np.searchsorted(to[order], np.arange(len(ids) + 1))
    evidence_ = np.where(edges > 0, sums, -1.0)
    open_, best = np.ones(len(ids), bool), evidence_.max(axis=1)
    moves: list[tuple[int, int]] = []
    while best[move := int(best.argmax())] >= 0:
        group = int(evidence_[move].argmax())
        moves.append((int(numbers[group]), int(ids[move])))
        open_[move], best[move] = False, -np.inf
        inward = slice(starts[move], starts[move + 1])
        near = of[inward]
        live = open_[near]
        near = near[live]
        if len(near):
            sums[near, group] += weight[inward][live]
            edges[near, group] += n[inward][live]
            if (edges[near, group] > limit).any():
                return pd.DataFrame({"group_id": pd.array([None], "Int32"), "contig_id": np.zeros(1, "int64")})
            evidence_[near, group] = sums[near, group]
            best[near] = evidence_[near].max(axis=1)
    return pd.DataFrame(moves, columns=["group_id", "contig_id"]).astype({"group_id": "int32", "contig_id": "int64"}) if moves else none


def _alone(groups: DataFrame, open_: DataFrame, sizes: dict[int, int]) -> DataFrame:
    """(group_id, contig_id) of all moves, made in a task that holds the edges ``open_`` as arrays. No contig is in two groups."""
    homes = groups.select(F.col("contig_id").alias("dst"), "group_id")
    rows = open_.join(homes, "dst", "left").select(F.col("src").cast("bigint"), F.col("dst").cast("bigint"), F.col("weight").cast("double"), F.col("rnk").cast("int"), F.coalesce("group_id", F.lit(-1)).alias("group_id"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [[c.to_numpy() for c in b.columns] for b in batches if b.num_rows]
        moves = _moves_in_order(*map(np.concatenate, zip(*held, strict=True)), sizes) if held else []
        yield pa.RecordBatch.from_arrays([pa.array([g for g, _ in moves], pa.int32()), pa.array([c for _, c in moves], pa.int64())], names=["group_id", "contig_id"])

    return rows.repartition(1).mapInArrow(run, "group_id int, contig_id bigint")


def _moves_in_order(src: np.ndarray, dst: np.ndarray, weight: np.ndarray, rank: np.ndarray, group: np.ndarray, sizes: dict[int, int]) -> list[tuple[int, int]]:
    """:func:`assigned` for groups of these sizes that share no contig: (group, contig) of each move, from the remaining contigs' edges.

    Of each contig and group are held how many edges there are, the sum of the first ``limit`` and the last of these. An edge that a move brings
    pushes the last one out, and the one before it is looked for; where the limit grows, the next one is.
    """
    numbers = np.array(sorted(sizes))
    size, k = np.array([sizes[g] for g in numbers.tolist()]), len(numbers)
    ids, src = np.unique(src, return_inverse=True)
    order = np.lexsort((rank, src))
    src, dst, weight, group = src[order], dst[order], weight[order], group[order]
    start = np.searchsorted(src, np.arange(len(ids) + 1))
    label = np.where(group < 0, -1, np.searchsorted(numbers, group)).astype("int32")
    to = np.minimum(np.searchsorted(ids, dst), len(ids) - 1)
    inward = np.flatnonzero(ids[to] == dst)
    inward = inward[np.argsort(to[inward], kind="stable")]
    reach = np.searchsorted(to[inward], np.arange(len(ids) + 1))
    del order, group, dst, rank

    limit = int(size.min())
    n, sums, last = np.zeros(len(ids) * k, "int64"), np.zeros(len(ids) * k), np.full(len(ids) * k, -1, "int64")
    known = np.flatnonzero(label >= 0)
    key = src[known] * k + label[known]
    by = np.argsort(key, kind="stable")
    known, key = known[by], key[by]
    counted = np.arange(len(key)) - np.searchsorted(key, key) < limit
    n += np.bincount(key, minlength=len(n))
    sums += np.bincount(key[counted], weight[known[counted]], minlength=len(n))
    np.maximum.at(last, key[counted], known[counted])

    def best_of(of: np.ndarray | slice) -> np.ndarray:
        return np.where(n.reshape(-1, k)[of] > 0, sums.reshape(-1, k)[of], -1.0).max(axis=1)

    def seek(at: np.ndarray, wanted: np.ndarray, step: int) -> np.ndarray:
        """The nearest edges from ``at`` on that lead into the wanted groups."""
        left = np.flatnonzero(label[at] != wanted)
        while len(left):
            at[left] += step
            left = left[label[at[left]] != wanted[left]]
        return at

    open_, best = np.ones(len(ids), bool), best_of(slice(None))
    moves: list[tuple[int, int]] = []
    while best[move := int(best.argmax())] >= 0:
        own = slice(move * k, move * k + k)
        to_group = int(np.where(n[own] > 0, sums[own], -1.0).argmax())
        moves.append((int(numbers[to_group]), int(ids[move])))
        open_[move], best[move] = False, -np.inf
        size[to_group] += 1
        edges = inward[reach[move] : reach[move + 1]]
        edges = edges[open_[src[edges]]]
        while len(edges):
            # Edges of one contig come one after another.
            again = np.r_[False, src[edges[1:]] == src[edges[:-1]]]
            now, edges = edges[~again], edges[again]
            label[now] = to_group
            near = src[now]
            key = near * k + to_group
            n[key] += 1
            room = n[key] <= limit
            sums[key[room]] += weight[now[room]]
            last[key[room]] = np.maximum(last[key[room]], now[room])
            pushes = ~room & (now < last[key])
            if pushes.any():
                key, now = key[pushes], now[pushes]
                sums[key] += weight[now] - weight[last[key]]
                last[key] = seek(last[key] - 1, np.full(len(key), to_group), -1)
            best[near] = best_of(near)
        if size.min() > limit:
            limit += 1
            key = np.flatnonzero((n >= limit) & np.repeat(open_, k))
            if len(key):
                last[key] = seek(last[key] + 1, key % k, 1)
                sums[key] += weight[last[key]]
                near = np.unique(key // k)
                best[near] = best_of(near)
    return moves


def _in_rounds(groups: DataFrame, open_: DataFrame, scratch: Scratch, ahead: int) -> DataFrame:
    """:func:`assign_rest` in rounds, for the ranked edges ``open_`` of the contigs in no group.

    A round finds each remaining contig's best group and makes, of the first ``ahead`` moves in order, all those that no
    move before them can change: evidence only grows, so a contig that has edges to contigs that move can at most gain their
    weights. What that could bring before a later move, or the smallest group's growth, ends the round. One move is
    always made. The driver holds those moves and the groups' sizes.
    """
    spark, schema = groups.sparkSession, groups.schema
    homed = groups.groupBy("contig_id").count()
    apart = not homed.where("count > 1").limit(1).count()
    sizes = {r["group_id"]: r["n"] for r in groups.groupBy("group_id").agg(F.count("*").alias("n")).collect()}
    folder = scratch.folder("assigned")
    scratch.part(groups, folder, 0)
    for done in count(1):
        held = spark.read.schema(schema).parquet(folder).select("group_id", "contig_id")
        limit = min(sizes.values(), default=0)
        marks = scratch.table(marks_of(open_, held, limit, apart), "marks")
        moves = marks.orderBy(F.desc("mark"), "contig_id").limit(ahead).collect()
        if not moves:
            break
        if len(moves) > 1:
            moves = moves[: _settled(open_, marks, moves)]
        taken = []
        for m in moves:
            taken.append((m["group_id"], m["contig_id"]))
            sizes[m["group_id"]] += 1
            if min(sizes.values()) > limit:
                break
        gone = scratch.part(spark.createDataFrame(taken, schema), folder, done)
        open_ = scratch.table(open_.join(F.broadcast(gone.select(F.col("contig_id").alias("src"))), "src", "left_anti"), "open")
    return materialize(spark.read.schema(schema).parquet(folder).select("group_id", "contig_id"), "assigned")


def _settled(open_: DataFrame, marks: DataFrame, moves: list) -> int:
    """How many of the first moves in order surely come in that order, with these groups and marks."""
    spark = open_.sparkSession
    at = spark.createDataFrame([(m["contig_id"], i, m["mark"]) for i, m in enumerate(moves)], "dst bigint, i int, key double")
    order = F.array(*(F.struct(F.lit(m["mark"]).alias("mark"), F.lit(m["contig_id"]).alias("id")) for m in moves))
    gain = open_.join(F.broadcast(at), "dst").groupBy("src").agg(F.min("i").alias("i"), F.sum("weight").alias("gain"))
    most = gain.join(marks.select(F.col("contig_id").alias("src"), "mark"), "src", "left").select("src", "i", (F.coalesce("mark", F.lit(0.0)) + F.col("gain")).alias("most"))
    before = F.size(F.filter(order, lambda m: (m["mark"] > F.col("most")) | (m["mark"] == F.col("most")) & (m["id"] < F.col("src"))))
    return most.agg(F.min(F.greatest(F.col("i") + 1, before))).first()[0] or len(moves)


def core_groups(ranked: DataFrame, seeds: DataFrame, window: int, few: int = FEW) -> DataFrame | None:
    """Core groups (group_id, contig_id) of one window, before they are merged; None where no two kernels share two contigs.

    Sets of ``few`` members at most, which are shared by few, are gone through in the driver, with the same results.
    """
    # Two sets that share two contigs and of which neither contains the other have three contigs each.
    sets = materialize(G.edge_votes(ranked, seeds, window).where("size(supporters) > 2").select(F.col("supporters").alias("ids")).distinct(), "sets")
    members = sets.agg(F.coalesce(F.sum(F.size("ids")), F.lit(0))).first()[0]
    if not members:
        return None
    if members <= few and (found := _core_at_once([tuple(r["ids"]) for r in sets.collect()], few)) is not None:
        rows = [(g, c) for g, ids in enumerate(found) for c in sorted(ids)]
        return materialize(sets.sparkSession.createDataFrame(rows, "group_id int, contig_id bigint"), "core-groups") if rows else None
    below = G.contained(sets).where("child <> parent").select(F.col("child").alias("ids"))
    # Which number a candidate has is of no account for groups, so candidates aren't put in order.
    kernels = materialize(sets.join(below, "ids", "left_anti").select(F.monotonically_increasing_id().alias("set_id"), "ids"), "kernels")
    shared = materialize(G.kernel_intersections(kernels), "intersections")
    return None if shared.isEmpty() else materialize(connected(absorbed(shared)), "core-groups")


def _by_member(sets: list[tuple[int, ...]]) -> dict[int, list[int]]:
    """The places of the sets that have each member."""
    homes: dict[int, list[int]] = {}
    for i, ids in enumerate(sets):
        for c in ids:
            homes.setdefault(c, []).append(i)
    return homes


def _core_at_once(sets: list[tuple[int, ...]], few: int) -> list[set[int]] | None:
    """:func:`connected` groups of the :func:`absorbed` intersections of those of the distinct, sorted ``sets`` that no other contains.

    None where members are shared by so many sets that more than ``few`` pairs would be looked at.
    """

    def whole(sets: list[tuple[int, ...]]) -> list[tuple[int, ...]] | None:
        homes, held = _by_member(sets), [set(ids) for ids in sets]
        if sum(len(h) ** 2 for h in homes.values()) > few:
            return None
        return [ids for ids in sets if sum(held[i].issuperset(ids) for i in min((homes[c] for c in ids), key=len)) == 1]

    kernels = whole(sets)
    if kernels is None:
        return None
    shared: dict[tuple[int, int], list[int]] = {}
    for c, homes in sorted(_by_member(kernels).items()):
        for pair in combinations(homes, 2):
            shared.setdefault(pair, []).append(c)
    intersections = [(pair, tuple(ids)) for pair, ids in shared.items() if len(ids) > 1]
    marks = whole(list({ids for _, ids in intersections}))
    if marks is None:
        return None
    marks.sort(key=lambda ids: (-len(ids), ids))
    homes, held = _by_member(marks), [set(ids) for ids in marks]
    # Marks that share a candidate, directly or through others, have the same root: the least of them.
    root, first = list(range(len(marks))), {}

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = x = root[root[x]]
        return x

    for pair, ids in intersections:
        mark = next(i for i in min((homes[c] for c in ids), key=len) if held[i].issuperset(ids))
        for kernel in pair:
            a, b = find(mark), find(first.setdefault(kernel, mark))
            root[max(a, b)] = min(a, b)
    groups: dict[int, set[int]] = {}
    for i, ids in enumerate(held):
        groups.setdefault(find(i), set()).update(ids)
    return [ids for _, ids in sorted(groups.items(), key=lambda g: (min(g[1]), g[0]))]


def _in_steps(core: DataFrame, both: DataFrame, ranked: DataFrame, parts: DataFrame | None, k: int, few: int) -> DataFrame:
    return assign_rest(merge_groups(core, both, k, few=few), ranked, parts=parts, few=few)


def _at_once(core: DataFrame, ranked: list, ids: list[int], k: int) -> DataFrame:
    """:func:`_in_steps` for a graph of few edges, whose steps cost less than a job each: they are made one after another."""
    near = Neighbours(_by_source(ranked))
    sets: dict[int, set[int]] = {}
    for g, c in core.collect():
        sets.setdefault(g, set()).add(c)
    groups = assigned(merged([sets[g] for g in sorted(sets)], k, near), ids, near)
    return core.sparkSession.createDataFrame([(g, c) for g, held in enumerate(groups) for c in sorted(held)], "group_id int, contig_id bigint")


def partition(contigs: DataFrame, edges: DataFrame, k: int, *, heaviest_first: bool = False, steepest: bool = False, few: int = FEW) -> DataFrame:
    """``(group_id, contig_id)``: contigs (id, length) in ``k`` groups by their edges (start, end, weight).

    Windows from ``min(k, 3)`` to the greater of ``k`` and the largest trusted position are tried in turn; the most
    balanced result stays, and the first window that is no better ends the search. Windows without core groups are
    passed over. With k < 2 all contigs are one group. Contigs without evidence stay out.

    The driver holds a number for each group. A graph of ``few`` directed edges and contigs at most is merged and assigned at
    once; the results are the same.
    """
    kind = contigs.schema["id"].dataType
    if k < 2:
        return contigs.select(F.lit(0).alias("group_id"), F.col("id").alias("contig_id"))
    contigs = materialize(contigs.select(F.col("id").cast("bigint"), "length"), "contigs")
    n = contigs.count()
    ranked = materialize(G.adjacency_rank(directed(edges).select(F.col("src").cast("bigint"), F.col("dst").cast("bigint"), "weight")), "ranked")
    both = ranked.select("src", "dst", "weight")
    edges_, least, most = ranked.agg(F.count("*"), F.min("weight"), F.max("weight")).first()
    small = edges_ + n <= few
    near, ids = (ranked.orderBy("src", "rnk").collect(), [r.id for r in contigs.select("id").collect()]) if small else ([], [])
    seeds = materialize(G.seed_contigs(G.top_trust_edges(both, n), n, heaviest_first), "seeds")
    top = G.trust_positions(ranked, contigs, steepest).agg(F.max("trust_pos")).first()[0] or 1
    result, best, parts = None, math.inf, None
    voting = ranked.where(F.col("rnk") <= max(k, top))
    for end in ("src", "dst"):
        voting = voting.join(broadcast_if_few(seeds.select(F.col("contig_id").alias(end))), end, "left_semi")
    voting = materialize(voting.select("src", "dst", "weight", "rnk"), "voting")
    for window in range(min(k, 3), max(k, top) + 1):
        core = core_groups(voting, seeds, window, few)
        if core is None:
            continue
        if parts is None and not small and 0 <= least <= most < math.inf:
            parts = materialize(connected_components(fewer_links(both)), "parts")
        groups = _at_once(core, near, ids, k) if small else _in_steps(core, both, ranked, parts, k, few)
        mark = G.partition_balance(G.group_lengths(groups, contigs)).first()[0]
        if mark is None or mark >= best:
            break
        best, result = mark, groups
    if result is None:
        return contigs.select(F.lit(0).alias("group_id"), F.col("id").cast(kind).alias("contig_id")).limit(0)
    return result.select("group_id", F.col("contig_id").cast(kind).alias("contig_id"))
