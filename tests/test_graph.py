import random

import pytest
from pyspark.sql import functions as F

from tessera import session
from tessera.operators import graph as G
from tessera.operators import partition as P
from tessera.operators.edges import directed


def star(spark, weights):
    return spark.createDataFrame([(0, i + 1, w) for i, w in enumerate(weights)], "src int, dst int, weight double")


@pytest.mark.parametrize("weights, flattest, steepest", [([9, 8.5, 3, 2], 1, 2), ([9, 3, 2.5, 1], 2, 1), ([5, 4], 1, 1)])
def test_trust_position(spark, rows, weights, flattest, steepest):
    ranked = G.adjacency_rank(star(spark, [float(w) for w in weights]))
    assert rows(G.trust_positions(ranked)) == [(0, flattest)]
    assert rows(G.trust_positions(ranked, steepest=True)) == [(0, steepest)]
    contigs = spark.createDataFrame([(0,), (7,)], "id int")
    assert rows(G.trust_positions(ranked, contigs)) == [(0, flattest), (7, 1)]


def test_candidates(spark, rows):
    votes = spark.createDataFrame([(0, 1, [1, 2, 3]), (0, 2, [1, 2]), (0, 3, [1, 2]), (0, 4, [4])], "start int, end int, supporters array<int>")
    assert sorted((tuple(i), s) for i, s in G.kernel_candidates(votes).collect()) == [((1, 2, 3), 2), ((4,), 0)]


def test_candidates_and_intersections_against_sets(spark):
    random.seed(4)
    sets = [tuple(sorted(random.sample(range(12), random.randint(1, 6)))) for _ in range(40)]
    votes = spark.createDataFrame([(i, i, list(s)) for i, s in enumerate(sets)], "start int, end int, supporters array<int>")
    want = {s: sum(set(x) <= set(s) for x in sets) - 1 for s in set(sets) if not any(set(s) < set(x) for x in sets)}
    kernels = G.kernel_candidates(votes).cache()
    assert {tuple(i): n for i, n in kernels.collect()} == want
    order = sorted(want, key=lambda s: (-want[s], s))
    shared = {(i, j): tuple(sorted(set(order[i]) & set(order[j]))) for j in range(len(order)) for i in range(j)}
    got = {(a, b): tuple(ids) for a, b, ids in G.kernel_intersections(G.numbered_candidates(kernels)).collect()}
    assert got == {k: v for k, v in shared.items() if len(v) > 1}


def test_a_contig_of_every_set_makes_no_pairs(spark):
    # 200 sets have contig 0, and twenty pairs of them one more in common.
    sets = [(i, [0, 1000 + i // 2 if i < 40 else 2000 + i, 3000 + i]) for i in range(200)]
    numbered = spark.createDataFrame(sets, "set_id int, ids array<int>")
    want = [(i, i + 1) for i in range(0, 40, 2)]
    assert sorted(map(tuple, G.sharing_pairs(numbered).collect())) == want
    assert sorted((a, b, tuple(ids)) for a, b, ids in G.kernel_intersections(numbered).collect()) == [(a, b, (0, 1000 + a // 2)) for a, b in want]


def test_seeds(spark, rows):
    random.seed(6)
    edges = list({(random.randint(0, 19), random.randint(0, 19)): float(random.randint(1, 5)) for _ in range(40)}.items())
    both = spark.createDataFrame([(a, b, w) for (a, b), w in edges], "src int, dst int, weight double")
    for n in (4, 10, 20, 60):
        seen = set()
        for _, a, b in sorted((w, a, b) for (a, b), w in edges):
            if len(seen) >= n // 2:
                break
            seen |= {a, b}
        assert {r[0] for r in rows(G.seed_contigs(both, n))} == seen


def test_seeds_sort_only_least_edges(spark, monkeypatch):
    # A least edge is found by sorting; what is sorted must have met the contigs' least weights first.
    plans = []
    written = G.materialize
    monkeypatch.setattr(G, "materialize", lambda df, tag: plans.append(df) or written(df, tag))
    both = spark.createDataFrame([(a, b, float(a * b % 7)) for a in range(9) for b in range(9) if a != b], "src int, dst int, weight double")
    plans.append(G.seed_contigs(both, 9))
    told = [df._jdf.queryExecution().executedPlan().toString() for df in plans]
    assert all("Join" in plan for plan in told if "SortAggregate" in plan)


def test_ranges_of_an_order_grow_with_the_rows(spark, monkeypatch):
    df = spark.range(2_000).select((F.col("id") * 7 % 2_000).alias("x"))
    few, written = session.parts_of, []
    monkeypatch.setattr(session, "parts_of", lambda df: few(df, 100))
    held = session.materialize
    monkeypatch.setattr(session, "materialize", lambda df, tag: written.append(df.rdd.getNumPartitions()) or held(df, tag))
    assert all(x == place for x, place in session.in_order(df, F.col("x")).select("x", "place").collect())
    assert written == [20]


def test_evidence_and_relation(spark, rows):
    random.seed(8)
    edges = [(a, b, float(random.randint(1, 9))) for a in range(8) for b in range(a + 1, 8) if random.random() < 0.7]
    both = directed(spark.createDataFrame(edges, "start int, end int, weight double"))
    ranked = G.adjacency_rank(both)
    order = {}
    for r in sorted(ranked.collect(), key=lambda r: (r.src, r.rnk)):
        order.setdefault(r.src, []).append((r.dst, r.weight))
    near = P.Neighbours(order)
    groups = [{0, 1, 2}, {3, 4}]
    table = spark.createDataFrame([(g, c) for g, ids in enumerate(groups) for c in ids], "group_id int, contig_id int")
    marks = {(c, g): m for c, g, m in rows(G.group_evidence(ranked, table, 2))}
    for c in range(8):
        assert [marks.get((c, g), -1.0) for g in range(2)] == P.evidence(c, 2, near, groups)
    assert rows(G.group_relation(table, both, 3)) == [(0, 1, P.relation(groups[0], groups[1], near, 3))]


def slow_assigned(groups, contigs, near):
    """As defined: each round looks at every contig."""
    groups = [set(g) for g in groups]
    rest = set(contigs).difference(*groups)
    while rest:
        limit = min(map(len, groups))
        best = (-1.0, None, None)
        for c in sorted(rest):
            found = P.evidence(c, limit, near, groups)
            g = max(range(len(groups)), key=lambda i: (found[i], -i))
            if found[g] > best[0]:
                best = (found[g], c, g)
        if best[1] is None:
            break
        groups[best[2]].add(best[1])
        rest.discard(best[1])
    return groups


def test_assignment_against_the_definition():
    random.seed(11)
    for _ in range(60):
        n = 14
        weight = {(a, b): float(random.randint(1, 4)) for a in range(n) for b in range(a) if random.random() < 0.3}
        order = {a: sorted(((b, w) for (x, y), w in weight.items() for b in [y if x == a else x] if a in (x, y)), key=lambda e: (-e[1], e[0])) for a in range(n)}
        near = P.Neighbours(order)
        groups = [set(random.sample(range(n), 2)), set(random.sample(range(n), 3))]
        assert P.assigned(groups, list(range(n)), near) == slow_assigned(groups, list(range(n)), near)


def absorbed_model(intersections):
    """As defined: largest first, each joins the first mark that contains it."""
    marks = []
    for a, b, ids in sorted(intersections, key=lambda x: (-len(x[2]), x[2], x[0], x[1])):
        home = next((m for m in marks if m[0].issuperset(ids)), None)
        if home is None:
            marks.append((set(ids), {a, b}))
        else:
            home[1].update((a, b))
    return marks


def connected_model(marks):
    """As defined: marks that share a candidate are united until none do."""
    left = [(set(ids), set(sets), k) for k, (ids, sets) in enumerate(marks)]
    groups = []
    while left:
        ids, sets, first = left.pop(0)
        while near := [m for m in left if m[1] & sets]:
            for m in near:
                ids |= m[0]
                sets |= m[1]
                left.remove(m)
        groups.append((min(ids), first, ids))
    return [g[2] for g in sorted(groups, key=lambda g: g[:2])]


def intersections_of(rng, n):
    found = {(a, b): tuple(sorted(rng.sample(range(15), rng.choice([2, 2, 3, 5])))) for a in range(n) for b in range(a + 1, n) if rng.random() < 2.5 / n}
    return [(a, b, ids) for (a, b), ids in found.items()]


def long_form(spark, groups):
    return spark.createDataFrame([(g, c) for g, ids in enumerate(groups) for c in ids], "group_id int, contig_id long")


def sets_of(df):
    groups = {}
    for g, c in df.select("group_id", "contig_id").collect():
        groups.setdefault(g, set()).add(c)
    return [groups[g] for g in sorted(groups)]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_absorption_and_components(spark, seed):
    found = intersections_of(random.Random(seed), 14)
    df = P.absorbed(spark.createDataFrame([(a, b, list(ids)) for a, b, ids in found], "set_a int, set_b int, ids array<int>"))
    want = absorbed_model(found)
    assert [(set(r["ids"]), set(r["set_ids"])) for r in df.orderBy("mark").collect()] == want
    assert sets_of(P.connected(df)) == connected_model(want)


def graph(spark, rng, n, share, weights=4):
    edges = [(a, b, float(rng.randint(1, weights))) for a in range(n) for b in range(a) if rng.random() < share]
    both = directed(spark.createDataFrame(edges, "start long, end long, weight double"))
    ranked = G.adjacency_rank(both).persist()
    order = {}
    for r in ranked.orderBy("src", "rnk").collect():
        order.setdefault(r.src, []).append((r.dst, r.weight))
    return both, ranked, P.Neighbours(order)


@pytest.mark.parametrize("seed, overlap", [(1, False), (2, True)])
def test_merging_in_steps(spark, seed, overlap):
    rng = random.Random(seed)
    both, _, near = graph(spark, rng, 16, 0.2)
    groups = [{2 * i, 2 * i + 1} | ({rng.randrange(16)} if overlap else set()) for i in range(6)]
    assert sets_of(P.merge_groups(long_form(spark, groups), both, 3)) == P.merged(groups, 3, near)


@pytest.mark.parametrize("few", [0, P.FEW])
def test_merging_goes_over_the_edges_once(spark, monkeypatch, few):
    rng = random.Random(7)
    both, _, near = graph(spark, rng, 20, 0.3)
    groups = [{3 * i, 3 * i + 1, 3 * i + 2, rng.randrange(20)} for i in range(6)]

    def called(*_):
        raise AssertionError("edges are gone over in each step")

    monkeypatch.setattr(P.G, "group_relation", called)
    assert sets_of(P.merge_groups(long_form(spark, groups), both, 3, few=few)) == P.merged(groups, 3, near)


def test_merging_without_edges(spark):
    both, _, near = graph(spark, random.Random(3), 16, 0.03)
    groups = [{2 * i, 2 * i + 1} for i in range(5)]
    assert sets_of(P.merge_groups(long_form(spark, groups), both, 2)) == P.merged(groups, 2, near)


@pytest.mark.parametrize("seed, groups, share, weights", [(4, [{0, 1}, {2, 3, 4}], 0.15, 3), (5, [{0, 1, 2}, {2, 3, 4}], 0.3, 2), (6, [{0}, {5}, {9}], 0.08, 50)])
def test_assignment_in_rounds(spark, seed, groups, share, weights):
    _, ranked, near = graph(spark, random.Random(seed), 22, share, weights)
    assert sets_of(P.assign_rest(long_form(spark, groups), ranked)) == slow_assigned(groups, list(range(22)), near)


@pytest.mark.parametrize("overlap", [False, True])
def test_components_are_assigned_apart(spark, monkeypatch, overlap):
    # Groups of 30 contigs: no limit counts, and three blocks of remaining contigs don't concern one another. No round is needed.
    rng = random.Random(12)
    groups = [set(range(30)), set(range(29 if overlap else 30, 60))]
    blocks = [range(60 + 10 * i, 70 + 10 * i) for i in range(3)]
    edges = [(c, o, float(rng.randint(1, 4))) for b in blocks for c in b for o in [*rng.sample(range(28, 60), 4), *(x for x in b if x < c and rng.random() < 0.6)]]
    ranked = G.adjacency_rank(directed(spark.createDataFrame(edges, "start long, end long, weight double")))
    near = P.Neighbours(P._by_source(ranked.orderBy("src", "rnk").collect()))

    def called(*_):
        raise AssertionError("moves one after another")

    monkeypatch.setattr(P, "marks_of", called)
    assert sets_of(P.assign_rest(long_form(spark, groups), ranked)) == slow_assigned(groups, list(range(90)), near)


@pytest.mark.parametrize("seed", range(12))
def test_moves_in_a_task_against_the_definition(seed):
    rng = random.Random(seed)
    n = 40
    weight = {(a, b): float(rng.randint(1, 5)) for a in range(n) for b in range(a) if rng.random() < rng.choice([0.2, 0.6])}
    edges = [e for (a, b), w in weight.items() for e in ((a, b, w), (b, a, w))]
    order = {a: sorted(((b, w) for x, b, w in edges if x == a), key=lambda e: (-e[1], e[0])) for a in range(n)}
    near = P.Neighbours(order)
    picked = rng.sample(range(n), 9)
    groups = [set(picked[:2]), set(picked[2:4]), set(picked[4 : 5 + seed % 5])]
    home = {c: 10 * g for g, ids in enumerate(groups) for c in ids}
    rows = [(a, b, w, i, home.get(b, -1)) for a, bs in order.items() if a not in home for i, (b, w) in enumerate(bs)]
    rng.shuffle(rows)
    columns = [P.np.array(c) for c in zip(*rows, strict=True)]
    for g, c in P._moves_in_order(*columns, {10 * g: len(ids) for g, ids in enumerate(groups)}):
        home[c] = g
    assert [{c for c, h in home.items() if h == 10 * g} for g in range(3)] == slow_assigned(groups, list(range(n)), near)


def test_a_limit_that_counts_needs_no_rounds(spark, monkeypatch):
    _, ranked, near = graph(spark, random.Random(15), 24, 0.6, 3)
    groups = [{0, 1}, {2, 3}]
    want = slow_assigned(groups, list(range(24)), near)
    assert sets_of(P.assign_rest(long_form(spark, groups), ranked, few=0, held=0, alone=0)) == want

    def called(*_):
        raise AssertionError("rounds")

    monkeypatch.setattr(P, "_in_rounds", called)
    assert sets_of(P.assign_rest(long_form(spark, groups), ranked, few=0)) == want


def test_rounds_are_what_components_are(spark):
    _, ranked, near = graph(spark, random.Random(5), 14, 0.3, 2)
    groups = [{0, 1, 2}, {3, 4, 5}]
    assert sets_of(P.assign_rest(long_form(spark, groups), ranked, few=0, held=0)) == slow_assigned(groups, list(range(14)), near)


def test_rounds_make_many_moves(spark, monkeypatch):
    # Two stars: no contig that moves has an edge to another, so all moves are one round's but for the growth of the smallest group.
    edges = [(c % 2, c, float(c)) for c in range(2, 42)]
    ranked = G.adjacency_rank(directed(spark.createDataFrame(edges, "start long, end long, weight double")))
    rounds = []
    settled = P._settled
    monkeypatch.setattr(P, "_settled", lambda *a: rounds.append(1) or settled(*a))
    got = sets_of(P.assign_rest(long_form(spark, [{0}, {1, 50, 51, 52}]), ranked))
    assert got == [{c for c in range(42) if c % 2 == 0}, {c for c in range(42) if c % 2} | {50, 51, 52}]
    assert len(rounds) < 25


def test_merging():
    near = P.Neighbours({0: [(2, 5.0)], 2: [(0, 5.0)], 4: [(0, 1.0)], 1: [], 3: []})
    assert P.merged([{0, 1}, {2, 3}, {4}], 2, near) == [{0, 1, 2, 3}, {4}]


@pytest.mark.parametrize("seed", range(8))
def test_core_groups_at_once(spark, seed):
    # Sets of three contigs or more hold all kernels that share two: groups are those of all kernels, numbered or not.
    rng = random.Random(seed)
    sets = [list(s) for s in {tuple(sorted(rng.sample(range(18), rng.choice([1, 2, 3, 3, 4, 5])))) for _ in range(16)}]
    votes = spark.createDataFrame([(i, i, s) for i, s in enumerate(sets)], "start long, end long, supporters array<long>")
    whole = [s for s in sets if not any(set(s) < set(x) for x in sets)]
    found = [(a, b, tuple(sorted(set(whole[a]) & set(whole[b])))) for a in range(len(whole)) for b in range(a + 1, len(whole))]
    want = connected_model(absorbed_model([x for x in found if len(x[2]) > 1]))
    assert P._core_at_once([tuple(s) for s in sets if len(s) > 2], P.FEW) == want
    assert P._core_at_once([tuple(s) for s in sets if len(s) > 2], 1) is None
    if seed < 3 and want:
        with pytest.MonkeyPatch.context() as m:
            m.setattr(P.G, "edge_votes", lambda *_: votes)
            assert [sets_of(P.core_groups(None, None, 3, few)) for few in (0, P.FEW)] == [want, want]


def copies(rng, n, times, share):
    """Edges of ``times`` graphs that nothing joins, alike but for their ids, each connected."""
    one = [(a, b, float(rng.randint(1, 4))) for a in range(n) for b in range(a) if b == a - 1 or rng.random() < share]
    return [(a + i * n, b + i * n, w) for i in range(times) for a, b, w in one]


@pytest.mark.parametrize(
    "groups, passes",
    [
        ([{0, 1, 2, 12, 13, 24, 36}, {48}, {60, 61}], 0),  # no component has two groups: no edge is looked at
        ([{0, 12, 24, 25, 36, 48, 49, 50, 51, 52, 53, 54, 55}, {61}, {63, 66}], 1),  # two of them in the last: only its edges are
        ([{0}, {1, 61}, {2, 62, 63}], 2),  # the smallest group grows where it is alone, too, and would be told wrong
        ([{0}, {12, 60}, {24, 61, 62}], 2),
    ],
)
def test_components_of_one_group_need_no_order(spark, monkeypatch, groups, passes):
    rng = random.Random(21)
    edges = copies(rng, 12, 6, 0.5)
    both = directed(spark.createDataFrame(edges, "start long, end long, weight double"))
    ranked = G.adjacency_rank(both).persist()
    near = P.Neighbours(P._by_source(ranked.orderBy("src", "rnk").collect()))
    parts = P.connected_components(P.fewer_links(both))
    assert {(r.node, r.component) for r in parts.collect()} == {(c, c // 12 * 12) for c in range(72)}
    looked, open_ = [], P._assign_open
    monkeypatch.setattr(P, "_assign_open", lambda groups, ranked, *a: looked.append(1) or open_(groups, ranked, *a))
    assert sets_of(P.assign_rest(long_form(spark, groups), ranked, parts=parts)) == slow_assigned(groups, list(range(72)), near)
    assert len(looked) <= passes


def test_fewer_links_have_the_same_components(spark):
    rng = random.Random(3)
    edges = [(a, b, 1.0) for a, b in ((rng.randrange(60), rng.randrange(60)) for _ in range(45))] + [(70, 70, 1.0)] + [(100 + i, 101 + i, 1.0) for i in range(9)]
    both = directed(spark.createDataFrame(edges, "start long, end long, weight double")).persist()
    want = sorted(map(tuple, P.connected_components(both, "src", "dst").collect()))
    assert sorted(map(tuple, P.connected_components(P.fewer_links(both)).collect())) == want


def test_edges_that_all_are_trusted_are_not_put_in_order(spark, rows, monkeypatch):
    both = spark.createDataFrame([(a, b, float(a * b)) for a in range(4) for b in range(4)], "src int, dst int, weight double")
    want = rows(both)
    monkeypatch.setattr(G, "in_order", lambda *_: pytest.fail("put in order"))
    assert rows(G.top_trust_edges(both, 8)) == want


def test_partition_of_copies_in_steps(spark):
    # Four graphs that nothing joins go to two groups: components, not edges, tell where contigs go.
    rng = random.Random(9)
    edges = [(a, b, float(rng.randint(1, 3) + 6 * (a // 9 == b // 9))) for a in range(18) for b in range(a) if a // 9 == b // 9 and rng.random() < 0.8 or rng.random() < 0.1]
    edges = [(a + 18 * i, b + 18 * i, w) for i in range(4) for a, b, w in edges]
    contigs = spark.createDataFrame([(i, 100 + i) for i in range(72)], "id int, length int")
    table = spark.createDataFrame(edges, "start int, end int, weight double")
    want = P.partition(contigs, table, 2, heaviest_first=True).collect()
    got = P.partition(contigs, table, 2, heaviest_first=True, few=0).collect()
    assert want and sorted(map(tuple, got)) == sorted(map(tuple, want))


def test_partition_in_steps_is_partition_at_once(spark):
    rng = random.Random(9)
    edges = [(a, b, float(rng.randint(1, 3) + 6 * (a // 9 == b // 9))) for a in range(18) for b in range(a) if a // 9 == b // 9 and rng.random() < 0.8 or rng.random() < 0.1]
    contigs = spark.createDataFrame([(i, 100 + i) for i in range(18)], "id int, length int")
    table = spark.createDataFrame(edges, "start int, end int, weight double")
    want = P.partition(contigs, table, 2, heaviest_first=True).collect()
    got = P.partition(contigs, table, 2, heaviest_first=True, few=0).collect()
    assert want and sorted(map(tuple, got)) == sorted(map(tuple, want))


def test_blocks_are_not_mixed(spark):
    random.seed(0)
    edges = [(a, b, 10.0 + random.random()) for a in range(24) for b in range(a + 2, 24, 2)]
    contigs = spark.createDataFrame([(i, 100) for i in range(24)], "id int, length int")
    table = spark.createDataFrame(edges, "start int, end int, weight double")
    groups = {}
    for g, c in P.partition(contigs, table, 2, heaviest_first=True).collect():
        groups.setdefault(g, set()).add(c)
    assert groups and all(len({c % 2 for c in ids}) == 1 for ids in groups.values())
    assert {tuple(r) for r in P.partition(contigs, table, 1).collect()} == {(0, i) for i in range(24)}
    assert P.partition(contigs, table.limit(0), 2).count() == 0
