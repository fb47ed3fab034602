import random

import pytest

from tessera.operators import edges as E
from tessera.operators import pairing
from tessera.operators.components import connected_components

RECORD = "file string, rec_no long, ref_id int, pos int, next_ref_id int, next_pos int"
A, B, C = (0, 1), (0, 2), (1, 3)


def records(spark, moves, file="f"):
    return spark.createDataFrame([(file, i, *s, *d) for i, (s, d) in enumerate(moves)], RECORD)


@pytest.mark.parametrize(
    "moves, pairs",
    [
        ([(A, B), (A, B), (B, A), (B, A)], [(*B, *A)]),
        ([(A, A), (A, A)], [(*A, *A)]),
        ([(A, A)], []),
        ([(B, A), (C, A), (A, B), (A, C)], [(*A, *B), (*A, *C)]),
        ([(A, B), (A, C), (C, A), (B, A)], [(*B, *A)]),
    ],
)
def test_cases(spark, rows, moves, pairs):
    assert rows(pairing.mate_pairs(records(spark, moves))) == sorted(pairs)


def test_files_do_not_mix(spark):
    both = records(spark, [(A, B)], "f1").union(records(spark, [(B, A)], "f2"))
    assert pairing.mate_pairs(both).count() == 0


def test_against_the_fold(spark, rows):
    random.seed(5)
    moves = []
    for g in range(40):
        nodes = [(g, i) for i in range(random.choice([2, 2, 3, 4]))]
        moves += [(random.choice(nodes), random.choice(nodes)) for _ in range(random.randint(1, 8))]
    random.shuffle(moves)
    assert rows(pairing.mate_pairs(records(spark, moves))) == sorted((*s, *d) for s, d in pairing.fold(moves))


@pytest.mark.parametrize("tail", [0, 40])
def test_rounds_on_one_component(spark, rows, tail):
    # All positions hang together; one has a third of the records, repeats and self records are among them.
    random.seed(7)
    nodes = [(i % 5, i) for i in range(60)]
    moves = []
    for _ in range(900):
        s, d = random.choice(nodes), random.choice(nodes)
        kind = random.random()
        moves.append((nodes[0], d) if kind < 0.17 else (s, nodes[0]) if kind < 0.34 else (d, s) if kind < 0.6 and moves else (s, d))
        if kind > 0.9:
            moves.append(random.choice(moves)[::-1])
    df = records(spark, moves)
    assert rows(pairing.complex_pairs(df, tail)) == sorted((*s, *d) for s, d in pairing.fold(moves))
    assert rows(pairing.complex_pairs(df.union(records(spark, moves[::-1], "g")), tail)) == sorted((*s, *d) for x in (moves, moves[::-1]) for s, d in pairing.fold(x))


@pytest.mark.parametrize("held", [0, 30, 250_000])
def test_contigs_apart_and_joined(spark, rows, held):
    # Contigs 0 to 3 mate within themselves, 4 and 5 with one another and 6 with 5; 7 has a null. The same ids again in another file.
    random.seed(13)
    moves = []
    for _ in range(400):
        s = (random.randrange(8), random.randrange(6))
        other = random.choice([4, 5]) if s[0] in (4, 5) else 5 if s[0] == 6 else s[0]
        moves.append((s, (other, random.randrange(6))))
        if random.random() < 0.4:
            moves.append(moves[random.randrange(len(moves))][::-1])
    df = records(spark, moves).union(records(spark, moves[::-1], "g")).union(spark.createDataFrame([("f", 5_000, 7, None, 7, 1)], RECORD))
    want = sorted((*s, *d) for x in (moves, moves[::-1]) for s, d in pairing.fold(x))
    assert rows(pairing.mate_pairs(df, 0, held)) == want


def test_contigs_apart_need_no_rounds(spark, rows, monkeypatch):
    def called(*_):
        raise AssertionError("rounds")

    monkeypatch.setattr(pairing, "single_mate", called)
    monkeypatch.setattr(pairing, "complex_pairs", called)
    monkeypatch.setattr(pairing, "DEALT", 20)
    random.seed(14)
    moves = [((g, random.randrange(5)), (g, random.randrange(5))) for _ in range(60) for g in range(12)]
    assert rows(pairing.mate_pairs(records(spark, moves))) == sorted((*s, *d) for s, d in pairing.fold(moves))
    assert pairing.mate_pairs(records(spark, [])).count() == 0


def test_small_orders_by_rounds(spark, rows):
    # Every sequence of three records of three positions, each as a file of its own.
    from itertools import product

    kinds = list(product((A, B, C), (A, B, C)))
    files = {f"f{k}": [*x, x[1][::-1], x[0][::-1]] for k, x in enumerate(product(kinds, repeat=3))}
    df = spark.createDataFrame([(f, i, *s, *d) for f, moves in files.items() for i, (s, d) in enumerate(moves)], RECORD)
    assert rows(pairing.complex_pairs(df, 0)) == sorted((*s, *d) for moves in files.values() for s, d in pairing.fold(moves))


def test_a_chain_against_the_order(spark, rows):
    moves = [((0, i), (0, i + 1)) for i in range(12, 0, -1)] + [((0, i + 1), (0, i)) for i in range(1, 13)]
    assert rows(pairing.complex_pairs(records(spark, moves), 0)) == sorted((*s, *d) for s, d in pairing.fold(moves))


def test_edges(spark, rows):
    pairs = spark.createDataFrame([(0, 1)] * 2 + [(1, 0)] * 4 + [(2, 2)] * 6, "ref_id int, next_ref_id int")
    sites = spark.createDataFrame([(0, 2), (1, 4), (2, 3)], "contig_id int, n_sites long")
    weighed = E.edge_weights(E.edge_counts(pairs), sites)
    assert rows(weighed) == [(0, 1, 1.0), (2, 2, 1.0)]
    assert E.inter_contig(pairs).count() == 6
    assert rows(E.directed(weighed)) == [(0, 1, 1.0), (1, 0, 1.0), (2, 2, 1.0), (2, 2, 1.0)]


def test_components(spark, rows):
    edges = spark.createDataFrame([(i, i + 1) for i in range(50)] + [(100, 103), (103, 101), (200, 200), (None, 3)], "a int, b int")
    got = dict(rows(connected_components(edges)))
    assert {got[i] for i in range(51)} == {0}
    assert (got[100], got[101], got[103], got[200]) == (100, 100, 100, 200)
    assert connected_components(edges.limit(0)).count() == 0


def test_components_of_random_graphs(spark, rows):
    random.seed(2)
    edges = [(random.randint(0, 300), random.randint(0, 300)) for _ in range(220)]
    head = {}

    def root(x):
        while head.setdefault(x, x) != x:
            x = head[x]
        return x

    for a, b in edges:
        x, y = sorted((root(a), root(b)))
        head[y] = x
    assert dict(rows(connected_components(spark.createDataFrame(edges, "a int, b int")))) == {x: root(x) for x in head}
