import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.llm import negatives as N

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, positives=5, negatives=10, low=30, high=90):
    kept = []
    for i, v, label in rows:
        if i is None or v is None or label is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        kept.append((i, [math.floor(256 * float(np.float32(x))) for x in v], (label + 1) % 10 if i % 7 == 0 else label))
    out = []
    for i, v, label in kept:
        if i % 100:
            continue
        scored = sorted(((sum(x * y for x, y in zip(v, w)), j, m) for j, w, m in kept), key=lambda r: (-r[0], r[1]))
        for score, j, _ in [r for r in scored if r[2] == label and r[1] != i][:positives]:
            met = [r for r in scored if r[2] != label and low * score <= 100 * r[0] <= high * score][:negatives]
            out += [(i, j, k, r[1], score, r[0]) for k, r in enumerate(met, 1)]
    return sorted(out)


def table(n, seed, d=8, ids=None, labels=4):
    rng = random.Random(seed)
    return [(ids(k) if ids else k, [rng.choice([-1.0, 0.0, 0.25, 0.5, 1.0]) if seed % 2 else rng.gauss(0, 1) for _ in range(d)], rng.randrange(labels)) for k in range(n)]


def mined(spark, data, **options):
    df = spark.createDataFrame(data, SCHEMA).repartition(5).withColumns({c: F.lit("c") for c in ("anchor", "vector", "row_", "at", "rank", "score")})
    return sorted(map(tuple, N.mine_hard_negatives(df, label=N.relabelled(), **options).collect()))


@pytest.mark.parametrize("seed", [1, 2])
def test_equal_to_brute_force(spark, monkeypatch, seed):
    # Ids that are multiples of 20, so that many are anchors; coarse vectors tie often; blocks of few anchors.
    data = table(400, seed, ids=lambda k: 20 * k - 1000)
    assert mined(spark, data, anchor_bytes=64 * 20) == brute(data)
    monkeypatch.setattr(N, "PRODUCTS", 50)
    assert mined(spark, data) == brute(data)


def test_awkward_rows(spark):
    data = table(120, 3) + [(1000, None, 1), (1100, [0.5] * 8, None), (1200, [None] + [0.5] * 7, 1), (1300, [float("nan")] * 8, 1), (1400, [float("inf")] * 8, 1), (None, [1.0] * 8, 1), (1500, [1.0, 1.0], 1), (1600, [], 2)]
    assert mined(spark, data) == brute(data)


def test_repeated_rows_each_take_part(spark):
    data = table(60, 4)
    data += [data[0], data[0], data[5], data[5], (100, data[0][1], data[0][2])]
    assert mined(spark, data) == brute(data)


def test_a_common_vector_and_a_common_label(spark):
    data = [(20 * k, [1.0, 0.5], 0 if k % 5 else 3) for k in range(300)] + table(50, 5, 2, ids=lambda k: 7000 + k)
    assert mined(spark, data) == brute(data)


def test_empty(spark):
    assert mined(spark, []) == [] and mined(spark, [(1, [0.5], 1)]) == [] and mined(spark, [(0, [0.5], 1)]) == []


def test_products_beyond_float64():
    a = np.array([[2.0**40, 3.0], [-(2.0**40), 5.0]])
    b = np.array([[2.0**20 + 1, 7.0], [2.0**60, 0.0]])
    whole = [[int(a[i, 0]) * int(b[j, 0]) + int(a[i, 1]) * int(b[j, 1]) for j in (0, 1)] for i in (0, 1)]
    assert N.products(a, b).tolist() == [[whole[0][0], (1 << 63) - 1], [whole[1][0], -(1 << 63)]]


def test_best_lists_merge():
    rng = np.random.default_rng(8)
    of, score, ids = rng.integers(0, 6, 500), rng.integers(-3, 4, 500), rng.permutation(500)
    whole, parts = N.Best(6, 5), N.Best(6, 5)
    whole.add(of, score, ids)
    for s in range(0, 500, 37):
        some = slice(s, s + 37)
        near = parts.closer(of[some], score[some], ids[some])
        parts.add(of[some][near], score[some][near], ids[some][near])
    assert all((x == y).all() for x, y in ((whole.of, parts.of), (whole.score, parts.score), (whole.id, parts.id)))


def test_vectors_are_quantised_downwards():
    rows, m = N.quantised(pa.array([[0.001, -0.001], None, [1.0, None], [2.0]], pa.list_(pa.float32())))
    assert rows.tolist() == [0, 3] and m.tolist() == [[0.0, -1.0], [512.0, 0.0]]
