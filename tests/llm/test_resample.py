import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tessera.llm import resample as R


def runs(text, n=3):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    return len(w), [" ".join(w[i - k + 1 : i + 1]) for i in range(len(w)) for k in range(n, 0, -1) if i - k + 1 >= 0]


def brute(docs, target, min_words=20, percent=5, buckets=10_000, seed=42):
    of = {i: [zlib.crc32(f.encode()) % buckets for f in runs(t)[1]] for i, (_, t) in enumerate(docs)}
    s = Counter(b for held in of.values() for b in held)
    t = Counter(zlib.crc32(f.encode()) % buckets for x in target for f in runs(x)[1])
    ss, tt = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (ss + buckets) / ((s[b] + 1) * (tt + buckets)))) for b in range(buckets)]
    rows = []
    for i, (doc, text) in enumerate(docs):
        h = int(hashlib.sha256(f"{seed}:{'' if doc is None else doc}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in of[i])
        rows.append([doc, len(of[i]), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, runs(text)[0]])
    able = sorted((r for r in rows if r[5] >= min_words), key=lambda r: (-r[3], r[0] is None, r[0] or 0, -r[1]))
    for rank, r in enumerate(able[: len(able) * percent // 100], 1):
        r[4] = rank
    return [tuple(r[:5]) for r in rows]


def test_states_are_those_of_whole_runs(monkeypatch):
    rng = random.Random(3)
    monkeypatch.setattr(R, "SLICE", 40)
    for n in (1, 2, 3, 5):
        for _ in range(200):
            text = "".join(rng.choice(["Ab", "x9", " ", "-", "é", "中", "\x00", "\n", "{", "Z", "'"]) for _ in range(rng.randrange(80)))
            count, found = R.states(R.words(text), n)
            want = runs(text, n)
            assert (count, list(found)) == (want[0], [zlib.crc32(f.encode()) for f in want[1]])


@pytest.fixture
def made(spark):
    rng = random.Random(1)
    words = [f"w{i}" for i in range(60)] + ["Über", "中文", "a1"]
    docs = [(i, " ".join(rng.choice(words[: rng.choice([5, 63])]) for _ in range(rng.choice([0, 19, 20, 21, 60])))) for i in range(400)]
    target = [" ".join(rng.choice(words[:8]) for _ in range(50)) for _ in range(5)]
    return docs, target


def test_resample_is_brute_force(spark, rows, made):
    docs, target = made
    docs = docs + [(7, docs[7][1]), (7, docs[8][1]), (None, docs[9][1]), (None, None), (500, ""), (501, "word " * 30_000)]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumns({c: F.lit("c") for c in ("held", "score", "rank", "n_words", "place", "weight")})
    aim = spark.createDataFrame([(t,) for t in [*target, None]], "text string").withColumn("doc_id", F.lit("x"))
    for percent in (5, 50, 100):
        got = R.resample(df, aim, percent=percent)
        assert got.dtypes == [("doc_id", "bigint"), ("n_features", "bigint"), ("weight", "bigint"), ("score", "bigint"), ("rank", "bigint")]
        key = lambda r: tuple((x is not None, x) for x in r)
        assert sorted(map(tuple, got.collect()), key=key) == sorted(brute(docs, target, percent=percent), key=key)


def test_few_buckets_and_long_runs(spark, rows, made):
    docs, target = made
    found = R.features(spark.createDataFrame(docs[:20], "doc_id long, text string"), n=2, buckets=100_000)
    assert {r["doc_id"]: r["n_features"] for r in found.collect()} == {i: len(runs(t, 2)[1]) for i, t in docs[:20]}


def test_ties_go_to_smaller_ids(spark):
    # Equal texts differ by noise alone; here the seed's noise is the same for rows of one id.
    df = spark.createDataFrame([(3, "a " * 30), (3, "a " * 30), (3, "a " * 30)], "doc_id long, text string")
    got = R.resample(df, df, percent=100)
    assert sorted(r["rank"] for r in got.collect()) == [1, 2, 3]


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert R.resample(none, none).count() == 0
    one = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    assert [tuple(r)[:3] for r in R.resample(one, none).collect()] == [(1, 3, brute([(1, "a b")], [])[0][2])]


def test_target_words_are_drawn_first(spark):
    docs = [(i, " ".join(f"{'good' if i % 10 == 0 else 'other'}{j % 7}" for j in range(40))) for i in range(200)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    aim = spark.createDataFrame([(" ".join(f"good{j % 7}" for j in range(40)),)], "text string")
    drawn = [r["doc_id"] for r in R.resample(df, aim, percent=10).where("rank IS NOT NULL").collect()]
    assert len(drawn) == 20 and all(i % 10 == 0 for i in drawn)
