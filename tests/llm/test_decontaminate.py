import random
import re

import pytest
from pyspark.sql import functions as F

from tessera.llm import decontaminate as D


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]+", lambda m: m[0].lower(), text or ""))


def model(text, items, n=10):
    w = words(text)
    hit, found = set(), set()
    for item, t in items:
        v = words(t)
        size = min(n, len(v))
        windows = {tuple(v[i : i + size]) for i in range(len(v) - size + 1)} if v else set()
        for i in range(len(w) - size + 1):
            if tuple(w[i : i + size]) in windows:
                hit.update(range(i, i + size))
                found.add(str(item))
    return len(w), len(hit), sorted(found)


@pytest.fixture
def case(spark, texts, awkward):
    rng = random.Random(7)
    vocabulary = [f"w{i}" for i in range(40)] + ["Ünder", "naïve", "12", "the"]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.choice([3, 8, 10, 11, 30])))) for i in range(12)]
    items += [(50, None), (51, ""), (52, "?!"), (53, items[0][1]), (54, "solo")]
    docs = list(awkward)
    for i in range(40):
        text = " ".join(rng.choices(vocabulary, k=60))
        if i % 2:
            text += "; " + rng.choice(items[:12])[1].upper().replace(" ", " -- ") + "! " + " ".join(rng.choices(vocabulary, k=20))
        docs.append((100 + i, text))
    docs.append((200, "a solo. solo"))
    bench = spark.createDataFrame(items, "item_id long, text string").withColumns({"window": F.lit("x"), "items": F.lit(1), "length": F.lit(3)})
    return docs, items, texts(docs), bench


@pytest.mark.parametrize("limit", [10**6, 0])
def test_against_brute_force(case, monkeypatch, limit):
    monkeypatch.setattr(D, "MAX_WINDOWS", limit)
    docs, items, table, bench = case
    got = sorted((str(r.doc_id), r.n_words, r.n_hit, r.item_ids) for r in D.contamination(table, bench).collect())
    assert got == sorted((str(k), *model(t, items)) for k, t in docs)


def test_spans_are_cut_and_clean_documents_stay(case):
    docs, items, table, bench = case
    left = D.decontaminate(table, bench)
    assert left.columns == table.columns
    rows = left.collect()
    texts_ = {r.doc_id: r.text for r in rows}
    for key, text in docs:
        n, hit, _ = model(text, items)
        if not hit:
            assert key not in texts_ or texts_[key] == text
        elif key in texts_:
            assert len(words(texts_[key])) == n - hit
        else:
            assert n == hit
    kept = D.decontaminate(table, bench, action="documents").collect()
    assert sorted(str(r.doc_id) for r in kept) == sorted(str(k) for k, t in docs if not model(t, items)[1])


def test_empty_tables(case):
    docs, _, table, bench = case
    assert D.contamination(table.limit(0), bench).count() == 0
    none = D.contamination(table, bench.limit(0)).collect()
    assert len(none) == len(docs) and all(r.n_hit == 0 and r.item_ids == [] for r in none)
    assert D.decontaminate(table, bench.limit(0)).count() == len(docs)


def test_tables_grow_with_the_windows(case, monkeypatch):
    docs, items, table, bench = case
    monkeypatch.setattr(D, "TABLE", 1)
    for most in (1, 1 << 16):
        monkeypatch.setattr(D, "MAX_TABLE", most)
        index = D._Index(bench, 10, "item_id", "text")
        assert index.size == min(most, 16)
        got = sorted((str(r.doc_id), r.n_words, r.n_hit, r.item_ids) for r in D.contamination(table, bench).collect())
        assert got == sorted((str(k), *model(t, items)) for k, t in docs)


def test_a_long_text_that_is_all_benchmark(texts):
    rng = random.Random(3)
    long = " ".join(f"w{rng.randint(0, 10**6)}" for _ in range(20_000))
    docs = texts([(1, long), (2, "clean text of a few words"), (3, "Before. " + long + " After.")])
    bench = docs.sparkSession.createDataFrame([(1, long)], "item_id long, text string")
    assert sorted((r.doc_id, r.text) for r in D.decontaminate(docs, bench).collect()) == [(2, "clean text of a few words"), (3, "Before. After.")]
