import random

import pytest

from tessera.llm import neardup as N
from tessera.llm.text import ascii_words


def model(docs, size, percent=80):
    """Brute force: every pair, whole sets of shingles."""
    sets = {}
    for key, text in docs:
        if key is None:
            continue
        w = ascii_words(text)
        sets[key] = {tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set()
    head = {k: k for k in sets}

    def root(x):
        while head[x] != x:
            x = head[x]
        return x

    keys = [k for k in sorted(sets) if sets[k]]
    for n, a in enumerate(keys):
        for b in keys[:n]:
            if 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                head[y] = x
    return {k: (len(sets[k]), root(k)) for k in sets}


def mutated(rng, words, rate):
    return [f"z{rng.randint(0, 10**9)}" if rng.random() < rate else w for w in words]


@pytest.mark.parametrize("size", [2, 5])
def test_against_brute_force(texts, awkward, size, monkeypatch):
    monkeypatch.setattr(N, "BLOCK", 6)  # so that the large groups go through blocks
    monkeypatch.setattr(N, "BLOCK_SHINGLES", 2_000)
    rng = random.Random(size)
    docs = [r for r in awkward if r[0] is not None]
    vocabulary = [f"v{i}" for i in range(3000)]
    key = 100
    for copies, top in ((1, 0), (1, 0), (3, 0.05), (60, 0.14), (40, 0.06)):
        base = rng.choices(vocabulary, k=rng.randint(60, 200))
        for _ in range(copies):
            docs.append((key, " ".join(mutated(rng, base, rng.random() * top))))
            key += 1
    docs += [(key, docs[-1][1]), (key + 1, docs[-1][1].upper())]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in N.near_duplicates(texts(docs), shingle=size).collect()}
    assert got == model(docs, size)


def test_rows_without_id_or_words(texts, awkward):
    rows = N.near_duplicates(texts(awkward), shingle=2).collect()
    assert len(rows) == len(awkward)
    empty = {r.doc_id: r for r in rows if r.n_shingles == 0}
    assert set(empty) == {1, 2, 3} and all(r.kept and r.component_id == r.doc_id for r in empty.values())
    assert [(r.kept, r.component_id) for r in rows if r.doc_id is None] == [(True, None)]
    assert [(r.kept, r.component_id) for r in rows if r.doc_id == 4] == [(True, 4)] * 2
    assert N.near_duplicates(texts([])).count() == 0


def test_one_of_each_keeps_all_columns(texts):
    docs = texts([(1, "a b c d e f g h"), (2, "a b c d e f g h"), (3, None), (4, "other words altogether here now"), (None, "a b c d e f g h")])
    kept = N.keep_one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id for r in kept.collect()), key=str) == [1, 3, 4, None]


def classes_of_rows(docs, size, percent=80):
    """Brute force over rows: the rows reachable from each row that has an id and words."""
    sets = []
    for key, text in docs:
        w = ascii_words(text)
        sets.append({tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w and key is not None else set())
    head = list(range(len(docs)))

    def root(x):
        while head[x] != x:
            x = head[x]
        return x

    for a in range(len(docs)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                head[root(a)] = root(b)
    found = {}
    for a in range(len(docs)):
        found.setdefault(root(a), []).append(a)
    return sets, list(found.values())


def test_ids_that_repeat_with_other_texts(texts):
    rng = random.Random(8)
    vocabulary = [f"v{i}" for i in range(500)]
    bases = [rng.choices(vocabulary, k=60) for _ in range(12)]
    docs = []
    for _ in range(160):
        base = rng.choice(bases)
        docs.append((rng.randint(1, 25), " ".join(mutated(rng, base, rng.choice([0, 0, 0.02, 0.04])))))
    docs += [docs[3], docs[3], (None, docs[5][1]), (7, None), (7, ""), (7, None), (2, docs[9][1].upper())]
    sets, groups = classes_of_rows(docs, 5)
    want = []
    for rows in groups:
        least = min((docs[a][0] for a in rows if docs[a][0] is not None), default=None)
        for a in rows:
            alone = not sets[a]
            component = docs[a][0] if alone else least
            n = len(ascii_words(docs[a][1])) and max(1, len({tuple(ascii_words(docs[a][1])[i : i + 5]) for i in range(max(1, len(ascii_words(docs[a][1])) - 4))}))
            want.append((docs[a][0], n, component, docs[a][0] is None or docs[a][0] == component))
    got = [tuple(r) for r in N.near_duplicates(texts(docs)).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, want))
    kept = [(r.doc_id, r.text) for r in N.keep_one_of_each(texts(docs)).collect()]
    assert len(kept) == len(groups)
    for rows in groups:
        least = min((docs[a][0] for a in rows if docs[a][0] is not None), default=None)
        assert sum((docs[a] in kept) and (not sets[a] or docs[a][0] == least) for a in rows) >= 1


def test_the_least_id_of_a_class_keeps_one_row(texts):
    a, b, c = (" ".join(f"{x}{i}" for i in range(40)) for x in "abc")
    near = a + " more"
    assert sorted((r.doc_id, r.text[0]) for r in N.keep_one_of_each(texts([(1, a), (5, a), (5, b), (5, b), (6, b), (2, near), (1, c)])).collect()) == [(1, "a"), (1, "c"), (5, "b")]


def test_posterior_bounds():
    assert N.least_matches(0.8, 1e-7, 20) < 0.8 * 20
    assert N.least_matches(0.8, 1e-7, 200) > 110
    assert N.least_matches(0.8, 0.4, 200) > N.least_matches(0.8, 1e-7, 200)


def test_other_kinds_of_ids(spark):
    docs = spark.createDataFrame([("b", "one two three four five six"), ("a", "one two three four five six"), ("c", "something else")], "doc_id string, text string")
    assert sorted((r.doc_id, r.component_id) for r in N.near_duplicates(docs, shingle=2).collect()) == [("a", "a"), ("b", "a"), ("c", "c")]
