import random

import pytest

from tessera.llm import sift
from tessera.llm import substring as S


def prose(rng, n):
    return " ".join("".join(rng.choices("abcdefghijklmnopqrstuvwxyzé", k=rng.randint(2, 9))) for _ in range(n))


def test_chunks_cover_and_keep_characters_whole():
    rng = random.Random(1)
    for made in [prose(rng, 400), "中" * 900, "a" * 900, "", "x", "é" * 255 + "a b", "😀" * 200]:
        data = made.encode()
        ends = S.chunk_ends(data)
        assert ends == sorted(set(ends)) and (ends[-1] if ends else 0) == len(data)
        last = 0
        for e in ends:
            assert e - last <= S.MOST
            data[last:e].decode()
            last = e


def gear(data):
    """The rolling hash, byte by byte."""
    h = 0
    for byte in data:
        h = (2 * h + int(S._GEAR[byte])) & 0xFFFFFFFF
    return h


def test_cuts_are_where_the_rolling_hash_says():
    data = prose(random.Random(2), 300).encode()
    last = 0
    for e in S.chunk_ends(data)[:-1]:
        if e - last < S.MOST:
            h = gear(data[:e])
            assert e - last >= S.LEAST and (h < S.OTHER_CUT or h < S.SPACE_CUT and data[e - 1 : e] == b" ")
        last = e


def test_chunks_resist_insertions():
    rng = random.Random(3)
    told = prose(rng, 1000)
    a, b = told.encode(), ("something new " + told[:2000] + " inserted " + told[2000:]).encode()
    first, second = set(S.digests(a, S.chunk_ends(a))), set(S.digests(b, S.chunk_ends(b)))
    assert len(first & second) > 0.9 * len(first)


@pytest.fixture
def case():
    rng = random.Random(4)
    passage, line = prose(rng, 55), prose(rng, 9)
    docs = [(i, f"{prose(rng, 80)} {passage} {prose(rng, 60)}") for i in range(10, 20)]
    docs += [(i, f"{prose(rng, 50)}\n{line}\n{prose(rng, 50)}") for i in range(30, 40)]
    docs += [(50, docs[-1][1]), (60, f"{passage}\n{passage}"), (61, (prose(rng, 30) + "\n") * 3)]
    return passage, docs


def test_passages_go_but_for_the_first(texts, case, awkward):
    passage, docs = case
    rows = {r.doc_id: r for r in S.repeat_report(texts(docs + awkward)).collect()}
    assert not rows[10].repeated and rows[10].text == dict(docs)[10]
    for key in range(11, 20):
        assert rows[key].repeated and abs(rows[key].n_removed - len(passage.encode())) <= 2
        assert len(rows[key].text) + rows[key].n_removed >= len(dict(docs)[key])
    for key in [*range(30, 40), 61, 1, 2, 3, 4, 5, 6, 7, 8, None]:
        assert not rows[key].repeated
    assert rows[50].repeated and rows[60].repeated
    assert rows[1].text is None and rows[2].text == ""


def test_pipeline_form(texts, case, awkward):
    _, docs = case
    table = texts(docs + awkward)
    left = S.dedup_substrings(table)
    assert left.columns == table.columns
    got = [r.doc_id for r in left.collect()]
    # 50 is a copy, and 60 the passage twice: nothing remains of either.
    assert sorted(map(str, got)) == sorted(str(k) for k, _ in docs + awkward if k not in (50, 60))
    assert S.dedup_substrings(texts([])).count() == 0


def test_equal_ids_with_other_texts_are_told_apart(texts):
    rng = random.Random(5)
    passage, own = prose(rng, 120), prose(rng, 120)
    rows = S.repeat_report(texts([(1, passage), (2, passage), (2, own)])).collect()
    assert sorted((r.doc_id, r.repeated) for r in rows) == [(1, False), (2, False), (2, True)]


def grown_of(first, second, again):
    """What the operator finds for the runs of ``again`` chunks of ``second`` whose first document is ``first``: each end against each context."""
    own = S.digests(second, S.chunk_ends(second))
    at = set(again)
    sides = [(k, True) for k in again if k - 1 not in at] + [(k, False) for k in again if k + 1 not in at]
    told = S.contexts_of(first, {(own[k], side) for k, side in sides})
    mine = S.own_bytes(second, sides)
    return [(k, side, max((S.shared(x, c, whole, all_) for g, s, c, all_ in told if g == own[k] and s == side), default=0)) for (k, side), (x, whole) in zip(sides, mine)]


@pytest.mark.parametrize("words, most_missed", [(20, 30), (30, 3), (40, 0), (50, 0), (60, 0), (75, 0)])
def test_planted_passages_are_cut_at_their_ends(words, most_missed):
    """All of 300; of the shortest a few have no whole chunk inside."""
    rng, missed = random.Random(words), 0
    for n in range(300):
        passage = prose(rng, words)
        gap = rng.choice([" ", "\n", "\n\n"])
        first, second = (f"{prose(rng, rng.randint(0, 60))}{gap}{passage} {prose(rng, 60)}".strip().encode() for _ in range(2))
        known = set(S.digests(first, S.chunk_ends(first)))
        again = [k for k, d in enumerate(S.digests(second, S.chunk_ends(second))) if d in known]
        spans = S.repeated_spans(second, again, S.MIN_WORDS, grown_of(first, second, again))
        start = second.index(passage.encode())
        if not spans:
            missed += 1
            continue
        assert len(spans) == 1, n
        assert second[slice(*spans[0])].strip() == passage.encode()
        assert abs(spans[0][0] - start) <= 2
    assert missed <= most_missed


def test_shorter_passages_stay():
    rng = random.Random(6)
    for _ in range(100):
        passage = prose(rng, 19)
        first, second = (f"{prose(rng, 60)} {passage} {prose(rng, 60)}".encode() for _ in range(2))
        known = set(S.digests(first, S.chunk_ends(first)))
        again = [k for k, d in enumerate(S.digests(second, S.chunk_ends(second))) if d in known]
        assert not S.repeated_spans(second, again, S.MIN_WORDS, grown_of(first, second, again))


def test_operator_against_brute_force(texts, monkeypatch):
    """Of each document, the words in windows of MIN_WORDS words that a document of a lesser id has."""
    monkeypatch.setattr(S, "HOT", 3)
    monkeypatch.setattr(sift, "SLOTS", 16)
    rng = random.Random(12)
    passages = [prose(rng, rng.randint(50, 90)) for _ in range(6)] + [prose(rng, 19)]
    docs = []
    for i in range(120):
        parts = [prose(rng, rng.randint(5, 60))]
        for _ in range(rng.randint(0, 2)):
            parts += [rng.choice(passages), prose(rng, rng.randint(5, 60))]
        docs.append((1000 - i, rng.choice([" ", "\n"]).join(parts)))
    seen, want = set(), {}
    for key, told in sorted(docs):
        w = told.split()
        windows = [tuple(w[i : i + S.MIN_WORDS]) for i in range(len(w) - S.MIN_WORDS + 1)]
        want[key] = len({i + k for i, x in enumerate(windows) if x in seen for k in range(S.MIN_WORDS)})
        seen.update(windows)
    rows = {r.doc_id: r for r in S.repeat_report(texts(docs)).collect()}
    assert sum(n > 0 for n in want.values()) > 40
    for key, told in docs:
        spans = rows[key].spans
        assert sum(len(told.encode()[s.start : s.stop].split()) for s in spans) == want[key], key
        assert len(rows[key].text.split()) == len(told.split()) - want[key]


def test_ends_in_order_share_what_they_share_with_all_contexts(spark):
    """Neighbours in order against every pair, over many ranges, with ends and contexts that tie."""
    rng = random.Random(13)
    rows = []
    for k in range(600):
        words = b"".join(rng.choice([b"ab", b"a", b" ", b"\n", b"!", b"b c "]) for _ in range(rng.randint(0, 9)))
        data, whole = S.outward(words + b" tail" * rng.choice([0, 90]), 0, False)
        own = rng.random() < 0.6
        rows.append((rng.choice([1, 2]), rng.choice([5, 6]), rng.random() < 0.5, data, own, whole, *((k, 7, k) if own else (None, None, None))))
    df = spark.createDataFrame(rows, S._PLACED.format(id="long"))
    with S.Scratch(spark) as scratch:
        got = {r["id_"]: r["n"] for r in S._grown(df, scratch).collect()}
    want = {r[6]: max((S.shared(r[3], c[3], r[5], c[5]) for c in rows if not c[4] and c[:3] == r[:3]), default=0) for r in rows if r[4]}
    assert got == want


@pytest.mark.parametrize("lines", [300, 2_000])
def test_a_line_that_is_there_very_often(texts, lines):
    """Two documents share one line of 30 words, each time before eight other words: ends and contexts add up, and don't multiply."""
    rng = random.Random(14)
    line = prose(rng, 30)
    docs = [(k, "\n".join(f"{line} " + " ".join(f"{rng.getrandbits(40):x}{k}" for _ in range(8)) for _ in range(lines))) for k in (1, 2)]
    rows = {r.doc_id: r for r in S.repeat_report(texts(docs)).collect()}
    assert not rows[1].repeated and rows[2].n_spans == lines
    assert len(rows[2].text.split()) == 8 * lines
