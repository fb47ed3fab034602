import math
import random
import re
from collections import Counter

from pyspark.sql import functions as F

from tessera.llm import rules as R


def base(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    seen = Counter(windows)
    covered = {i + k for i, x in enumerate(windows) if seen[x] > 1 for k in range(5)}
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered), len(w) < 10 or 100 * len(covered) > 20 * len(w))


def test_base_rules(texts, awkward):
    rng = random.Random(2)
    docs = list(awkward)
    for i in range(30):
        lines = [" ".join(rng.choices(["the", "of", "Cat", "#x", "ü$", "a|b", "7"], k=rng.randint(0, 9))) for _ in range(rng.randint(1, 8))]
        docs.append((100 + i, "\n".join(lines + rng.choices(lines, k=2))))
    docs.append((200, "a b c d e f " * 3 + "\r\nx\x0by"))
    rows = R.judge(texts(docs)).collect()
    got = sorted((str(r.doc_id), r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in rows)
    assert got == sorted((str(k), *base(t)) for k, t in docs)


def js(p, q):
    p, q = [x / sum(p) for x in p], [x / sum(q) for x in q]
    part = lambda x, m: x * math.log2(x / m) if x else 0.0
    return math.sqrt(max(0.0, sum((part(x, (x + y) / 2) + part(y, (x + y) / 2)) / 2 for x, y in zip(p, q, strict=True))))


def classes(text):
    space = len(re.findall(r"[\x20\x09-\x0D]", text))
    lower, upper, digit, symbol = (len(re.findall(c, text)) for c in ("[a-z]", "[A-Z]", "[0-9]", r"[#*$%&|<>]"))
    other = sum(ord(c) > 127 for c in text)
    return [lower, space, upper, digit, symbol, len(text) - lower - space - upper - digit - symbol - other, other]


def test_distances_by_hand(texts):
    docs = [(1, "The cat and the dog of 7 #é"), (2, "to be in the house."), (3, "OF AND")]
    whole = [sum(x) for x in zip(*(classes(t) for _, t in docs), strict=True)]
    common = lambda t: [t.split().count(w) for w in R.COMMON["en"]] + [sum(w not in R.COMMON["en"] for w in t.split())]
    pooled = [sum(x) for x in zip(*(common(t) for _, t in docs), strict=True)]
    for r in R.judge(texts(docs)).collect():
        text = dict(docs)[r.doc_id]
        assert abs(r.class_distance - js(classes(text), whole)) < 1e-9
        assert abs(r.word_distance - js(common(text), pooled)) < 1e-9


def test_verdicts(texts):
    rng = random.Random(3)
    known, rare = R.COMMON["en"], [a + b for a in ("mor", "tal", "ven", "sil") for b in ("ing", "ed", "er", "le", "ow")]
    prose = lambda n: " ".join(rng.choice(known if rng.random() < 0.4 else rare) + rng.choice(["", "", "", "."]) for _ in range(n))
    docs = [(i, prose(rng.randint(60, 400))) for i in range(200)]
    docs += [(300, " ".join(w + "###$$" for w in prose(300).split())), (301, prose(300).upper()), (302, " ".join(rng.choices(rare, k=400)))]
    kept = {r.doc_id: r.kept for r in R.judge(texts(docs)).collect()}
    assert all(kept[i] for i in range(200))
    assert not any(kept[i] for i in (300, 301, 302))


def test_languages_without_words_and_empty_tables(texts, awkward):
    docs = texts(awkward).withColumn("lang", F.when(F.col("doc_id") == 5, "xx"))
    assert all(r.word_distance is None for r in R.judge(docs).collect())
    assert R.judge(texts([])).count() == 0
