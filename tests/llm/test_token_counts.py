import random

import pytest

from tessera.llm import token_counts as C
from tessera.llm.text import hf_tokenizer, vocabulary

ENCODER = hf_tokenizer(vocabulary("word_bpe_49k.json"))


def spans(text):
    made = ENCODER.encode(text, add_special_tokens=False)
    return [(s, e, i) for (s, e), i in zip(made.offsets, made.ids, strict=True)]


def whole(text):
    return ENCODER.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("chunk, overlap", [(300, 20), (1000, 100), (2000, 40)])
def test_chunks_give_the_whole_texts_ids(chunk, overlap):
    random.seed(chunk)
    words = ["the", "Étienne", "don't", "x" * 30, "3.14", "<|endoftext|>", "ab́c", "中文", "\n\n", "é ́x", "ΣΑΣ", "--", "we're"]
    cases = [" ".join(random.choices(words, k=800)) for _ in range(6)] + ["a" * 6000 + " b " * 900, "é " * 3000, "中" * 5000, " " * 4000 + "z"]
    for text in cases:
        assert C.resynchronised(text, spans, chunk, overlap)[0] == whole(text)


def test_overlaps_widen_where_nothing_agrees():
    text = "b " * 400 + "a" * 3000 + " c" * 400
    ids, encoded, widened = C.resynchronised(text, spans, 1000, 30)
    assert ids == whole(text) and widened > 0 and encoded > 2


@pytest.mark.parametrize("signs", ["的一是不了人我在有他这中大来上国个到说们", "각ᆨ가", "กขคงจชาิึ", "abcdefgh", "are's't'rea", "!?'s", "ÅK̊ß<|"])
def test_texts_without_spaces(signs):
    rng = random.Random(signs)
    text = "".join(rng.choices(signs, k=30_000))
    ids, encoded, _ = C.resynchronised(text, spans, 2_000, 100)
    assert ids == whole(text) and encoded < 90


def test_a_million_characters_without_spaces_cost_little_more_than_one_encoding():
    rng = random.Random(5)
    text = "".join(chr(rng.randrange(0x4E00, 0x9FA5)) for _ in range(1_000_000))
    read = 0

    def counted(part):
        nonlocal read
        read += len(part)
        return spans(part)

    ids, _, widened = C.resynchronised(text, counted)
    assert ids == whole(text) and widened == 0 and read < 1.1 * len(text)


def test_words_give_the_librarys_counts():
    rng = random.Random(9)
    signs = [*" \t\n\r\x0b\x0c\x1c\x1d\x1f\x85\xa0\u2003\u3000\u200d", *"aAzß'.,|<>1", "<|endoftext|>", "<|ENDOFTEXT|>", "<|startoftext|>", "é", "e\u0301", "\u0301", "\u0338", "İ", "I\u0307", "ΣΑΣ", "K", "ﬁ", "😀", "👨\u200d👩", "가", "\u1161", "中文", "don't", "we're"]
    texts_ = ["".join(rng.choices(signs, k=rng.randint(0, 60))) for _ in range(4_000)]
    small = C.WordCounts(ENCODER, kept=50)  # forgets again and again
    assert small.cuts and [small(t) for t in texts_] == [len(whole(t)) for t in texts_] and len(small.words) <= 50


def test_each_plain_character_is_cut_as_the_library_does():
    count = C.WordCounts(ENCODER)
    signs = [chr(c) for c in range(0x250) if not 0x80 <= c < 0xA0] + [chr(c) for c in (0x85, 0x1E9E, 0x2019, 0x2028, 0x212A, 0x0345, 0xFB01)]
    texts_ = [a + c + b for c in signs for a, b in [("", ""), ("a", "b"), ("'", "e"), ("A1", "."), ("!", "?"), (" ", "\u0301 x")]]
    assert [count(t) for t in texts_] == [len(whole(t)) for t in texts_]
    assert sum(map(bool, map(C._PLAIN, signs))) > 200


def test_other_settings_encode_whole_texts():
    other = hf_tokenizer(vocabulary("byte_bpe_50k.json"))
    count = C.WordCounts(other)
    assert not count.cuts and count("Some  words, é.") == len(other.encode("Some  words, é.", add_special_tokens=False).ids)


def test_counts_of_all_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    got = {r.doc_id: (r.n_bytes, r.n_tokens) for r in C.count_tokens(docs).collect()}
    rows = docs.select("doc_id", "text").collect()
    made = ENCODER.encode_batch_fast([r.text or "" for r in rows], add_special_tokens=False)
    assert got == {r.doc_id: (len((r.text or "").encode()), len(e)) for r, e in zip(rows, made, strict=True)}


def test_operator(spark, texts, awkward):
    rows = C.count_tokens(texts(awkward), chunk=2000, overlap=64).collect()
    assert len(rows) == len(awkward)
    want = sorted((str(k), len((t or "").encode()), len(whole(t or ""))) for k, t in awkward)
    assert sorted((str(r.doc_id), r.n_bytes, r.n_tokens) for r in rows) == want
    assert all(r.over_limit == (r.n_tokens > 2048) for r in rows)
    assert C.count_tokens(texts([])).count() == 0
