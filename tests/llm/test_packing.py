import random
import time
import zlib

import numpy as np
import pytest

from tessera.llm import packing as P
from tessera.llm.text import hf_tokenizer, vocabulary


def test_differencing():
    found, largest = P.difference([8, 7, 6, 5, 4], 2)
    sums = [sum(s for s, w in zip([8, 7, 6, 5, 4], found) if w == k) for k in range(2)]
    assert max(sums) == largest and sum(sums) == 30 and abs(sums[0] - sums[1]) <= 2
    assert P.difference([], 3) == ([], 0)
    assert P.difference([5], 3) == ([found := 0], 5) or P.difference([5], 3)[1] == 5


@pytest.mark.parametrize("seed", range(6))
def test_windows_hold_all_within_capacity(seed):
    random.seed(seed)
    sizes = [random.randint(1, 256) for _ in range(random.randint(1, 400))]
    found, windows = P.windows_of(sizes)
    sums = [0] * windows
    for s, w in zip(sizes, found, strict=True):
        sums[w] += s
    assert max(sums) <= 1024
    assert windows <= 1 + sum(sizes) / 1024 * 1.06


def test_window_count_rises():
    assert P.windows_of([600, 600, 600], 1024)[1] == 3


def test_plain_texts_have_the_same_ids_from_either_library():
    fast = P.byte_encoder(vocabulary("byte_bpe_50k.json"), vocabulary("byte_bpe_50k.tiktoken"))
    slow = P.byte_encoder(vocabulary("byte_bpe_50k.json"), None)
    signs = [chr(c) for c in [9, 10, 13, *range(32, 127), *range(0xA1, 0x250), 0x2013, 0x2014, 0x2018, 0x2019, 0x201C, 0x201D, 0x2026, 0x20AC]]
    random.seed(1)
    some = [a + b + c for a in "a 1." for b in signs for c in "b \n9'"] + ["".join(random.choices(signs, k=200)) for _ in range(300)]
    some += ["".join(random.choices("a \n\t'sre1.\r", k=100)) for _ in range(300)] + ["a<|endoftext|>b", "\x85  　x", "😀"]
    assert fast(some) == slow(some)


@pytest.mark.parametrize("text", [" " * 2_000_000, "\n" * 2_000_000, "a" * 2_000_000, "x" + " \n" * 1_000_000 + "y", "ab " * 500_000, " " * 1_999 + "a" * 1_999, "." * 300_000])
def test_long_runs(text):
    fast = P.byte_encoder(vocabulary("byte_bpe_50k.json"), vocabulary("byte_bpe_50k.tiktoken"))
    began = time.process_time()
    assert fast([text]) == [hf_tokenizer(vocabulary("byte_bpe_50k.json")).encode(text, add_special_tokens=False).ids]
    assert time.process_time() - began < 30


def test_round_trip(spark, texts, awkward):
    docs = [r for r in awkward if r[0] is not None and r[0] != 4] + [(9, "hello there " * 400)]
    rows = P.pack(texts(docs)).collect()
    encoder = hf_tokenizer(vocabulary("byte_bpe_50k.json"))
    for key, text in docs:
        want = [*encoder.encode(text or "", add_special_tokens=False).ids, 0]
        own = sorted((r for r in rows if r.doc_id == key), key=lambda r: r.start)
        assert [i for r in own for i in r.ids] == want
        assert all(r.doc_tokens == len(want) and r.length == len(r.ids) for r in own)
        assert all(r.ids_crc32 == zlib.crc32(np.asarray(r.ids, "<u4").tobytes()) for r in own)
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for pieces in by.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 1024


def test_repeats_nulls_and_empty_tables(spark, texts, awkward):
    assert P.pack(texts(awkward)).where("doc_id = 4").count() == 2
    assert P.pack(texts(awkward)).where("doc_id IS NULL").count() == 1
    assert P.pack(texts([])).count() == 0
    assert "ids" not in P.pack(texts([]), with_ids=False).columns
