"""Token counts of whole texts; huge ones are encoded in overlapping chunks that are spliced where both sides agree."""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Callable, Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.text import hf_tokenizer, key_and_text, text_batches, vocabulary

#: Characters of a chunk, and those that two neighbours share at first.
CHUNK, OVERLAP = 16_384, 512
#: Tokens on either side of a splice that both encodings must have alike, and how much wider each further overlap is.
AGREE, WIDER = 8, 4
#: Letters that must precede a splice inside a word: more than a contraction ('re) has.
LETTERS = 4
#: Words whose counts a worker remembers, and the characters of the longest such word.
KEPT_WORDS, KEPT_CHARS = 1 << 18, 64
#: The settings of a tokenizers file whose texts can be cut into words here.
CONTRACTIONS = r"'s|'t|'re|'ve|'m|'ll|'d"
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
PRE_TOKENIZER = {
    "type": "Sequence",
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": CONTRACTIONS + r"|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}
#: White space of ASCII, and the letters beyond it, to U+017F, that have one lower-case letter each.
_SPACE, _LATIN = r" \t\n\r\x0b\x0c", "À-ÖØ-öø-įı-ſ"
_GAP = re.compile(f"[{_SPACE}]+")
_PLAIN = re.compile(f"[{_SPACE}!-~{_LATIN}]*").fullmatch
_WORD = re.compile(f"{CONTRACTIONS}|[a-z{_LATIN}]+|[0-9]|[^{_SPACE}a-z0-9{_LATIN}]+")

Token = tuple[int, int, int]


def _letter(c: str) -> bool:
    """A letter in every version of Unicode from 3.2 on that composes with nothing before it."""
    return unicodedata.ucd_3_2_0.category(c)[0] == "L" and not "\u1160" <= c <= "\u11ff"


def _safe(text: str, p: int) -> bool:
    """Whether what stands before ``p`` and what stands after it are normalised and cut into words alike, joined or apart."""
    if text[p - 1].isspace() != text[p].isspace():
        return not unicodedata.combining(text[p])
    return p >= LETTERS and all(map(_letter, text[p - LETTERS : p + 1]))


def _splice(text: str, low: int, high: int, left: list[Token], right: list[Token]) -> int | None:
    """A position in (low, high) at which both encodings can be joined, or None.

    ``left`` and ``right`` hold (start, stop, id) of the tokens of either encoding. A position is stable if
    a token ends and the next one starts there in both, with ``AGREE`` equal tokens on both sides, all inside
    the overlap, and it is where white space meets another character, or inside a run of letters.

    Why it is right. The pattern cuts words from left to right without looking ahead, so at white space either side
    is cut as if alone. Behind ``LETTERS`` letters it is inside a word of letters in both encodings and in that
    of the whole text, and the word ends alike in all of them. Within a word, byte pairs merge by
    rank, and by place among equals. Let a list of tokens have the property that each two neighbours, encoded alone,
    stay as they are. Then the first merge across a boundary would also take place in that pair alone, so there is none, and
    the list is the encoding of its text. An encoding has that property, and so has the left one up to the splice with the
    right one from there on, as the two tokens that meet are neighbours in the left one.
    """
    ours = [t for t in left if low <= t[0] and t[1] < high]
    theirs = [t for t in right if low <= t[0] and t[1] < high]
    at = {t: i for i, t in enumerate(theirs)}
    for i in range(len(ours) // 2, len(ours) - AGREE):
        j = at.get(ours[i])
        p = ours[i][0]
        if j is None or i < AGREE or j < AGREE or ours[i - 1][1] > p or ours[i - 1][0] == p or not _safe(text, p):
            continue
        if ours[i - AGREE : i + AGREE] == theirs[j - AGREE : j + AGREE]:
            return p
    return None


def resynchronised(text: str, encode: Callable[[str], list[Token]], chunk: int = CHUNK, overlap: int = OVERLAP) -> tuple[list[int], int, int]:
    """Ids of a whole text from overlapping chunks, with the chunks encoded and the times an overlap was widened.

    ``encode`` gives (start, stop, id) of each token. Where two chunks don't meet in a stable position the next
    one starts earlier, by ``WIDER`` times the overlap each time; when that reaches the start of the chunk before,
    both are encoded as one, of twice the size. A text without any stable position, as one letter a million times, is at
    last encoded whole.
    """
    ids: list[int] = []
    start, end = 0, min(chunk, len(text))
    left = encode(text[start:end])
    encoded, widened = 1, 0
    cut = 0  # what is before it is in ids
    while end < len(text):
        share = overlap
        while True:
            low = end - share
            if low <= max(start, cut):  # no room: one longer chunk from the last splice
                start, end = cut, min(len(text), end + max(chunk, end - cut))
                left = [(s + start, e + start, i) for s, e, i in encode(text[start:end])]
                encoded += 1
                break
            stop = min(len(text), low + chunk + share)
            right = [(s + low, e + low, i) for s, e, i in encode(text[low:stop])]
            encoded += 1
            p = _splice(text, low, end, left, right)
            if p is not None:
                ids += [i for s, _, i in left if cut <= s < p]
                cut, start, end, left = p, low, stop, right
                break
            share *= WIDER
            widened += 1
    ids += [i for s, _, i in left if s >= cut]
    return ids, encoded, widened


def _byte_signs() -> dict[int, str]:
    """The sign that stands for each byte in the vocabulary: itself where it is visible in Latin-1, else the next one from 256 on."""
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in visible]
    return {b: chr(b) for b in visible} | {b: chr(256 + k) for k, b in enumerate(hidden)}


class WordCounts:
    """Tokens of texts as the sum over their words, each distinct word merged once while it is remembered.

    The tokenizer normalises a text, cuts it into words by a pattern and merges each word by itself. ASCII white space is in no
    word, and no normalisation, special string or word reaches across it. Of characters that normalisation doesn't
    change but for their case (``_PLAIN``), the same pattern cuts the words here, and the tokenizer's own model
    merges those that aren't remembered. What stands between white space and has any other character, or could hold a special
    string, is encoded by the tokenizer as it is. Files of another normaliser or pattern (``cuts`` is False) encode whole texts.
    """

    def __init__(self, encoder, kept: int = KEPT_WORDS) -> None:
        self.encoder, self.kept = encoder, kept
        settings = json.loads(encoder.to_str())
        self.cuts = (settings["normalizer"], settings["pre_tokenizer"]) == (NORMALIZER, PRE_TOKENIZER) and settings["post_processor"] is None
        self.cuts &= all(t["special"] and not t["normalized"] and not t["lstrip"] and not t["rstrip"] and t["content"].startswith("<|") for t in settings["added_tokens"])
        self.words, self.odd = _Kept(self._merged, kept), _Kept(self._encoded, kept)
        self.signs = _byte_signs()

    def _merged(self, word: str) -> int:
        if not word.isascii():
            word = word.encode().decode("latin-1").translate(self.signs)
        return len(self.encoder.model.tokenize(word))

    def _encoded(self, word: str) -> int:
        return len(self.encoder.encode(word, add_special_tokens=False))

    def __call__(self, text: str) -> int:
        if not self.cuts:
            return self._encoded(text)
        odd = 0
        if not _PLAIN(text) or "<|" in text:
            parts = _GAP.split(text)
            plain = [bool(_PLAIN(x)) and "<|" not in x for x in parts]
            odd = sum(self.odd[x] for x, p in zip(parts, plain, strict=True) if not p)
            text = " ".join(x for x, p in zip(parts, plain, strict=True) if p)
        return odd + sum(map(self.words.__getitem__, _WORD.findall(text.lower())))


class _Kept(dict):
    """Counts of words, those met of late."""

    def __init__(self, count: Callable[[str], int], most: int) -> None:
        self.count, self.most = count, most

    def __missing__(self, word: str) -> int:
        n = self.count(word)
        if len(word) <= KEPT_CHARS:
            if len(self) >= self.most:
                self.clear()
            self[word] = n
        return n


@cache
def word_counts(path: str) -> WordCounts:
    """One for each worker, whose words outlive a task."""
    return WordCounts(hf_tokenizer(path))


def count_tokens(
    docs: DataFrame, tokenizer: str | None = None, *, id_col: str = "doc_id", text_col: str = "text", limit: int = 2048, chunk: int = CHUNK, overlap: int = OVERLAP
) -> DataFrame:
    """``(doc_id, n_bytes, n_tokens, over_limit, n_chunks, n_widened)`` for each row of ``docs``.

    ``tokenizer`` is the path of a tokenizers file (default: the public word BPE). Texts longer than
    ``chunk`` characters go through overlapping chunks; of others each distinct word is merged, once for many texts
    (:class:`WordCounts`). Either way the count is that of the whole text, without added tokens. A null or empty text
    has 0 bytes and 0 tokens; each repeated row is counted by itself; other columns are left out; an empty table gives
    an empty one. No shuffle: each task holds about a million characters, or one text, at a time, and the counts of
    ``KEPT_WORDS`` words.
    """
    path = tokenizer or vocabulary("word_bpe_49k.json")
    rows = key_and_text(docs, id_col, text_col)
    schema = T.StructType(
        [T.StructField("doc_id", rows.schema["doc_id"].dataType), T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("n_chunks", T.LongType()), T.StructField("n_widened", T.LongType())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = hf_tokenizer(path)
        lengths = word_counts(path)

        def spans(text: str) -> list[Token]:
            made = encoder.encode(text, add_special_tokens=False)
            return [(s, e, i) for (s, e), i in zip(made.offsets, made.ids, strict=True)]

        for batch in batches:
            for ids, texts in text_batches(iter([batch])):
                sizes = [len(t.encode()) if t else 0 for t in texts]
                counts = [(lengths(t) if t and len(t) <= chunk else 0, 1, 0) for t in texts]
                for i, t in enumerate(texts):
                    if t and len(t) > chunk:
                        got, encoded, widened = resynchronised(t, spans, chunk, overlap)
                        counts[i] = (len(got), encoded, widened)
                columns = [pa.array(ids, type=batch.schema.field(0).type), pa.array(sizes, pa.int64())]
                columns += [pa.array(list(c), pa.int64()) for c in zip(*counts, strict=True)]
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    counted = rows.mapInArrow(run, schema)
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"), "n_chunks", "n_widened")
