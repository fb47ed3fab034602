"""What the Python-side operators share: words of a text, tokenizers, and rows dealt out in small batches."""

from __future__ import annotations

import os
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of one text batch together hold about this many characters.
BATCH_CHARS = 1 << 20


def ascii_words(text: str | None) -> list[bytes]:
    """The words of a text, split at ASCII white space, with A-Z lower-cased, in UTF-8."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def vocabulary(name: str) -> str:
    """The place of a public tokenizer's file."""
    import public_tokenizers

    return public_tokenizers.path(name)


@cache
def hf_tokenizer(path: str):
    """A tokenizer without truncation or padding, one for each worker."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    made = Tokenizer.from_file(path)
    made.no_truncation()
    made.no_padding()
    return made


def key_and_text(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The two columns that an operator reads, under fixed names, so that others can't clash."""
    return df.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def text_batches(batches: Iterator[pa.RecordBatch], chars: int = BATCH_CHARS) -> Iterator[tuple[list, list[str | None]]]:
    """(ids, texts) of at most about ``chars`` characters each, or one longer text."""
    for batch in batches:
        ids, texts = batch.column(0).to_pylist(), batch.column(1)
        first, total = 0, 0
        held: list[str | None] = []
        for i in range(len(ids)):
            text = texts[i].as_py()
            held.append(text)
            total += len(text or "")
            if total >= chars:
                yield ids[first : i + 1], held
                first, total, held = i + 1, 0, []
        if held:
            yield ids[first:], held
