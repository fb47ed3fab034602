"""Target-distribution importance resampling: hashed n-gram features, weighed by how the target's differ from the corpus's.

A feature is a run of words joined by one space, and its bucket the CRC-32 of its bytes modulo the number of buckets.
Documents are drawn without replacement by their weight with Gumbel noise.
"""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.text import key_and_text, text_batches
from tessera.session import in_order, materialize

#: Words of a feature at most, buckets, words that a document must have to be drawn, documents drawn of a hundred, and the noise's seed.
MAX_N, BUCKETS, MIN_WORDS, PERCENT, SEED = 3, 10_000, 20, 5, 42
#: Bytes of a text whose words are held at once.
SLICE = 1 << 20
#: Steps of a doubling of the score that are told apart when the least drawn one is looked for; there are 63 doublings on either side of 0.
STEPS = 64
_WORD_BYTES = bytes(b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))


def words(text: str | None) -> Iterator[list[bytes]]:
    """The words of a text, A-Z lower-cased, in UTF-8: digits, letters a to z and all beyond ASCII; a slice of the text at a time."""
    data = (text or "").encode("utf-8", "surrogatepass").translate(_WORD_BYTES)
    at = 0
    while at < len(data):
        end = len(data) if len(data) - at <= SLICE else data.find(b" ", at + SLICE)
        end = len(data) if end < 0 else end
        yield data[at:end].split()
        at = end


def states(slices: Iterator[list[bytes]], n: int = MAX_N) -> tuple[int, array]:
    """The number of words, and the CRC-32 of all runs of 1 to ``n`` of them, in one scan.

    A ring holds the running state of the last ``n`` starts; each word extends all of them by a space and itself, and
    begins one of its own. No run is ever put together.
    """
    crc, count, out = zlib.crc32, 0, array("I")
    ring: list[int] = []
    for part in slices:
        count += len(part)
        for word in part:
            longer = b" " + word
            ring = [crc(longer, s) for s in ring[-(n - 1) :]] if n > 1 else []
            ring.append(crc(word))
            out.extend(ring)
    return count, out


def features(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", n: int = MAX_N, buckets: int = BUCKETS) -> DataFrame:
    """``(doc_id, n_words, n_features, held)`` for each row: ``held`` are the buckets of its features as unsigned 32-bit numbers, or 16-bit ones where those do."""
    rows = key_and_text(docs, id_col, text_col)
    schema = T.StructType([rows.schema["doc_id"], T.StructField("n_words", T.LongType()), T.StructField("n_features", T.LongType()), T.StructField("held", T.BinaryType())])
    kind = _kind(buckets)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, texts in text_batches(iter([batch])):
                counts, sizes, held = [], [], []
                for text in texts:
                    count, found = states(words(text), n)
                    counts.append(count)
                    sizes.append(len(found))
                    held.append((np.frombuffer(found, np.uint32) % np.uint32(buckets)).astype(kind).tobytes() if found else b"")
                kinds = (batch.schema.field(0).type, pa.int64(), pa.int64(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip((ids, counts, sizes, held), kinds, strict=True)], names=schema.names)

    return rows.mapInArrow(run, schema)


def _kind(buckets: int) -> type:
    return np.uint16 if buckets <= 1 << 16 else np.uint32


def histogram(found: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """``(bucket, n)``: the features of all rows of :func:`features`, for the buckets that have any. A task gives each bucket once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(buckets, np.int64)
        for batch in batches:
            for held in batch.column(0):
                sums += np.bincount(np.frombuffer(held.as_py(), _kind(buckets)), minlength=buckets)
        some = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(sums[some])], names=["bucket", "n"])

    return found.select("held").mapInArrow(run, "bucket int, n bigint").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(corpus: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> list[int]:
    """floor(1000 ln((t + 1) (S + buckets) / ((s + 1) (T + buckets)))) of each bucket: s and t its features in corpus and target, S and T all of them.

    ``corpus`` and ``target`` are histograms. As many numbers as there are buckets reach the driver, however large the corpus.
    """
    s, t = np.zeros(buckets), np.zeros(buckets)
    for counts, of in ((s, corpus), (t, target)):
        for r in of.collect():
            counts[r["bucket"]] = r["n"]
    return np.floor(1000 * np.log((t + 1) * (s.sum() + buckets) / ((s + 1) * (t.sum() + buckets)))).astype(np.int64).tolist()


def _weight(by_bucket: list[int]) -> Column:
    table, kind = np.array(by_bucket, np.int64), _kind(len(by_bucket))

    @F.arrow_udf("bigint")
    def weight(held: pa.Array) -> pa.Array:
        return pa.array([int(table[np.frombuffer(h.as_py(), kind)].sum()) for h in held], pa.int64())

    return weight("held")


def noise(id_col: str, seed: int = SEED) -> Column:
    """floor(-1000 ln(-ln(u))) with u from the first eight hex digits of sha256(``seed:id``); a null id is an empty one."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def _least(scored: DataFrame, drawn: int) -> tuple[Column, int]:
    """A step of the score that rises with it, and the step of the row that is the last one drawn: a row a step reaches the driver."""
    size = F.floor(F.log2(1 + F.abs(F.col("score").cast("double"))) * STEPS).cast("int")
    step = F.when(F.col("score") < 0, -size).otherwise(size)
    room = drawn
    for r in sorted(scored.groupBy(step.alias("step")).count().collect(), key=lambda r: -r["step"]):
        room -= r["count"]
        if room <= 0:
            return step, r["step"]
    return step, -(1 << 30)


def resample(
    docs: DataFrame,
    target: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    target_text_col: str = "text",
    n: int = MAX_N,
    buckets: int = BUCKETS,
    min_words: int = MIN_WORDS,
    percent: int = PERCENT,
    seed: int = SEED,
) -> DataFrame:
    """``(doc_id, n_features, weight, score, rank)`` for each row of ``docs``: rank 1, 2, 3... by score for ``percent`` of a hundred of the rows of ``min_words`` words.

    Each text is scanned once (:func:`states`) and its buckets are written; their histogram, the gains and the weights
    come from what was written. ``weight`` is the sum of the gains of a text's features and ``score`` that and the noise. Ties go to the smaller id.
    Only rows about as high as the last one drawn, or higher, are put in order, in ranges.

    A null or an empty text has no features and weight 0. A null id has the noise of an empty one and comes last among ties.
    Repeated rows each count, have one score, and get ranks of their own, those of more features first. Other columns are left out; an
    empty table gives an empty one, and against an empty target only the corpus's own counts weigh.
    """
    found = materialize(features(docs, id_col=id_col, text_col=text_col, n=n, buckets=buckets), "resample-features")
    wanted = target.select(F.lit(0).alias("id_"), F.col(f"`{target_text_col}`").alias("text_"))
    of_target = features(wanted, id_col="id_", text_col="text_", n=n, buckets=buckets)
    by_bucket = gains(histogram(found, buckets), histogram(of_target, buckets), buckets)
    weighed = found.select("doc_id", "n_words", "n_features", _weight(by_bucket).alias("weight"))
    scored = materialize(weighed.withColumn("score", F.col("weight") + noise("doc_id", seed)), "resample-scores")
    able = F.col("n_words") >= min_words
    drawn = scored.where(able).count() * percent // 100
    step, least = _least(scored.where(able), drawn)
    near = able & (step >= least)
    ordered = in_order(scored.where(near), F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("n_features").desc())
    rank = F.when(F.col("place") < drawn, F.col("place") + 1).cast("long")
    columns = ["doc_id", "n_features", "weight", "score"]
    return ordered.select(*columns, rank.alias("rank")).union(scored.where(~near).select(*columns, F.lit(None).cast("long")))
