"""Benchmark decontamination: windows of item words found in documents, by DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.sift import touching
from tessera.session import materialize

#: ASCII characters that aren't in words, as a class of Java's and DuckDB's patterns.
BREAK = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: 64-bit words of each bit table that sorts out nearly all positions before any join: so many for few windows, doubled until a
#: window has eight bits, and at most so many.
TABLE, MAX_TABLE = 4096, 1 << 16
#: For the hash of a whole window, the shifts whose bits choose a place in either of two tables.
SHIFTS = (0, 32)
#: The distinct windows, and the bytes of them, up to which they are broadcast; beyond, both sides are shuffled.
MAX_WINDOWS, MAX_BYTES = 500_000, 48 << 20


def words_of(text: Column) -> Column:
    """A text's words, A-Z lower-cased; null has none."""
    plain = F.char_length(text) == F.octet_length(text)
    lowered = F.when(plain, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))
    return F.array_remove(F.coalesce(F.split(lowered, BREAK), F.array().cast("array<string>")), "")


def _probe(hashes: Column, at: Column, length: int) -> Column:
    """A hash of the first, middle and last word of the window at a position."""
    return F.xxhash64(*(F.get(hashes, at + k) for k in sorted({0, length // 2, length - 1})))


def _whole(hashes: Column, at: Column, length: int) -> Column:
    """A hash of all words of the window at a position."""
    return F.xxhash64(*(F.get(hashes, at + k) for k in range(length)), F.lit(length))


def _place(h: Column, size: int, shift: int = 0) -> tuple[Column, Column]:
    """The slot of a table of ``size`` words, and the bit in it, that a hash stands for."""
    return F.shiftrightunsigned(h, shift + 6).bitwiseAND(F.lit(size - 1)), F.shiftrightunsigned(h, shift).bitwiseAND(F.lit(63)).cast("int")


def _has(table: Column, h: Column, size: int, shift: int = 0) -> Column:
    slot, bit = _place(h, size, shift)
    return F.call_function("shiftright", F.get(table, slot.cast("int")), bit).bitwiseAND(F.lit(1)) == 1


def _windows(bench: DataFrame, n: int, item_col: str, text_col: str) -> DataFrame:
    """(item, length, window, probe, whole) for each window of each item."""
    items = bench.select(F.col(item_col).cast("string").alias("item"), words_of(F.col(text_col)).alias("words")).where("size(words) > 0")
    items = items.withColumns({"length": F.least(F.lit(n), F.size("words")), "hashes": F.transform("words", lambda w: F.xxhash64(w))})
    starts = F.explode(F.sequence(F.lit(0), F.size("words") - F.col("length"))).alias("at")
    rows = items.select("item", "length", "words", "hashes", starts)

    def hashed(of) -> Column:
        return F.coalesce(*(F.when(F.col("length") == k, of(F.col("hashes"), F.col("at"), k)) for k in range(1, n + 1)))

    return rows.select("item", "length", F.array_join(F.slice("words", F.col("at") + 1, F.col("length")), " ").alias("window"), hashed(_probe).alias("probe"), hashed(_whole).alias("whole"))


def _bits(windows: DataFrame, size: int) -> dict[int, list[str]]:
    """For each window length three bit tables of ``size`` words: of its probes, and two of its whole hashes.

    At most ``3 * size`` rows a length reach the driver, however many windows there are.
    """
    marks = [_place(F.col("probe"), size), *(_place(F.col("whole"), size, s) for s in SHIFTS)]
    one = F.explode(F.array(*(F.struct(F.lit(k).alias("t"), slot.alias("slot"), bit.alias("bit")) for k, (slot, bit) in enumerate(marks)))).alias("m")
    rows = windows.select("length", one).select("length", "m.t", "m.slot", F.expr("shiftleft(1L, m.bit)").alias("bit"))
    tables: dict[int, list[list[int]]] = {}
    for length, t, slot, bits in rows.groupBy("length", "t", "slot").agg(F.bit_or("bit")).collect():
        tables.setdefault(length, [[0] * size for _ in marks])[t][slot] = bits
    return {length: [",".join(map(str, t)) for t in ts] for length, ts in tables.items()}


def _candidates(words: str, hashes: str, bits: dict[int, list[str]], size: int) -> Column:
    """(pos, stop, window) for the positions that the bit tables leave."""

    def of(length: int, tables: list[str]) -> Column:
        first, *others = (F.split(F.lit(t), ",").cast("array<bigint>") for t in tables)
        last = F.size(words) - length
        every = F.transform(F.sequence(F.lit(0), last), lambda i: _probe(F.col(hashes), i, length))
        probes = F.when(last >= 0, every).otherwise(F.array().cast("array<bigint>"))
        at = F.array_compact(F.transform(probes, lambda h, i: F.when(_has(first, h, size), i)))
        whole = F.transform(at, lambda i: F.struct(i.alias("pos"), _whole(F.col(hashes), i, length).alias("h")))
        left = F.filter(whole, lambda x: _has(others[0], x["h"], size, SHIFTS[0]) & _has(others[1], x["h"], size, SHIFTS[1]))

        def window(x: Column) -> Column:
            text = F.array_join(F.slice(F.col(words), x["pos"] + 1, F.lit(length)), " ")
            return F.struct(x["pos"].alias("pos"), (x["pos"] + length).alias("stop"), text.alias("window"))

        return F.transform(left, window)

    found = [of(*x) for x in sorted(bits.items())]
    return F.concat(*found) if found else F.array().cast("array<struct<pos:int,stop:int,window:string>>")


def _covered(spans: Column) -> Column:
    """How many positions sorted spans (pos, stop) cover."""
    start = F.struct(F.lit(0).alias("sum"), F.lit(0).alias("reach"))

    def add(state: Column, s: Column) -> Column:
        gained = F.greatest(F.lit(0), s["stop"] - F.greatest(s["pos"], state["reach"]))
        return F.struct((state["sum"] + gained).alias("sum"), F.greatest(state["reach"], s["stop"]).alias("reach"))

    return F.aggregate(spans, start, add, lambda s: s["sum"])


class _Index:
    """The windows of a benchmark, ready to be looked up."""

    def __init__(self, bench: DataFrame, n: int, item_col: str, text_col: str) -> None:
        windows = _windows(bench, n, item_col, text_col)
        grouped = windows.groupBy("window").agg(F.collect_set("item").alias("items"))
        count, size = grouped.agg(F.count("*"), F.sum(F.octet_length("window") + 16 * F.size("items"))).first()
        self.windows = F.broadcast(grouped) if count <= MAX_WINDOWS and (size or 0) <= MAX_BYTES else grouped
        self.size = min(MAX_TABLE, max(TABLE, 1 << (count // 8).bit_length()))
        self.bits = _bits(windows, self.size)

    def scored(self, docs: DataFrame, text: Column) -> DataFrame:
        """``docs`` with n_words_, cand_ (the candidate windows) and row_.

        ``row_`` isn't deterministic to Spark, so a filter that names it stays above this projection; pushed below,
        it would work out the hashes of all words again for each position.
        """
        split = docs.withColumn("words_", words_of(text))
        hashed = split.withColumn("hashes_", F.transform("words_", lambda w: F.xxhash64(w)))
        return hashed.withColumns({"n_words_": F.size("words_").cast("long"), "cand_": _candidates("words_", "hashes_", self.bits, self.size), "row_": F.monotonically_increasing_id()}).drop("words_", "hashes_")

    def looked_up(self, scored: DataFrame, keep: list[str]) -> DataFrame:
        """A row of ``keep``, spans_ (sorted, of windows that do occur) and items_ for each scored row.

        What is in ``keep`` goes along with each candidate.
        """
        one = scored.select("row_", *keep, F.explode_outer("cand_").alias("c_"))
        # A row without a candidate gets a key of its own, so that no task gathers them all.
        one = one.withColumn("window", F.coalesce(F.col("c_.window"), F.concat(F.lit("\0"), F.col("row_").cast("string"))))
        met = one.join(self.windows, "window", "left")
        span = F.when(F.col("items").isNotNull(), F.struct("c_.pos", "c_.stop"))
        grouped = met.groupBy("row_").agg(*(F.first(c).alias(c) for c in keep), F.sort_array(F.collect_set(span)).alias("spans_"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items_"))
        return grouped.drop("row_")

    def spans(self, scored: DataFrame) -> DataFrame:
        """(key_, spans_) of the texts, named by ``key_``, that windows do occur in. No text goes along with a candidate."""
        one = scored.where("size(cand_) > 0 AND row_ >= 0").select("key_", F.explode("cand_").alias("c_")).select("key_", F.col("c_.window").alias("window"), F.struct("c_.pos", "c_.stop").alias("span"))
        return one.join(self.windows.select("window"), "window").groupBy("key_").agg(F.sort_array(F.collect_set("span")).alias("spans_"))


def contamination(docs: DataFrame, bench: DataFrame, *, n: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", bench_text_col: str = "text") -> DataFrame:
    """``(doc_id, n_words, n_hit, item_ids, spans)`` for each document.

    A window is ``n`` consecutive words of an item; an item of fewer words, but not none, is one window.
    ``n_hit`` counts the words inside any occurrence of any window, ``item_ids`` are the items (as sorted
    strings) with such windows, ``spans`` the occurrences as (pos, stop) in words.

    Bit tables, of the windows' first, middle and last words and of all words, sort out nearly all positions inside the scan;
    what stays is joined on the window's whole words. The windows are broadcast if they are as few as
    ``MAX_WINDOWS`` and as small as ``MAX_BYTES``, which is measured; beyond that both sides are shuffled.

    Null and empty texts have no words; items of null or empty text have no windows, and items of equal
    windows are all named; repeated rows each get their result; other columns are left out; without documents
    the result is empty, without items no word is hit.
    """
    index = _Index(bench, n, item_col, bench_text_col)
    scored = index.scored(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text_")), F.col("text_")).drop("text_")
    found = index.looked_up(scored, ["doc_id", "n_words_"])
    return found.select("doc_id", F.col("n_words_").alias("n_words"), _covered(F.col("spans_")).cast("long").alias("n_hit"), F.col("items_").alias("item_ids"), F.col("spans_").alias("spans"))


def decontaminate(docs: DataFrame, bench: DataFrame, *, action: str = "spans", n: int = 10, text_col: str = "text", item_col: str = "item_id", bench_text_col: str = "text") -> DataFrame:
    """``docs``, all columns, without benchmark passages.

    ``action`` "spans" cuts the words that a window covers, each with what separates it from the next word;
    a text that nothing remains of goes. "documents" drops documents with any hit.

    Spans belong to a text and are found once; texts are looked up by their digests. Only rows whose text may be among
    those with a hit are joined, and others, null texts among them, pass through unshuffled.
    """
    if action not in ("spans", "documents"):
        raise ValueError(f"unknown action {action!r}")
    index = _Index(bench, n, item_col, bench_text_col)
    names = docs.columns
    text = F.col(f"doc_.`{text_col}`").cast("string")
    packed = docs.select(F.struct(*(F.col(f"`{c}`") for c in names)).alias("doc_")).withColumn("key_", F.md5(text.cast("binary")))
    texts = docs.select(F.col(f"`{text_col}`").cast("string").alias("text_")).withColumn("key_", F.md5(F.col("text_").cast("binary")))
    spans = materialize(index.spans(index.scored(texts, F.col("text_")).drop("text_")), "benchmark-spans")
    maybe, clean = touching(packed, spans, ["key_"])
    if action == "documents":
        return clean.union(maybe.join(spans, "key_", "left_anti").select("doc_", "key_")).select("doc_.*")
    # Spans that touch become one, so that a word's test looks at few.
    words, gaps = F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), F.split(text, WORD)
    hit = F.array_distinct(F.flatten(F.transform("spans_", lambda s: F.sequence(s["pos"], s["stop"] - 1))))
    stays = F.array_except(F.sequence(F.lit(0), F.size("words_") - 1), F.col("hit_"))
    rest = F.concat(F.get("gaps_", F.lit(0)), F.array_join(F.transform(stays, lambda i: F.concat(F.get("words_", i), F.coalesce(F.get("gaps_", i + 1), F.lit("")))), ""))
    both = maybe.join(spans, "key_", "left")
    cut = both.where("spans_ IS NOT NULL").select("doc_", words.alias("words_"), gaps.alias("gaps_"), hit.alias("hit_")).withColumn("rest_", rest).where("size(hit_) < size(words_)")
    whole = clean.select("doc_").union(both.where("spans_ IS NULL").select("doc_"))
    return whole.select("doc_.*").unionByName(cut.select(*(F.col("rest_").alias(c) if c == text_col else F.col(f"doc_.`{c}`").alias(c) for c in names)))
