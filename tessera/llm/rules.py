"""Quality rules: base counts, and the divergence of character classes and common words from a language's reference."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.session import materialize

SPACE = r"[\x20\x09-\x0D]+"
#: Common words of each language whose shares are compared.
COMMON = {
    "en": ["the", "of", "and", "to", "in", "is", "that", "it", "was", "for", "on", "with", "as", "be", "by", "at", "this", "from", "are", "an"],
    "de": ["der", "die", "und", "in", "den", "von", "zu", "das", "mit", "sich", "des", "auf", "für", "ist", "im", "dem", "nicht", "ein", "eine", "als"],
    "fr": ["de", "la", "le", "et", "les", "des", "en", "un", "du", "une", "que", "est", "pour", "qui", "dans", "par", "sur", "au", "plus", "pas"],
    "es": ["de", "la", "que", "el", "en", "y", "a", "los", "se", "del", "las", "un", "por", "con", "no", "una", "su", "para", "es", "al"],
}
#: Distances from the reference beyond which a text fails, and the characters or words under which it isn't judged.
MAX_CLASS_DISTANCE, MIN_CHARS, MAX_WORD_DISTANCE, MIN_WORDS = 0.33, 400, 0.28, 150


def _length_without(text: Column, pattern: str) -> Column:
    return F.char_length(F.regexp_replace(text, pattern, ""))


def _met(listed: list[str]) -> Column:
    return F.filter("words", lambda w: w.isin(listed))


def features(docs: DataFrame, id_col: str, text_col: str, lang_col: str | None) -> DataFrame:
    """Counts of each text: those of the base rules, ``classes`` and ``common``."""
    lang = F.col(lang_col).cast("string") if lang_col else F.lit(None).cast("string")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), lang.alias("lang"))
    rows = rows.withColumn("words", F.array_remove(F.split("text", SPACE), ""))
    rows = rows.withColumns({"hashes": F.transform("words", lambda w: F.xxhash64(w)), "odd": F.regexp_replace("text", r"[a-z\x20\x09-\x0D]++", ""), "lines": F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))})
    n = F.size("words")
    windows = F.transform(F.sequence(F.lit(0), n - 5), lambda i: F.xxhash64(*(F.get("hashes", i + k) for k in range(5))))
    rows = rows.withColumn("windows", F.when(n >= 5, windows).otherwise(F.array().cast("array<bigint>")))
    # Only texts with a repeated window sort theirs; each is a (hash, position), so equal ones stand together.
    repeated = F.size("windows") > F.size(F.array_distinct("windows"))
    placed = F.sort_array(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    rows = rows.withColumn("placed", F.when(repeated, placed).otherwise(F.array().cast("array<struct<h:bigint,i:int>>")))

    def twice(x: Column, k: Column) -> Column:
        before, after = F.get("placed", k - 1)["h"], F.get("placed", k + 1)["h"]
        return F.when((x["h"] == F.coalesce(before, x["h"] + 1)) | (x["h"] == F.coalesce(after, x["h"] + 1)), x["i"])

    rows = rows.withColumn("at", F.sort_array(F.array_compact(F.transform("placed", twice))))
    gaps = F.transform("at", lambda p, k: F.least(F.lit(5), F.coalesce(F.get("at", k + 1) - p, F.lit(5))).cast("long"))
    covered = F.aggregate(gaps, F.lit(0).cast("long"), lambda s, g: s + g)
    word_chars = F.char_length(F.array_join("words", ""))
    digits, upper = _length_without(F.col("odd"), "[^0-9]++"), _length_without(F.col("odd"), "[^A-Z]++")
    symbols, ascii_ = _length_without(F.col("odd"), r"[^#*$%&|<>]++"), _length_without(F.col("odd"), r"[^\x00-\x7F]++")
    odd = F.char_length("odd")
    spaces = F.char_length("text") - word_chars
    classes = [F.char_length("text") - odd - spaces, spaces, upper, digits, symbols, ascii_ - upper - digits - symbols, odd - ascii_]

    # Branches share no subexpressions, so the words that are met stand in a column of their own.
    known, met = F.lit(None).cast("array<string>"), F.lit(None).cast("array<string>")
    for lang_, listed in COMMON.items():
        known = F.when(F.col("lang") == lang_, F.array(*map(F.lit, listed))).otherwise(known)
        met = F.when(F.col("lang") == lang_, _met(listed)).otherwise(met)
    rows = rows.withColumns({"known": known, "met": met})
    width = len(next(iter(COMMON.values())))
    each = [(F.size("met") - F.size(F.array_remove("met", F.get("known", F.lit(k))))).cast("long") for k in range(width)]
    return rows.select(
        "doc_id",
        "lang",
        n.cast("long").alias("n_words"),
        word_chars.cast("long").alias("word_chars"),
        symbols.cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        covered.alias("n_repeat_words"),
        F.array(*(c.cast("long") for c in classes)).alias("classes"),
        F.when(F.col("known").isNotNull(), F.array(*each, (n - F.size("met")).cast("long"))).alias("common"),
    )


def _sums(name: str, n: int) -> Column:
    return F.array(*(F.sum(F.get(name, F.lit(k))) for k in range(n)))


def total(x: Column) -> Column:
    """The sum of a histogram of counts."""
    return F.aggregate(x, F.lit(0).cast("long"), lambda s, v: s + v)


def distance(p: str, sum_p: str, q: str, sum_q: str) -> Column:
    """The Jensen-Shannon distance, to base 2, of two columns of counts whose sums are columns too; null where a sum is 0."""

    def part(x: Column, m: Column) -> Column:
        return F.when(x > 0, x * F.log2(x / m)).otherwise(F.lit(0.0))

    def add(state: Column, pair: Column) -> Column:
        x, y = pair["x"], pair["y"]
        m = (x + y) / 2
        return state + (part(x, m) + part(y, m)) / 2

    shares = F.zip_with(p, q, lambda x, y: F.struct((x / F.col(sum_p)).alias("x"), (y / F.col(sum_q)).alias("y")))
    found = F.sqrt(F.greatest(F.lit(0.0), F.aggregate(shares, F.lit(0.0).cast("double"), add)))
    return F.when((F.col(sum_p) > 0) & (F.col(sum_q) > 0), found)


def judge(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str | None = "lang",
    max_class_distance: float = MAX_CLASS_DISTANCE,
    min_chars: int = MIN_CHARS,
    max_word_distance: float = MAX_WORD_DISTANCE,
    min_words: int = MIN_WORDS,
) -> DataFrame:
    """The base rules' counts, both distances and the verdict for each row of ``docs``.

    Gives ``(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, class_distance,
    word_distance, kept)``. A language's references are the pooled histograms of all its documents: seven
    character classes (lower case, white space, upper case, digits, symbols, other ASCII, other), and the common
    words of ``COMMON`` with one bin for the rest. A text that passes the base rules still goes if it has
    ``min_chars`` characters and its classes lie beyond ``max_class_distance``, or ``min_words`` words and its
    words lie beyond ``max_word_distance``.

    Counts of each text are made once, inside the scan, and written; the references (a row a language) come from
    them by partial sums. Null and empty texts have no words and fail the base rules; a null language, or one
    without common words, is a language without a word distance; repeated rows each get their result; other
    columns are left out; an empty table gives an empty one.
    """
    made = materialize(features(docs, id_col, text_col, lang_col).withColumn("lang", F.coalesce("lang", F.lit(""))), "rules")
    width = len(next(iter(COMMON.values()))) + 1
    reference = made.groupBy("lang").agg(_sums("classes", 7).alias("ref_classes"), F.when(F.max(F.size("common")) > 0, _sums("common", width)).alias("ref_common"))
    sums = {"n_classes": total(F.col("classes")), "n_common": total(F.col("common"))}
    both = made.withColumns(sums).join(reference.withColumns({f"ref_{k}": total(F.col("ref_" + k[2:])) for k in sums}), "lang", "left")
    chars = F.col("n_classes")
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    apart = {f"{x}_distance": distance(c, f"n_{c}", f"ref_{c}", f"ref_n_{c}") for x, c in (("class", "classes"), ("word", "common"))}
    both = both.withColumns({"base_failed": failed, **apart})
    far = (chars >= min_chars) & (F.coalesce("class_distance", F.lit(0.0)) > max_class_distance)
    far = far | (F.col("n_words") >= min_words) & (F.coalesce("word_distance", F.lit(0.0)) > max_word_distance)
    return both.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "class_distance", "word_distance", (~failed & ~far).alias("kept"))
