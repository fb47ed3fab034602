"""URL filters: rules by host and path, else host words by unigram Viterbi and multinomial naive Bayes.

Names are cut by the words of all documents, whatever their number; labels are rows of names, bounded, of which a short list is given.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.session import materialize

#: The rules in force: verdict, host, path.
RULES = (("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/"))
#: The labelled rows that the filter is fitted to where none are given, 106 of them: words of unwanted names and of usual ones.
UNWANTED = """casino win|casino bonus|online casino slots|poker win cash|free bets|sports bets odds|free spins bonus|cheap pills|cheap meds pills|buy viagra cheap|pharmacy pills sale
adult x|adult x video|xxx porn tube|sex cams adult|hot sex chat|nude cams x|spam farm|link farm spam|spam links seo|ads track|ads tracker click|ads click pixel track|banner ads pop under
payday loan fast|quick cash loan|lottery win prize|win free prize|replica watches cheap|torrent crack warez|free download crack|escort dating adult|gambling bets casino|jackpot slots win"""
USUAL = """news daily|city news|blog food|my blog|travel blog|school library|public library|state university|science journal|health news|book shop|music store|garden shop|farm house|family farm
free press|free software|race track|music album list|open data|weather report|sports news|art museum|history museum|town hall|local school|home page|web forum|tech forum
photo gallery|recipe book|kitchen recipe|medical journal|law review|car parts|bike shop|pet care|child care|job board|bank help|help desk|user guide|docs api|code review|game review
movie review|book review|world map|radio station|tv guide|green energy|house plans|film club|chess club|football club|church choir|event calendar|press release|about contact|mobile site
en index|de index|fr index|es index|article archive|category page|user profile|product page|search results|news archive|wiki page|project docs"""
#: Share of unwanted URLs.
PRIOR = 0.2
#: Letters of a word inside a name at most (those of a host's label), and what one more letter of an unknown word costs.
LONGEST, LETTER = 63, math.log(10)
#: A key is common if it has a share of 1 in so many of all rows; so at most as many keys are, and they are broadcast.
SHARES = 10_000
#: Log odds are summed in whole millionths, so that no order of additions changes a verdict.
UNIT = 1_000_000
_WORD = re.compile(r"[^\W\d_]+")


def host_and_path(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path of a URL; both empty for null or without ``://``."""
    at = url.find("://") if url else -1
    if at < 0:
        return "", ""
    rest = url[at + 3 :]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    return re.sub("[A-Z]+", lambda m: m[0].lower(), host), path


def rule_for(host: str, path: str, rules: Iterable[tuple[str, str, str]] = RULES) -> tuple[str, str] | None:
    """(verdict, rule) of the longest rule that fits: its host or a subdomain of it, and a path that starts as its does."""
    fits = [(len(h) + len(p), len(p), h + p, verdict) for verdict, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (lambda x: (x[3], x[2]))(max(fits)) if fits else None


def tokens_of(host: str, path: str) -> list[str]:
    """Runs of letters in host and path, in lower case. The host's last label is one token, with its dot, and is never cut; a country's is left out."""
    head, dot, last = host.rpartition(".")
    named, end = (head, [dot + last.lower()] if len(last) > 2 else []) if dot and last else (host, [])
    return [*_WORD.findall(named.lower()), *end, *_WORD.findall(path.lower())]


def segment(name: str, costs: dict[str, float], unknown: float) -> list[str]:
    """The cheapest split of a name into known words, with their costs, and unknown ones.

    An unknown word costs ``unknown`` and ``LETTER`` for each letter but the first, so that an unknown name isn't cut for a short word inside it.
    Known words have two letters or more. Of splits that cost the same the one whose last word is longest is taken.
    """
    longest = max(map(len, costs), default=0)
    best: list[tuple[float, int]] = [(0.0, 0)]
    loose, since = math.inf, 0
    for i in range(1, len(name) + 1):
        fresh = best[i - 1][0] + unknown
        loose, since = (loose + LETTER, since) if loose + LETTER <= fresh else (fresh, i - 1)
        found = (loose, since)
        for j in range(max(0, i - longest), i - 1):
            word = costs.get(name[j:i])
            if word is not None and (best[j][0] + word, j) < found:
                found = (best[j][0] + word, j)
        best.append(found)
    words, i = [], len(name)
    while i:
        words.append(name[best[i][1] : i])
        i = best[i][1]
    return words[::-1]


def unigrams(docs: DataFrame, *, text_col: str = "text") -> DataFrame:
    """``(piece, n)``: how often each word of all texts occurs; words are runs of letters in lower case, of 2 to ``LONGEST``.

    Counts are reduced before their shuffle. Null and empty texts have no words. No word is left out for being rare.
    """
    words = docs.select(F.explode(F.split(F.lower(F.col(f"`{text_col}`").cast("string")), r"[^\p{L}]+")).alias("piece"))
    return words.where(F.char_length("piece").between(2, LONGEST)).groupBy("piece").agg(F.count("*").alias("n"))


def _with(rows: DataFrame, values: DataFrame, key: str, weight: str) -> DataFrame:
    """``rows`` joined to ``values``, which has one row a key; those of common keys, ``SHARES`` at most, by a broadcast."""
    total = values.agg(F.sum(weight)).first()[0] or 0
    common, rest = values.where(F.col(weight) * SHARES >= total).drop(weight), values.where(F.col(weight) * SHARES < total).drop(weight)
    others = rows.join(F.broadcast(common.select(key)), key, "left_anti")
    return rows.join(F.broadcast(common), key).unionByName(others.join(rest, key))


def _pieces(tokens: DataFrame) -> DataFrame:
    """``(token, piece)``: each part of a token that could be a word, once."""
    schema = "token string, piece string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for token in batch.column(0).to_pylist():
                for start in range(0, len(token), 4_096):
                    ends = ((i, min(i + LONGEST, len(token))) for i in range(start, min(start + 4_096, len(token))))
                    found = sorted({token[i:j] for i, end in ends for j in range(i + 2, end + 1)})
                    if found:
                        yield pa.RecordBatch.from_arrays([pa.array([token] * len(found), pa.string()), pa.array(found, pa.string())], names=["token", "piece"])

    return tokens.select("token").mapInArrow(run, schema)


def costs_of(words: DataFrame, taught: DataFrame) -> tuple[DataFrame, float]:
    """``(piece, cost)`` by the counts (piece, n) of a corpus and (word, bad, good) of labelled names, each for a half, and an unknown word's cost.

    A word costs the negative log of its share. An unknown one costs as much as one that the corpus has once.
    """
    total, labels = words.agg(F.sum("n")).first()[0] or 0, taught.agg(F.sum(F.col("bad") + F.col("good"))).first()[0] or 0
    named = taught.select(F.col("word").alias("piece"), (F.col("bad") + F.col("good")).alias("m")).where(F.char_length("piece") > 1)
    share = (F.coalesce("n", F.lit(0)) / F.lit(max(total, 1)) + F.coalesce("m", F.lit(0)) / F.lit(max(labels, 1))) / 2
    return words.join(named, "piece", "full").select("piece", (-F.log(share)).alias("cost")), math.log(2 * max(total, labels, 1))


def segmented(tokens: DataFrame, costs: DataFrame, unknown: float) -> DataFrame:
    """``(token, words)`` for distinct ``tokens`` by the words of :func:`costs_of`.

    Each token is joined to the words that are parts of it, at most ``LONGEST`` for each of its letters; so no task holds a dictionary,
    and no word is left out. A token that starts with a dot is one word, without the dot.
    """
    cut = tokens.where(~F.col("token").startswith("."))
    pieces = _pieces(cut).distinct()
    known = materialize(pieces.groupBy("piece").agg(F.count("*").alias("df")).join(costs, "piece"), "known-pieces")
    found = _with(pieces, known, "piece", "df").groupBy("token").agg(F.collect_list(F.struct("piece", "cost")).alias("known"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            split = []
            for token, held in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                split.append([token[1:]] if token.startswith(".") else segment(token, {k["piece"]: k["cost"] for k in held or ()}, unknown))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(split, pa.list_(pa.string()))], names=["token", "words"])

    return tokens.select("token").join(found, "token", "left").select("token", "known").mapInArrow(run, "token string, words array<string>")


def labelled_names(spark: SparkSession) -> DataFrame:
    """``(words, unwanted)``: the given labelled rows."""
    rows = [(x.split(), bad) for text, bad in ((UNWANTED, True), (USUAL, False)) for x in re.split(r"[|\n]", text)]
    return spark.createDataFrame(rows, "words array<string>, unwanted boolean")


def _read(urls: DataFrame, rules: tuple[tuple[str, str, str], ...]) -> DataFrame:
    """A row (key, host, path, rule, verdict, tokens) for each row (key, url); rule and verdict are null where no rule fits."""
    schema = "key bigint, host string, path string, rule string, verdict string, tokens array<string>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [host_and_path(u) for u in batch.column(1).to_pylist()]
            fits = [rule_for(*p, rules) or (None, None) for p in parts]
            columns = [[p[0] for p in parts], [p[1] for p in parts], [f[1] for f in fits], [f[0] for f in fits]]
            tokens = pa.array([tokens_of(*p) for p in parts], pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.string()) for c in columns), tokens], names=["key", "host", "path", "rule", "verdict", "tokens"])

    return urls.mapInArrow(run, schema)


def odds_of(taught: DataFrame, smoothing: float) -> DataFrame:
    """``(word, odds)``: the log odds of unwanted against usual for each word of (word, bad, good), in millionths."""
    all_bad, all_good, size = taught.agg(F.sum("bad"), F.sum("good"), F.count("*")).first()
    bad = F.log((F.col("bad") + smoothing) / F.lit((all_bad or 0) + smoothing * size))
    good = F.log((F.col("good") + smoothing) / F.lit((all_good or 0) + smoothing * size))
    return taught.select("word", F.round((bad - good) * UNIT).cast("long").alias("odds"))


def filter_urls(
    pages: DataFrame,
    docs: DataFrame,
    *,
    id_col: str = "page_id",
    url_col: str = "url",
    rules: Iterable[tuple[str, str, str]] = RULES,
    labelled: DataFrame | None = None,
    prior: float = PRIOR,
    smoothing: float = 0.5,
) -> DataFrame:
    """``(page_id, host, path, rule, verdict, log_odds)`` for each row of ``pages``.

    The longest rule that fits gives the verdict. Where none does, names in host and path are cut into words by unigram Viterbi, with the
    words of all ``docs`` (``text``) and of labelled names, and scored by multinomial naive Bayes: block where the log odds exceed 0. It is fitted to all
    rows of ``labelled`` (``words`` of a name, ``unwanted`` boolean), or else to the 106 given ones; ``prior`` is the share of unwanted URLs.
    A word without labels counts for nothing, and so do numbers and a country's two letters at a host's end.

    Tokens are counted before anything is shuffled, each distinct one is cut once, and pages are scored by the sums of their tokens; keys that
    many rows have are joined by a broadcast of at most ``SHARES`` rows. No dictionary is held in a task or the driver, and no word is left out for being rare.

    A null url, or one without ``://``, has an empty host and path and no words, and is allowed; very long
    urls are scored whole, and in them a word of more than ``LONGEST`` letters is unknown; rows of ``labelled`` with a null are left out; repeated rows
    each get their result; other columns are left out (they aren't read); an empty table gives an empty one; without documents labelled names cut alone.
    """
    rules = tuple(rules)
    rows = pages.select(F.monotonically_increasing_id().alias("key"), F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"))
    rows = materialize(rows, "urls")
    read = materialize(_read(rows.select("key", "url"), rules), "url-parts")
    labelled = labelled_names(pages.sparkSession) if labelled is None else labelled
    named = labelled.where("words IS NOT NULL AND unwanted IS NOT NULL").select(F.explode("words").alias("word"), "unwanted").where("word IS NOT NULL")
    taught = materialize(named.groupBy("word").agg(F.count_if("unwanted").alias("bad"), F.count_if(~F.col("unwanted")).alias("good")), "url-labels")

    tokens = materialize(read.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count("*").alias("n")), "url-tokens")
    costs, unknown = costs_of(materialize(unigrams(docs), "unigrams"), taught)
    cuts = segmented(tokens, costs, unknown).select("token", F.explode("words").alias("word"))
    scores = cuts.join(odds_of(taught, smoothing), "word").groupBy("token").agg(F.sum("odds").alias("odds"))
    scores = materialize(tokens.join(scores, "token"), "url-scores")
    summed = _with(read.select("key", F.explode("tokens").alias("token")), scores, "token", "n").groupBy("key").agg(F.sum("odds").alias("odds"))
    joined = rows.select("key", "page_id").join(read.drop("tokens"), "key").join(summed, "key", "left")
    odds = F.coalesce("odds", F.lit(0)) + F.lit(round(math.log(prior / (1 - prior)) * UNIT))
    verdict = F.coalesce("verdict", F.when(odds > 0, "block").otherwise("allow")).alias("verdict")
    return joined.select("page_id", "host", "path", "rule", verdict, (odds / UNIT).alias("log_odds"))
