"""Quality classifier by hierarchical empirical Bayes: a text's own evidence, and what its site and section tell."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.rules import features
from tessera.session import materialize

#: Labelled rows that the classifier is fitted to, at most, chosen by hashes of their ids.
MAX_LABELLED = 20_000
#: The signed root of the likelihood ratio (in normal deviates) from which a word tells of a toxic text: chance words of the labelled
#: rows lie below. Unlike a bound on standard errors it holds for small counts: a word of 4 of 11 toxic rows and no other is one.
MIN_ROOT = 4.0
#: The classifier's features: shares of counts from :func:`tessera.llm.rules.features`, and the evidence of :func:`toxic_evidence`.
NAMES = ("log_words", "word_length", "symbols", "spaces", "upper", "digits", "other_ascii", "other", "dup_lines", "repeat_words", "common", "toxic_words")
#: Bounds of the log odds that one text's own evidence can have.
CLIP = 12.0
#: Sections up to which their posteriors are broadcast.
MAX_BROADCAST = 200_000
#: The probability of a good text under which it is rejected: low, as a clean text lost costs more than a poor one kept.
THRESHOLD = 0.2


def vector(counts: str = "") -> dict[str, Column]:
    """Each feature as a number between about 0 and 1, from columns of counts; without words or characters 0."""

    def c(name: str) -> Column:
        return F.col(f"{counts}.{name}" if counts else name)

    chars = F.greatest(F.lit(1), F.aggregate(c("classes"), F.lit(0).cast("long"), lambda s, v: s + v)).cast("double")
    words = F.greatest(F.lit(1), c("n_words")).cast("double")
    share = {name: F.get(c("classes"), F.lit(k)) / chars for name, k in (("spaces", 1), ("upper", 2), ("digits", 3), ("symbols", 4), ("other_ascii", 5), ("other", 6))}
    common = F.coalesce(1 - F.try_element_at(c("common"), F.lit(-1)) / words, F.lit(0.0))
    rest = {"log_words": F.log1p(words) / 10, "word_length": F.least(F.lit(1.0), c("word_chars") / words / 20), "dup_lines": c("n_dup_lines") / words, "repeat_words": c("n_repeat_words") / words, "common": common, "toxic_words": c("toxic_words") / 10}
    return {n: (share | rest)[n] for n in NAMES}


@dataclass(frozen=True)
class Classifier:
    """Logistic regression over standardised features."""

    weights: dict[str, float] = field(default_factory=dict)
    mean: dict[str, float] = field(default_factory=dict)
    scale: dict[str, float] = field(default_factory=dict)
    bias: float = 0.0

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 50) -> Classifier:
        """By Newton's method. With no rows, or only one class, every text has even odds."""
        if not len(y) or y.min() == y.max():
            return cls()
        mean, scale = x.mean(axis=0), x.std(axis=0)
        scale[scale < 1e-9] = 1.0
        z = np.column_stack([(x - mean) / scale, np.ones(len(x))])
        w = np.zeros(z.shape[1])
        penalty = np.full(len(w), ridge)
        penalty[-1] = 1e-6
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
            step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(penalty), z.T @ (p - y) + penalty * w)
            w -= step
            if np.abs(step).max() < 1e-8:
                break
        return cls(dict(zip(NAMES, w[:-1].tolist(), strict=True)), dict(zip(NAMES, mean.tolist(), strict=True)), dict(zip(NAMES, scale.tolist(), strict=True)), float(w[-1]))

    def log_odds(self, counts: str = "") -> Column:
        found = F.lit(self.bias)
        for name, value in vector(counts).items():
            if name in self.weights:
                found = found + (value - self.mean[name]) / self.scale[name] * self.weights[name]
        return F.greatest(F.lit(-CLIP), F.least(F.lit(CLIP), found))


def labelled(labels: DataFrame, *, label_id: str = "doc_id", label_col: str = "quality", toxic_col: str = "toxic", max_labelled: int = MAX_LABELLED) -> DataFrame:
    """(doc_id, y, toxic) of about ``max_labelled`` labelled rows, and no more, chosen by hashes of their ids.

    ``y`` is 1 where the text is good and not toxic; without a column ``toxic_col``, or where it is null, nothing is toxic.
    """
    toxic = F.coalesce(F.col(toxic_col).cast("double"), F.lit(0.0)) if toxic_col in labels.columns else F.lit(0.0)
    known = labels.select(F.col(label_id).alias("doc_id"), F.col(label_col).cast("double").alias("y"), toxic.alias("toxic")).where("doc_id IS NOT NULL AND y IS NOT NULL")
    known = known.groupBy("doc_id").agg(F.avg("y").alias("y"), (F.avg("toxic") >= 0.5).cast("int").alias("toxic"))
    known = materialize(known.select("doc_id", ((F.col("y") >= 0.5) & (F.col("toxic") == 0)).cast("int").alias("y"), "toxic"), "labels")
    share = 0.95 * max_labelled / max(1, known.count())
    # Hashes choose about the share that is allowed, so that no task sends more than its part of it.
    return known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(min(1.0, share) * 1_000_000))


def _word_hashes(text: Column) -> Column:
    """Hashes of the words of a text in lower case, without what isn't a letter or digit."""
    return F.transform(F.split(F.lower(F.coalesce(text.cast("string"), F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: F.xxhash64(w))


def toxic_words(texts: DataFrame) -> dict[int, float]:
    """The log odds of a toxic text by hashes of words, from (text, toxic) of labelled rows.

    A word counts once a text. Only those words come to the driver that toxic texts have more often by a likelihood ratio whose root
    is ``MIN_ROOT`` or more, so few labelled rows tell few words or none.
    """
    n = texts.groupBy("toxic").count().collect()
    n = {r["toxic"]: r["count"] for r in n}
    if not n.get(0) or not n.get(1):
        return {}
    met = texts.select("toxic", F.explode(F.array_distinct(_word_hashes(F.col("text")))).alias("word"))
    seen = met.groupBy("word").agg(F.sum("toxic").alias("a"), F.sum(1 - F.col("toxic")).alias("b")).where("a > 0")
    odds = F.log((F.col("a") + 0.5) / (n[1] + 1)) - F.log((F.col("b") + 0.5) / (n[0] + 1))
    all_, met_ = float(n[0] + n[1]), F.col("a") + F.col("b")

    def part(seen_: Column, expected: Column) -> Column:
        return F.when(seen_ > 0, seen_ * F.log(seen_ / expected)).otherwise(0.0)

    cells = [(F.col("a"), met_, n[1]), (F.col("b"), met_, n[0]), (n[1] - F.col("a"), all_ - met_, n[1]), (n[0] - F.col("b"), all_ - met_, n[0])]
    ratio = 2 * sum((part(x, of * size / all_) for x, of, size in cells), F.lit(0.0))
    more = F.col("a") * n[0] > F.col("b") * n[1]
    told = seen.where(more & (ratio >= MIN_ROOT**2)).select("word", odds.alias("odds"))
    return {r["word"]: r["odds"] for r in told.orderBy("word").collect()}


def toxic_evidence(text: Column, words: dict[int, float]) -> Column:
    """The sum of the log odds of the known toxic words that a text has."""
    if not words:
        return F.lit(0.0)
    odds = F.create_map(*(F.lit(x) for pair in words.items() for x in pair))
    met = F.array_intersect(_word_hashes(text), F.array(*(F.lit(w).cast("long") for w in words)))
    return F.aggregate(met, F.lit(0.0), lambda s, w: s + F.coalesce(F.try_element_at(odds, w), F.lit(0.0)))


def fit_classifier(counts: DataFrame, chosen: DataFrame, *, max_labelled: int = MAX_LABELLED) -> Classifier:
    """The classifier fitted to the rows of ``counts`` that :func:`labelled` has chosen."""
    rows = counts.join(chosen, "doc_id").limit(max_labelled)
    got = rows.select(F.col("y").cast("double").alias("y"), *(v.alias(n) for n, v in vector().items())).toPandas()
    return Classifier.fit(got[list(NAMES)].to_numpy(float), got["y"].to_numpy(float))


def _logit(p: Column) -> Column:
    return F.log(p / (1 - p))


def _strength(groups: DataFrame, mean: Column) -> float:
    """How many texts a prior is worth, by moments: what the groups' means vary beyond what chance explains.

    One row of sums over groups of (n, s), the count and sum of their texts' probabilities, around ``mean``.
    """
    between = F.sum(F.col("n") * (F.col("s") / F.col("n") - mean) ** 2) / F.sum("n")
    chance = F.sum(mean * (1 - mean)) / F.sum("n")
    within = F.sum(F.col("n") * mean * (1 - mean)) / F.sum("n")
    excess = F.greatest(F.lit(1e-6), between - chance)
    return groups.agg(F.greatest(F.lit(1.0), F.least(F.lit(1e6), within / excess - 1))).first()[0] or 1.0


def _bounded(c: Column) -> Column:
    return F.least(F.lit(0.999), F.greatest(F.lit(0.001), c))


@dataclass(frozen=True)
class Priors:
    """The global mean, and how many texts it is worth for a host, and a host's mean for its section."""

    mean: float
    host: float
    section: float

    def shift(self, n: Column, s: Column, host_n: Column, host_s: Column) -> Column:
        """What counts and sums of probabilities of a section and its host add to a text's log odds."""
        host_mean = _bounded((host_s + self.host * self.mean) / (host_n + self.host))
        shrunk = _bounded((s + self.section * host_mean) / (n + self.section))
        return _logit(shrunk) - _logit(F.lit(self.mean))


def site_posteriors(evidence: DataFrame) -> tuple[DataFrame, Priors]:
    """(host, path, n, s, host_n, host_s, shift) of each section, and the priors; shift is what a section adds to a new text's log odds.

    ``evidence``: (host, path, p). A host's mean is shrunk toward the global mean, a section's toward its host's,
    each by a strength estimated from how the groups differ. All from partial sums for each section; the number
    of rows is that of the sections, and three numbers reach the driver.
    """
    sections = materialize(evidence.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum("p").alias("s")), "sections")
    mean = sections.agg(_bounded(F.sum("s") / F.sum("n"))).first()[0] or 0.5
    hosts = sections.groupBy("host").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    strength = _strength(hosts, F.lit(mean))
    inner = sections.join(hosts.select("host", F.col("n").alias("host_n"), F.col("s").alias("host_s")), "host")
    host_mean = _bounded((F.col("host_s") + strength * mean) / (F.col("host_n") + strength))
    priors = Priors(mean, strength, _strength(inner.withColumn("host_mean", host_mean), F.col("host_mean")))
    return inner.withColumn("shift", priors.shift(*map(F.col, ("n", "s", "host_n", "host_s")))), priors


class QualityModel:
    """A fitted classifier and the posteriors of all sites and sections of a corpus.

    ``counts`` is a written table of each row's features, host and path, with its id or, ``whole``, all of it as ``doc_id``.
    """

    def __init__(self, docs: DataFrame, labels: DataFrame, *, whole: bool = False, id_col: str = "doc_id", text_col: str = "text", lang_col: str | None = "lang", host: str = "source", path: str = "lang", max_labelled: int = MAX_LABELLED) -> None:
        chosen = labelled(labels, max_labelled=max_labelled)
        known = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text")).join(chosen, "doc_id").select("text", "toxic").limit(max_labelled)
        self.words = toxic_words(materialize(known, "labelled"))
        key = F.struct(*(F.col(f"`{c}`") for c in docs.columns)) if whole else F.col(f"`{id_col}`")
        evidence = toxic_evidence(F.col(f"`{text_col}`"), self.words).alias("toxic_words")
        sites = (F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(n) for c, n in ((host, "host"), (path, "path")))
        rows = docs.select(F.struct(key.alias("doc_id"), F.col(f"`{id_col}`").alias("id_"), *sites, evidence).alias("doc_"), F.col(f"`{text_col}`").alias("text_"), (F.col(f"`{lang_col}`") if lang_col else F.lit(None)).alias("lang_"))
        counts = features(rows, "doc_", "text_", "lang_").select("doc_id.*", *(c for c in ("n_words", "word_chars", "n_dup_lines", "n_repeat_words", "classes", "common")))
        # Features are made once, also where whole rows are wanted: writing a text costs less than counting it again.
        self.counts = materialize(counts, "quality")
        self.classifier = fit_classifier(self.counts.drop("doc_id").withColumnRenamed("id_", "doc_id"), chosen, max_labelled=max_labelled)
        self.own = 1 / (1 + F.exp(-self.classifier.log_odds()))
        shifts, self.priors = site_posteriors(self.counts.select("host", "path", self.own.alias("p")))
        shifts = shifts.drop("shift")
        # Broadcast while sections are few, which is counted; else the join shuffles.
        self.shifts = F.broadcast(shifts) if shifts.count() <= MAX_BROADCAST else shifts

    def scored(self, threshold: float = THRESHOLD) -> DataFrame:
        """``counts`` with document_odds, site_shift, score and kept; a text's own part is taken out of its section's and host's sums."""
        rows = self.counts.withColumns({"document_odds": self.classifier.log_odds(), "own": self.own})
        rest = (F.col("n") - 1, F.col("s") - F.col("own"), F.col("host_n") - 1, F.col("host_s") - F.col("own"))
        joined = rows.join(self.shifts, ["host", "path"], "left").withColumn("site_shift", F.coalesce(self.priors.shift(*rest), F.lit(0.0))).drop("n", "s", "host_n", "host_s", "own")
        joined = joined.withColumn("score", 1 / (1 + F.exp(-F.col("document_odds") - F.col("site_shift"))))
        return joined.withColumn("kept", (F.col("n_words") > 0) & (F.col("score") >= threshold))


def classify(docs: DataFrame, labels: DataFrame, *, threshold: float = THRESHOLD, **columns) -> DataFrame:
    """``(doc_id, host, path, document_odds, site_shift, score, kept)`` for each row of ``docs``.

    ``document_odds`` are those of logistic regression over counts of the text and its toxic words, fitted to labelled
    rows (at most ``max_labelled``), of which those are good that have quality and aren't toxic; ``site_shift`` is what the
    posterior of the section's other texts adds; ``score`` is the probability of a good text; a text is kept at ``threshold`` or more.

    Null and empty texts, and those without words, aren't kept; a null host or path is one of its own, named "";
    a null language has no common words; without labels, or with one class only, the text gives even odds and is
    kept; repeated rows each get their result (labels that repeat an id are averaged); other columns are left out;
    an empty table gives an empty one.
    """
    model = QualityModel(docs, labels, **columns)
    return model.scored(threshold).select("doc_id", "host", "path", "document_odds", "site_shift", "score", "kept")


def keep_good(docs: DataFrame, labels: DataFrame, *, threshold: float = THRESHOLD, **columns) -> DataFrame:
    """The rows of ``docs``, all columns, that :func:`classify` keeps; no text is shuffled."""
    return QualityModel(docs, labels, whole=True, **columns).scored(threshold).where("kept").select("doc_id.*")
