import random

import numpy as np
from pyspark.sql import functions as F

from tessera.llm import quality as Q
from tessera.llm import rules as R


def corpus(n, seed=0):
    rng = random.Random(seed)
    common, rare = R.COMMON["en"], [f"{a}{b}{c}" for a in "bdfgklm" for b in ("an", "or", "ist", "ell") for c in ("er", "ing", "ous", "y")]
    rows, labels = [], []
    for i in range(n):
        good = rng.random() < 0.8
        words = [rng.choice(common if rng.random() < 0.4 else rare) for _ in range(rng.randint(30, 200))]
        text = " ".join(words) + "." if good else " ".join(w.upper() + "!!" if rng.random() < 0.5 else w + "###" for w in words)
        rows.append((i, text, "en", f"s{i % 5}"))
        labels.append((i, int(good)))
    return rows, labels


def test_held_out_accuracy(spark):
    rows, labels = corpus(400)
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    known = spark.createDataFrame(labels[:200], "doc_id long, quality int")
    kept = {r.doc_id: r.kept for r in Q.classify(docs, known).collect()}
    assert np.mean([kept[i] == bool(q) for i, q in labels[200:]]) > 0.97


def test_sparse_sections_shrink_toward_the_rest(spark):
    evidence = [(f"h{h}", "p", 0.9 if h else 0.2) for h in range(6) for _ in range(400)] + [("rare", "p", 0.0), ("h1", "few", 0.0)]
    found = {(r.host, r.path): r.shift for r in Q.site_posteriors(spark.createDataFrame(evidence, "host string, path string, p double"))[0].collect()}
    assert found["h0", "p"] < found["rare", "p"] < found["h1", "p"]
    assert found["h0", "p"] < found["h1", "few"] < found["h1", "p"]


def test_awkward_rows(spark, texts, awkward):
    labels = spark.createDataFrame([(4, 1), (4, 0), (None, 1), (5, None)], "doc_id long, quality int")
    docs = texts(awkward).withColumns({"lang": F.when(F.col("doc_id") == 4, None).otherwise("en"), "source": F.lit(None).cast("string")})
    rows = Q.classify(docs, labels).collect()
    assert len(rows) == len(awkward)
    assert all(r.kept == (r.doc_id not in (1, 2, 3)) for r in rows)
    good = Q.keep_good(docs, labels)
    assert good.columns == docs.columns
    assert good.count() == len(awkward) - 3
    assert Q.classify(texts([]), labels).count() == 0


def test_newton_fits_and_one_class_is_even():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, len(Q.NAMES)))
    y = (x[:, 0] + 0.1 * rng.normal(size=400) > 0).astype(float)
    assert Q.Classifier.fit(x, y).weights[Q.NAMES[0]] > 1
    assert Q.Classifier.fit(x, np.ones(400)).weights == {}


def test_toxic_words_reject_held_out_texts(spark):
    rng = random.Random(1)
    rows, labels = corpus(600)
    insults = ["idiot", "scum", "Moron", "clown"]
    made = []
    for (i, text, lang, source), (_, quality) in zip(rows, labels, strict=True):
        toxic = int(rng.random() < 0.2)
        if toxic:
            words = text.split(" ")
            for w in rng.sample(insults, 3):
                words.insert(rng.randrange(len(words)), w)
            text = " ".join(words)
        made.append((i, text, lang, source, quality, toxic))
    docs = spark.createDataFrame([r[:4] for r in made], "doc_id long, text string, lang string, source string")
    known = spark.createDataFrame([(r[0], r[4], r[5]) for r in made[:400]], "doc_id long, quality int, toxic int")
    kept = {r.doc_id: r.kept for r in Q.classify(docs, known).collect()}
    assert {r.doc_id for r in Q.keep_good(docs, known).collect()} == {i for i, k in kept.items() if k}
    held = made[400:]
    assert np.mean([kept[r[0]] for r in held if r[5]]) < 0.1
    assert np.mean([kept[r[0]] for r in held if r[4] and not r[5]]) > 0.97


def test_few_toxic_labels_tell_no_words(spark):
    rows = [("good words idiot", 1), ("words here", 0), ("good here", 0)]
    assert Q.toxic_words(spark.createDataFrame(rows, "text string, toxic int")) == {}
    assert Q.toxic_words(spark.createDataFrame(rows[1:], "text string, toxic int")) == {}


def test_words_of_few_toxic_rows(spark):
    """Four of eleven toxic rows and none of 76 others tell a word, three don't; nor does one that a sixth of the others have too."""
    toxic = [("boor lout" if k < 3 else "boor" if k < 4 else "plain", 1) for k in range(11)]
    rows = [(f"{t} word", x) for t, x in toxic] + [("plain word" if k % 6 else "plain word odd", 0) for k in range(76)]
    found = Q.toxic_words(spark.createDataFrame(rows, "text string, toxic int"))
    hashed = {w: spark.range(1).select(F.xxhash64(F.lit(w))).first()[0] for w in ("boor", "lout", "odd", "plain", "word")}
    assert found.keys() == {hashed["boor"]}
    assert abs(found[hashed["boor"]] - (np.log(4.5 / 12) - np.log(0.5 / 77))) < 1e-9


def test_a_text_is_no_evidence_for_its_own_section(spark):
    rows, labels = corpus(400)
    rows = [(i, t, lang, f"alone{i}" if i < 5 else s) for i, t, lang, s in rows]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    model = Q.QualityModel(docs, spark.createDataFrame(labels, "doc_id long, quality int"))
    shifts = {r.doc_id: r.site_shift for r in model.scored().collect()}
    # Alone on its host, a text has the global prior, whatever it is like.
    assert all(abs(shifts[i]) < 1e-9 for i in range(5))


def test_held_out_labels_of_the_tables(spark):
    """Fitted to one half of the labels, judged by the other."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    half = F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0
    rows = Q.classify(docs, labels.where(half)).join(labels.where(~half), "doc_id").groupBy("quality", "toxic").agg(F.count("*").alias("n"), F.count_if("kept").alias("kept")).collect()
    of = {(r.quality, r.toxic): (r.kept, r.n) for r in rows}
    print(of)
    assert of[1, 0][0] > 0.99 * of[1, 0][1]
    toxic = [sum(x) for x in zip(*(v for (_, t), v in of.items() if t), strict=True)]
    assert toxic[0] <= 0.1 * toxic[1]
    assert of[0, 0][0] < 0.2 * of[0, 0][1]
