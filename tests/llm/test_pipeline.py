import random
import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tessera.llm import queries
from tessera.llm.neardup import near_duplicates
from tessera.llm.quality import classify
from tessera.llm.text import hf_tokenizer, vocabulary

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """The input and the result of each stage."""
    docs, out = spark.read.parquet(f"{DATA}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp(name) / "out")
        stage(spark, docs, DATA).write.parquet(path)
        out.append((docs, spark.read.parquet(path)))
        docs = out[-1][1]
    return dict(zip([n for n, _ in corpus_pipeline.STAGES], out, strict=True))


def test_columns(stages):
    for name, (docs, left) in stages.items():
        if name != "packing":
            assert left.columns == docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]


def ids(df):
    return {r.doc_id for r in df.select("doc_id").collect()}


def test_quality_and_near_duplicates(spark, stages):
    docs, left = stages["quality"]
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    assert ids(left) == {r.doc_id for r in classify(docs, labels).collect() if r.kept}
    good, toxic = ids(labels.where("quality = 1 AND toxic = 0")), ids(labels.where("toxic = 1"))
    assert len(ids(left) & good) >= 0.95 * len(ids(docs) & good)
    # Four of the eleven toxic texts have no word that tells; six go.
    assert len(ids(left) & toxic) <= 0.5 * len(ids(docs) & toxic)
    docs, left = stages["near_duplicates"]
    assert ids(left) == {r.doc_id for r in near_duplicates(docs).collect() if r.kept} and len(ids(left)) < len(ids(docs))


def test_no_benchmark_window_is_left(spark, stages):
    _, left = stages["benchmarks"]
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]+", lambda m: m[0].lower(), t or ""))
    before = {r.doc_id: words(r.text) for r in stages["benchmarks"][0].collect()}
    after = {r.doc_id: words(r.text) for r in left.collect()}
    windows = set()
    for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect():
        w = words(r.text)
        windows |= {tuple(w[i : i + 10]) for i in range(max(1, len(w) - 9))}
    hit = {k for k, w in before.items() if any(tuple(w[i : i + 10]) in windows for i in range(len(w) - 9))}
    assert all(after[k] == w for k, w in before.items() if k not in hit)
    assert all(len(after.get(k, [])) < len(before[k]) for k in hit)


def test_packing_holds_every_id(stages):
    docs, left = stages["packing"]
    encoder = hf_tokenizer(vocabulary("byte_bpe_50k.json"))
    own = {}
    for r in left.collect():
        own.setdefault(r.doc_id, []).append((r.start, r.ids))
    for r in random.Random(0).sample(docs.collect(), 20):
        assert [i for _, x in sorted(own[r.doc_id]) for i in x] == [*encoder.encode(r.text, add_special_tokens=False).ids, 0]


def test_every_operator_has_a_query():
    assert [sum(n.startswith(f"op{k}_") for n in queries.QUERIES) for k in range(1, 11)] == [1] * 10
    assert set(queries.ORACLE) <= set(queries.QUERIES)


@pytest.fixture
def small(spark, tmp_path):
    """A folder of tables with nulls, empty and very long texts, repeated rows and ids, and columns that operators name themselves."""
    rng = random.Random(20)
    vocabulary = [f"word{i}" for i in range(900)]
    prose = lambda n: " ".join(rng.choices(vocabulary, k=n))
    item, passage = prose(30), prose(70)
    docs = [(i, prose(rng.randint(20, 120)), rng.choice(["en", "de", None]), rng.choice(["a", "b", None])) for i in range(60)]
    docs += [(100, docs[3][1], "en", "a"), (100, docs[3][1], "en", "a"), (7, prose(80), "en", "a"), (7, docs[9][1], None, None), (None, docs[4][1], "en", "b")]
    docs += [(101, None, "en", "a"), (102, "", None, None), (103, " \n ", "en", "a"), (None, None, None, None), (104, prose(30_000), "en", "a"), (104, None, "en", "a")]
    docs += [(200 + i, f"{prose(40)} {passage} {prose(40)}", "en", "b") for i in range(3)] + [(210, f"{prose(40)}. {item}! {prose(40)}", "en", "a"), (211, item, "en", "a")]

    def of(rows, name):
        folder = str(tmp_path / name)
        df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").selectExpr("*", "cast(length(text) as bigint) AS n_chars", "1 AS key", "'r' AS row_", "2 AS id_", "array(3) AS spans_", "'k' AS key_", "0 AS doc_", "'x' AS kept", "'m' AS mark_")
        df.write.parquet(f"{folder}/documents.parquet")
        labels = [(i, 1, 0) for i in range(40)] + [(None, 1, 0), (3, None, None), (3, 1, 0)]
        spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
        spark.createDataFrame([(1, item), (2, None), (None, ""), (3, item)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
        return folder

    return of, docs, item, passage


def test_stages_with_awkward_rows(spark, small):
    of, docs, item, passage = small
    folder = of(docs, "awkward")
    given = spark.read.parquet(f"{folder}/documents.parquet")
    left, seen = given, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        path = f"{folder}/{name}"
        stage(spark, left, folder).write.parquet(path)
        left = spark.read.parquet(path)
        assert left.columns == given.columns
        seen[name] = left.select("doc_id", "text").collect()
    count = lambda name, key: sum(r.doc_id == key for r in seen[name])
    assert all(count("quality", k) == 0 for k in (101, 102, 103)) and count("quality", 100) == 2 and count("quality", None) == 1
    # 100 is a copy of 3 and one row of 7 of 9; texts of no id stay.
    assert count("near_duplicates", 100) == 0 and count("near_duplicates", 3) == 1
    assert sorted(r.text for r in seen["near_duplicates"] if r.doc_id == 7) == sorted(t for k, t, _, _ in docs if k == 7)
    assert count("near_duplicates", 9) == 0 and count("near_duplicates", None) == 1
    assert sum(passage in r.text for r in seen["near_duplicates"]) == 3 and sum(passage in r.text for r in seen["substrings"]) == 1
    assert not any(item in r.text for r in seen["benchmarks"]) and count("benchmarks", 210) == 1
    # 211 is the item, whose first 29 words repeat in 210, where its last one has a mark: that one word is left, and no window.
    assert [r.text.split() for r in seen["benchmarks"] if r.doc_id == 211] == [item.split()[-1:]]
    packed = corpus_pipeline.run(spark, folder).groupBy("doc_id", "doc_tokens").agg(F.sum("length").alias("n")).collect()
    assert sum(r.n // r.doc_tokens for r in packed) == len(seen["benchmarks"])


def test_stages_without_rows(spark, small):
    of, docs, *_ = small
    folder = of([], "empty")
    assert corpus_pipeline.run(spark, folder).count() == 0
