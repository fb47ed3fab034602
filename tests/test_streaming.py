import random

import pytest

from tessera.operators import pairing as P
from tessera.streaming import contacts as S
from tessera.streaming import pairing as SP

SCHEMA = "file string, rec_no long, ref_id int, pos int, next_ref_id int, next_pos int"


def test_streams_give_the_batch_results(spark, tmp_path, rows):
    pairs = spark.createDataFrame([("2024-01-01 00:00:01", 0, 1), ("2024-01-01 00:00:02", 1, 0), ("2024-01-01 00:00:11", 2, 2)], "ts string, ref_id int, next_ref_id int").selectExpr("cast(ts AS timestamp) AS ts", "ref_id", "next_ref_id")
    pairs.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(pairs.schema).parquet(str(tmp_path / "in"))
    for name, df in (("edges_so_far", S.streaming_edge_counts(stream)), ("edges_by_time", S.windowed_edge_counts(stream, "ts", "10 seconds", "1 minute"))):
        df.writeStream.format("memory").queryName(name).outputMode("complete").start().processAllAvailable()
    assert rows(spark.table("edges_so_far")) == [(0, 1, 2), (2, 2, 1)]
    assert rows(spark.table("edges_by_time"), "start", "end", "n") == [(0, 1, 2), (2, 2, 1)]
    for q in spark.streams.active:
        q.stop()
    records = spark.createDataFrame([(1, 5, 27), (1, 5, 28)], "contig_id int, pos int, next_pos int")
    records.write.parquet(str(tmp_path / "rec"))
    stream = spark.readStream.schema(records.schema).parquet(str(tmp_path / "rec"))
    S.streaming_histogram(stream, [10]).writeStream.format("memory").queryName("hist").outputMode("complete").start().processAllAvailable()
    assert rows(spark.table("hist"), "a", "b", "cnt") == [(0, 20, 2)]
    for q in spark.streams.active:
        q.stop()


def mates(seed, n, places):
    """Records of two files among few positions, many at one and half answering earlier ones, and what the fold makes of each file."""
    rng = random.Random(seed)
    records, want = [], []
    for file in "ab":
        made = []
        for _ in range(n):
            new = tuple((0, 0) if rng.random() < 0.2 else (rng.randrange(2), rng.randrange(places)) for _ in "sd")
            made.append(rng.choice(made)[::-1] if made and rng.random() < 0.5 else new)
        records.append([(file, k, *s, *d) for k, (s, d) in enumerate(made)])
        want += [(*s, *d) for s, d in P.fold(made)]
    return records, sorted(want)


@pytest.mark.parametrize(("seed", "cuts", "tail"), [(1, [7, 8, 60], 0), (2, [40], P.TAIL), (3, [], 0)])
def test_mates_over_any_cut_are_those_of_the_batch(spark, tmp_path, rows, seed, cuts, tail):
    (a, b), want = mates(seed, 120, 40)
    assert len(want) > 10
    ends = [0, *cuts, 120]
    folder, source = str(tmp_path / "out"), str(tmp_path / "in")
    schema = spark.createDataFrame([], SCHEMA).schema
    for k, (i, j) in enumerate(zip(ends, ends[1:], strict=False)):
        part = a[i:j] + b[i:j]
        random.Random(k).shuffle(part)
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(source)
        # Each is a start from the checkpoint of the one before.
        query = SP.pair_stream(spark.readStream.schema(schema).parquet(source), folder, tail).trigger(availableNow=True).start()
        query.awaitTermination()
    assert rows(SP.streamed_pairs(spark, folder, schema)) == want
    if not cuts:
        assert rows(P.mate_pairs(spark.createDataFrame(a + b, schema), 0)) == want


def test_a_batch_run_again_changes_nothing(spark, tmp_path, rows):
    (a, b), want = mates(4, 60, 20)
    fold, folder = SP._fold(str(tmp_path), 0), str(tmp_path)
    schema = spark.createDataFrame([], SCHEMA).schema
    first, second = (spark.createDataFrame(x, schema) for x in (a[:30] + b[:30], a[30:] + b[30:] + [("a", 60, None, None, None, None), ("a", 61, None, None, None, None), ("a", 62, 0, 1, None, 2)]))
    for df, batch in ((first, 0), (first, 0), (second, 1), (second, 1), (second.limit(0), 2)):
        fold(df, batch)
    assert rows(SP.streamed_pairs(spark, folder, schema)) == want
