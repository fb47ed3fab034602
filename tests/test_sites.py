import random
import re

from tessera.operators import align, motif


def model_windows(positions, half, n):
    out = []
    for p in positions:
        s, e = max(0, p - half), min(p + half, n)
        if out and s <= out[-1][1]:
            out[-1][1] = max(e, out[-1][1])
        else:
            out.append([s, e])
    return [tuple(x) for x in out]


def test_sites_do_not_overlap_and_keep_case(spark, rows):
    contigs = spark.createDataFrame([(0, "AAAA"), (1, "gatcGATC"), (2, ""), (3, None)], "id int, seq string")
    assert rows(motif.sites(contigs, "AA"), "contig_id", "pos") == [(0, 0), (0, 2)]
    assert rows(motif.sites(contigs, "GATC"), "contig_id", "pos") == [(1, 4)]
    assert rows(motif.sites(contigs, "GATC", ignore_case=True), "contig_id", "pos") == [(1, 0), (1, 4)]
    assert rows(motif.contig_sites(contigs, "AA")) == [(0, 2), (1, 0), (2, 0), (3, 0)]


def test_windows_merge(spark, rows):
    found = spark.createDataFrame([(1, p, 100) for p in (5, 20, 95)], "contig_id int, pos int, length int")
    windows = motif.site_windows(found, 10)
    assert rows(windows) == [(1, 0, 30), (1, 85, 100)]
    probes = spark.createDataFrame([(1, 30), (1, 31), (1, 85), (1, 100), (2, 5)], "ref_id int, pos int")
    assert rows(align.positions_in_windows(probes, windows, bucket=16)) == [(1, 30), (1, 85), (1, 100)]


def test_windows_against_model(spark):
    random.seed(3)
    seqs = ["".join(random.choices("ab", k=random.randint(0, 60))) for _ in range(60)]
    contigs = spark.createDataFrame(list(enumerate(seqs)), "id int, seq string")
    got = {}
    for c, s, e in motif.site_windows(motif.sites(contigs, "ab"), 4).collect():
        got.setdefault(c, []).append((s, e))
    for i, seq in enumerate(seqs):
        assert sorted(got.get(i, [])) == model_windows([m.start() for m in re.finditer("ab", seq)], 4, len(seq))


def test_filters(spark, rows):
    records = spark.createDataFrame([("a", 1, "a", 2, 255), ("a", 1, "b", 2, 50), ("a", 1, "a", None, 50), ("a", 1, "a", -1, 50), ("a", 3, "a", 4, 1)], "ref_name string, pos int, next_ref_name string, next_pos int, mapq smallint")
    assert align.quality_filter(records, 40).count() == 3
    assert rows(align.same_contig_filter(records, 1), "pos", "mapq") == [(1, 255), (3, 1)]
    contigs = spark.createDataFrame([("a", 0), ("b", 1), ("a", 2)], "name string, id int")
    assert rows(align.named_to_ids(records.where("mapq = 50"), contigs), "ref_id", "next_ref_id") == [(0, 0), (0, 0), (0, 1)]
    ids = spark.createDataFrame([(0, 1), (1, 2)], "ref_id int, next_ref_id int")
    assert rows(align.without_contigs(ids, spark.createDataFrame([(2,)], "contig_id int")), "ref_id", "next_ref_id") == [(0, 1)]
    counts = spark.createDataFrame([(0, 3), (1, 0)], "contig_id int, n_sites long")
    assert rows(motif.invalid_contigs(counts, 1)) == [(1,)]
    assert rows(motif.invalid_contigs(counts, -5)) == []


def test_windows_where_a_sequence_is(spark, rows):
    rng = random.Random(4)
    seqs = ["".join(rng.choices("ACGTacgt", k=rng.randint(0, 400))) for _ in range(60)] + ["", None, "ACAC", "éACéACAC" * 30, "AC" * 20_000]
    contigs = spark.createDataFrame(list(enumerate(seqs)), "id int, seq string")
    for m, reach, any_case in (("AC", 5, False), ("ac", 0, True), ("GT", 40, True), ("TTT", 3, False)):
        want = rows(motif.site_windows(motif.sites(contigs, m, any_case), reach))
        assert rows(motif.windows_around_sites(contigs, m, reach, any_case)) == want
