import random
import re

import pytest
from pyspark.sql import functions as F

from tessera.operators import contacts, ranges, segments, split
from tessera.plans.pipelines import CorrectConfig, mismatches


def hist(spark, rows_, res=10):
    return spark.createDataFrame([("c", res, a, b, n) for a, b, n in rows_], "contig_id string, res int, a int, b int, cnt long")


@pytest.mark.parametrize("counts, percent, sat", [([1, 2, 3, 4], 0.5, 2.5), ([1, 2, 3, 4], 0.95, 4.0), ([1, 2, 3, 4], 0.1, 1.0), ([7], 0.5, 7.0), ([], 0.5, -1.0)])
def test_saturation(spark, rows, counts, percent, sat):
    bins = [(0, 10 * (i + 1), n) for i, n in enumerate(counts)] + [(0, 0, 99)]
    assert rows(contacts.saturation(hist(spark, bins), percent), "sat") == [(sat,)]


def test_histogram_keeps_direction(spark, rows):
    r = spark.createDataFrame([(1, 5, 27), (1, 27, 5), (1, 9, 21)], "contig_id int, pos int, next_pos int")
    assert rows(contacts.contact_histogram(r, [10, 25])) == [(1, 10, 0, 20, 2), (1, 10, 20, 0, 1), (1, 25, 0, 0, 1), (1, 25, 0, 25, 1), (1, 25, 25, 0, 1)]


def test_spanning_score(spark, rows):
    sat = spark.createDataFrame([("c", 10, 3.9)], "contig_id string, res int, sat double")
    assert rows(contacts.spanning_score(hist(spark, [(0, 30, 5), (0, 10, 9), (30, 0, 9)]), sat, 10, 100), "pos", "score") == [(10, 3.0), (20, 3.0)]


def test_grid(spark, rows):
    score = spark.createDataFrame([("c", 100, 1.0), ("c", 1800, 1.0), ("c", 700, 4.0)], "contig_id string, pos int, score double")
    got = rows(contacts.score_grid(score, 100, 400), "pos", "score")
    assert [p for p, _ in got] == list(range(300, 1700, 100))
    assert dict(got)[700] == 4.0


def test_wide_regions(spark, rows):
    grid = spark.createDataFrame([("c", p, 0.0 if p in (20, 30, 60) else 9.0) for p in range(10, 70, 10)], "contig_id string, pos int, score double")
    sat = spark.createDataFrame([("c", 10, 2.0)], "contig_id string, res int, sat double")
    assert rows(segments.wide_regions(grid, sat, 0.5, 10, 40), "a", "b") == [(20, 40), (60, 70)]


def lowest_cells(regions, grid, bin_size):
    """By definition, region after region: what one takes of the grid is gone for the next."""
    left, score, least, cells = list(grid), dict(grid), 0.0, []
    for a, b in regions:
        end = next((i for i, (p, _) in enumerate(left) if p >= b), None)
        mine, left = (left, []) if end is None else (left[: end + 1], left[end + 1 :])
        at = max((i for i, (p, _) in enumerate(mine) if p <= a), default=None)
        least = min([v for _, v in mine[at or 0 :]] + ([least] if at is None else []))
        cells += [(i, i + bin_size) for i in range(a, b, bin_size) if score.get(i) == least]
        if end is None:
            break
    return cells


def joined(cells):
    merged = []
    for a, b in cells:
        if merged and merged[-1][1] == a:
            merged[-1] = (merged[-1][0], b)
        else:
            merged.append((a, b))
    return merged


@pytest.mark.parametrize("cells", [1, 10, 4_096])
def test_narrow_regions_against_the_definition(spark, rows, cells):
    random.seed(9)
    regions, grid, want = [], [], {}
    for c in range(40):
        points = list(range(0, 800, 10)) if c % 3 == 0 else list(range(random.choice([0, 60, 150, 390]), random.choice([400, 530, 800]), 10))
        own = [(p, float(random.randint(0, 3))) for p in points] if c % 13 else []
        cuts = sorted(random.sample(range(1, 19), 2 * random.randint(1, 5)))
        wide = [(a * 40, b * 40) for a, b in zip(cuts[::2], cuts[1::2], strict=True)]
        regions += [(c, *w) for w in wide]
        grid += [(c, *g) for g in own]
        want[c] = joined(lowest_cells(wide, own, 10)) or wide
    got = {}
    made = segments.narrow_regions(spark.createDataFrame(regions, "contig_id int, a int, b int"), spark.createDataFrame(grid, "contig_id int, pos int, score double"), 10, cells=cells)
    for c, a, b in rows(made, "contig_id", "a", "b"):
        got.setdefault(c, []).append((a, b))
    assert got == want


@pytest.mark.parametrize("cells", [1, 10, 4_096])
def test_regions_that_ranges_cut(spark, rows, cells):
    random.seed(10)
    sat = spark.createDataFrame([(c, 10, 2.0 if c else -1.0) for c in range(6)], "contig_id int, res int, sat double")
    points = [(c, p, float(random.random() < 0.15) * 99) for c in range(6) for p in range(50 * c, 900, 10)]
    want = []
    for c in range(1, 6):
        own = [(p, s < 6) for k, p, s in points if k == c]
        low = [p for p, below in own if below]
        starts = [p for p in low if (p - 10, True) not in own]
        want += [(c, a, next((p for p, below in own if p > a and not below), own[-1][0] + 10)) for a in starts]
    grid = spark.createDataFrame(points, "contig_id int, pos int, score double")
    assert rows(segments.wide_regions(grid, sat, 0.5, 10, 40, cells=cells), "contig_id", "a", "b") == sorted(want)


def test_no_task_scans_a_whole_contig(spark):
    """Windows by contig alone see one row a range: their input is an aggregate by contig and range."""
    grid = spark.createDataFrame([(1, p, 1.0) for p in range(0, 100, 10)], "contig_id int, pos int, score double")
    for df in (ranges.running(grid, ["contig_id"], "pos", 50, F.col("score"), F.sum, "s"), ranges.neighbours(grid, ["contig_id"], "pos", 50, before=["score"])):
        plan = df._jdf.queryExecution().optimizedPlan().toString().splitlines()
        at = [i for i, line in enumerate(plan) if re.search(r"windowspecdefinition\(contig_id#\d+L?, range_#\d+L? ASC", line)]
        assert at and all(any("Aggregate [contig_id#" in below and "range_#" in below for below in plan[i + 1 : i + 3]) for i in at)
        assert all("range_#" in line for line in plan if "windowspecdefinition" in line)


def test_split(spark, rows):
    seq = "".join(chr(65 + i % 26) for i in range(100))
    contigs = spark.createDataFrame([(0, "x", seq), (1, "y", "ACGT"), (2, "z", "ACGTACGT")], "id int, name string, seq string")
    cuts = spark.createDataFrame([(0, 41, 61), (2, 3, 20)], "contig_id int, a int, b int")
    assert rows(split.split_sequences(contigs, cuts), "name", "seq") == sorted(
        [("x_1_40", seq[:40]), ("x_41_60", seq[40:60]), ("x_60_100", seq[60:]), ("y", "ACGT"), ("z_1_2", "AC"), ("z_3_19", "GTACGT")]
    )


def test_mismatch_found_between_two_blocks(spark):
    random.seed(1)
    records = []
    for low in (0, 600_000):
        for _ in range(30_000):
            a = low + random.randint(0, 599_000)
            b = min(low + 599_999, a + random.randint(1_000, 90_000))
            records.append((0, a, b))
    found = mismatches(spark.createDataFrame(records, "contig_id int, pos int, next_pos int"), CorrectConfig(sensitivity=0.2))
    got = [(r.a, r.b) for r in found.collect()]
    assert got and all(520_000 <= a < b <= 680_000 for a, b in got)
    assert CorrectConfig(wide=30_000).warnings
