"""Sums over all possible pairs against lists of the pairs."""

import math
import random

import pytest
from pyspark.sql import functions as F

from loomgrid.operators import models as Mo
from loomgrid.operators import pair_sums as P


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(7)
    spread = [("a", rng.randrange(120_000), rng.uniform(0.5, 2)) for _ in range(150)]
    crowd = [("b", 40_000 + rng.randrange(300), rng.uniform(0.5, 2)) for _ in range(40)] + [("b", 0, 1.0), ("b", 99_999, 1.5), ("b", 99_999, 2.0)]
    return spread + crowd + [("alone", 5, 1.0)]


@pytest.fixture(scope="module")
def elements(spark, rows):
    return spark.createDataFrame(rows, "chr string, pos long, w double")


def pairs(rows):
    return [(a, b) for a in rows for b in rows if a[0] == b[0] and a[1] < b[1]]


CUTS = [500.0, 2_000.0, 9_000.0, 30_000.0, 130_000.0]


@pytest.mark.parametrize("base", [250, 1000])
def test_curve(spark, elements, rows, base):
    contacts = spark.createDataFrame([("a", 10, "a", 600, 3), ("a", 2_000, "a", 0, 2), ("a", 7, "a", 7, 9), ("a", 5, "b", 900, 1)], "chr1 string, pos1 long, chr2 string, pos2 long, n long")
    want = {}
    for a, b in pairs(rows):
        d = b[1] - a[1]
        if d > 300:
            x = want.setdefault(sum(c < d for c in CUTS), [0, 0.0])
            x[0] += 1
            x[1] += math.log(d)
    gone = P.pairs_within(elements, 300, ("pos",))
    got = {r.dbin: r for r in P.distance_curve(contacts, elements, CUTS, base, gone).collect()}
    assert {k: r.pairs for k, r in got.items()} == {k: x[0] for k, x in want.items()}
    assert all(math.isclose(got[k].sum_log, x[1], rel_tol=1e-9) for k, x in want.items())
    assert (got[1].total, got[1].seen) == (5.0, 2) and sum(r.seen for r in got.values()) == 2


@pytest.mark.parametrize(("reach", "halvings"), [(None, 4), (6, 0), (None, 2)])
def test_expected_cells(spark, elements, rows, reach, halvings):
    size = 4_000
    lines = [(-0.4, 1.0, 800.5), (-1.3, 7.0, 20_000.5), (-0.9, 3.0, None)]
    fitted = spark.createDataFrame([(k, s, i, math.log(u) if u else None) for k, (s, i, u) in enumerate(lines)], "dbin int, slope double, intercept double, upto double")
    means = spark.createDataFrame([("a", 0.3)], "chr string, mean double")
    want = {}
    for a, b in pairs(rows):
        d, cell = b[1] - a[1], (a[0], a[1] // size, b[1] // size)
        if cell[1] == cell[2] or d <= 100 or (reach is not None and cell[2] - cell[1] > reach):
            continue
        s, i, _ = next(x for x in lines if x[2] is None or d <= x[2])
        want[cell] = want.get(cell, 0) + a[2] * b[2] * math.exp(s * math.log(d) + i + (0.3 if a[0] == "a" else 0))
    got = P.expected_cells(elements, size, fitted, means, reach, halvings, P.pairs_within(elements, 100, ("pos", "w"))).where("abs(expected) > 1e-12").collect()
    assert {(r.chr, r.bin1, r.bin2) for r in got} == set(want)
    assert max(abs(r.expected / want[r.chr, r.bin1, r.bin2] - 1) for r in got) < 1e-8


def test_expected_without_lines(elements, rows):
    want = {}
    for a, b in pairs(rows):
        cell = (a[0], a[1] // 5000, b[1] // 5000)
        if cell[1] < cell[2] <= cell[1] + 3:
            want[cell] = want.get(cell, 0) + a[2] * b[2]
    got = {(r.chr, r.bin1, r.bin2): r.expected for r in P.expected_cells(elements, 5000, reach=3).collect()}
    assert got.keys() == want.keys() and all(math.isclose(got[k], want[k]) for k in want)


def test_work_grows_with_elements_and_not_with_pairs():
    """Offsets that are summed pair by pair are as many as the cutoffs ask for, however long the chromosome."""
    cuts = Mo.log_cutoffs(1000, 2e8, 90)
    per_level = {}
    for level, odd, offset, _, series in P.summing_plan(range(9), 14, 2000, cuts, P.log_series):
        per_level.setdefault((level, series is None), set()).add(offset)
    assert max(map(len, per_level.values())) <= 8 * 90


def test_recentred(spark):
    rows = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("a", 4.0), ("b", 3.0)], "chr string, c double")
    got = P.recentred_pairwise(rows).groupBy("chr").agg(F.collect_list("c").alias("c"), F.first("mean").alias("mean")).collect()
    for r in got:
        if r.chr == "b":
            assert r.c == [1.0] and math.isclose(r.mean, math.log(9))
        else:
            assert math.isclose(sum(x * y for x in r.c for y in r.c if x != y) / 6, 1.0) and math.isclose(math.exp(r.mean), 28 / 6)


def test_nothing_in_nothing_out(spark, elements):
    none = elements.limit(0)
    assert P.expected_cells(none, 4000).count() == 0
    contacts = spark.createDataFrame([], "chr1 string, pos1 long, chr2 string, pos2 long, n long")
    assert P.distance_curve(contacts, none, CUTS, 250).count() == 0
