"""What only larger tables bring about, on small ones made for it."""

import math
import random

import pytest
from pyspark.sql import functions as F

from loomgrid.functions import alignments as Al
from loomgrid.operators import bipartite as B
from loomgrid.operators import intervals as I
from loomgrid.operators import matrix as M
from loomgrid.operators import pair_sums as P
from loomgrid.operators import random as R


def test_correlation_without_spread(spark):
    """A distance at which all cells have the same value is not an error."""
    a = spark.createDataFrame([("a", k, k + d, k + 1 if d == 1 else 5) for k in range(4) for d in (1, 2)], "chr string, bin1 long, bin2 long, obs long")
    got = {r.dbin: r for r in M.correlation_by_distance(a, a, F.col("bin2") - F.col("bin1")).collect()}
    assert got[1].n == got[2].n == 4 and math.isclose(got[1].r, 1.0) and math.isnan(got[2].r)


def test_whole_steps(spark):
    """Steps that are taken whole are taken past the least cost too."""
    met = spark.createDataFrame([(1, 2, 2, "a", 0, 0, 10)], "id1 long, id2 long, n long, chr string, region int, mid1 long, mid2 long")
    line = {"slope": 0.0, "intercept": 0.0, "sigma": 0.03}
    found, costs = B.fit_corrections(met, line, 2, 0.0, step=0.002, whole=True)
    # Both ends are as far off; no mass is left around the count, so that the square stands for it.
    c = 0.0
    for _ in range(2):
        c -= 0.002 * (max(B.LOWEST, 2 * c) - math.log(2)) / 0.03**2
    assert all(math.isclose(r.c, c, rel_tol=1e-9) for r in found.collect()) and len(costs) == 3 and costs[1] > costs[0]


def test_overlaps_past_a_long(spark):
    """Overlaps of a sample whose square no long holds."""
    rows = spark.createDataFrame([("a", 0, 4_000_000_000, k) for k in range(2)], "chr string, start long, end long, id long")
    features = spark.createDataFrame([("a", 0, 10_000_000_000)], "chr string, start long, end long")
    lengths = spark.createDataFrame([("a", 10_000_000_000)], "chr string, length long")
    got = R.overlap_z_score(rows, features, lengths, features.where("false"), 3, 1).first()
    assert got.observed == 8_000_000_000 and got.mean == 8e9 and got.deviation == 0


def test_threaded_blocks(spark):
    """Whatever the texts hold: letters of several bytes, gaps in all, shorter and missing ones."""
    component = "struct<src:string,start:bigint,size:bigint,strand:string,src_size:bigint,text:string>"
    texts = [("A--C", "G--T"), ("", ""), ("é-\U0001f600-", "--x-"), ("A-C", "T-"), ("--", None), ("-A", "--")]
    rows = [(k, [("o.c", 0, 1, "+", 9, "N"), ("a.c", 0, 1, "+", 9, a), ("b.c", 0, 1, "+", 9, b)]) for k, (a, b) in enumerate(texts)]
    df = spark.createDataFrame([*rows, (9, [("a.c", 0, 1, "+", 9, "A")])], f"id long, components array<{component}>")
    got = {r.id: tuple(c.text for c in r.components) for r in Al.thread_blocks(df, ["b", "a"]).collect()}
    assert got == {0: ("GT", "AC"), 1: ("", ""), 2: ("-x", "é\U0001f600"), 3: ("T", "A"), 4: (None, None), 5: ("-", "A")}


def _intervals(spark, seed, n):
    rng = random.Random(seed)
    rows = [(rng.choice("ab"), s := rng.randrange(-90, 400), s + rng.randrange(0, 30), k) for k in range(n)]
    return rows, spark.createDataFrame(rows, "chr string, start long, end long, id long")


@pytest.mark.parametrize("mincols", [1, 4])
def test_matched_rows_by_islands(spark, mincols):
    """Sides of an outer join against all pairs; those matched come from far fewer rows than there are pairs."""
    (a, left), (b, right) = _intervals(spark, 1, 90), _intervals(spark, 2, 2000)
    pairs = {(x[3], y[3]) for x in a for y in b if x[0] == y[0] and min(x[2], y[2]) - max(x[1], y[1]) >= mincols}
    want = pairs | {(x[3], None) for x in a if x[3] not in {p for p, _ in pairs}} | {(None, y[3]) for y in b if y[3] not in {p for _, p in pairs}}
    joined = I.outer_join(left, right, mincols, tile=32)
    got = [(r.id, r.id2) for r in joined.collect()]
    assert len(got) == len(set(got)) and set(got) == want
    counted = I.meeting(left, right, mincols, tile=32)
    assert counted.count() < 3 * len(a) < len(pairs) / 5


@pytest.mark.parametrize("direction", ["before", "after"])
def test_nearest_of_many(spark, direction):
    """The nearest of targets that lie close, with ties; what a query meets does not grow with the targets that are near."""
    (a, queries), (b, targets) = _intervals(spark, 3, 60), _intervals(spark, 4, 800)
    want = set()
    for x in a:
        near = [((x[1] - y[2] if direction == "before" else y[1] - x[2]), y[3], y[1], y[2]) for y in b if x[0] == y[0]]
        want |= {(x[3], k + 1, i, s, e, d) for k, (d, i, s, e) in enumerate(sorted(r for r in near if 0 <= r[0] <= 20)[:3])}
    found = I.nearest(queries, targets, 3, 20, direction)
    assert {tuple(r) for r in found.collect()} == want
    assert "Join" not in found._jdf.queryExecution().executedPlan().toString()


def test_sparse_bins_are_not_halved(spark):
    """Moments stop at a size whose bins hold a few elements; crowded places are halved on."""
    spread = spark.range(300).select(F.lit("a").alias("chr"), (F.col("id") * 1000).alias("pos"), F.lit(1.0).alias("w"))
    crowd = spark.range(300).select(F.lit("b").alias("chr"), (F.col("id") + 5000).alias("pos"), F.lit(1.0).alias("w"))
    assert P._halvings(spread, 250, 9) == 4 and P._halvings(spread.unionByName(crowd), 250, 9) == 9


@pytest.mark.parametrize("reach", [None, 4])
def test_pairs_of_bins_in_blocks(spark, reach):
    rng = random.Random(5)
    bins = [(c, b, float(b)) for c in "ab" for b in rng.sample(range(25), 15)]
    cells = {(c, x, y): k for k, (c, x, y) in enumerate((c, x, y) for c, x, _ in bins for d, y, _ in bins if c == d and x < y and rng.random() < 0.3)}
    want = {(c, x, y, v, w, cells.get((c, x, y))) for c, x, v in bins for d, y, w in bins if c == d and x < y and (reach is None or y - x <= reach)}
    seen = spark.createDataFrame([(*k, n) for k, n in cells.items()], "chr string, bin1 long, bin2 long, obs long")
    rows = spark.createDataFrame(bins, "chr string, bin long, v double")
    assert {tuple(r) for r in P.pairs_of_bins(rows, "v", reach, seen, block=4).collect()} == want
    assert {tuple(r) for r in P.pairs_of_bins(rows, "v", reach, block=4).collect()} == {r[:5] for r in want}


@pytest.mark.parametrize("fitted", [True, False])
def test_cells_in_blocks(spark, monkeypatch, fitted):
    """Blocks of far cells beside the parts of near ones and of those at the end of a line; excluded pairs lie in both."""
    rng = random.Random(6)
    points = [(c, rng.randrange(60_000), rng.uniform(0.5, 2)) for c in "aab" for _ in range(40)]
    pairs = [(a, b) for a in points for b in points if a[0] == b[0] and a[1] < b[1]]
    gone = [p for p in pairs if rng.random() < 0.02 or p[1][1] - p[0][1] < 500]
    lines = [(-0.4, 1.0, 20_000.5), (-0.9, 5.0, None)]
    want = {}
    for pair in pairs:
        (c, x, v), (_, y, w) = pair
        if pair not in gone and x // 1000 < y // 1000:
            slope, icept, _ = next(q for q in lines if q[2] is None or y - x <= q[2])
            value = v * w * (math.exp(slope * math.log(y - x) + icept) if fitted else 1.0) * (math.exp(0.3) if c == "a" else 1)
            want[c, x // 1000, y // 1000] = want.get((c, x // 1000, y // 1000), 0) + value
    monkeypatch.setattr(P, "MANY", 0)
    elements = spark.createDataFrame(points, "chr string, pos long, w double")
    excluded = spark.createDataFrame([(a[0], a[1], b[1], a[2], b[2]) for a, b in gone], "chr string, pos1 long, pos2 long, w1 double, w2 double")
    seen = spark.createDataFrame([(*k, n) for n, k in enumerate(want) if n % 3], "chr string, bin1 long, bin2 long, obs long")
    table = spark.createDataFrame([(k, s, i, math.log(u) if u else None) for k, (s, i, u) in enumerate(lines)], "dbin int, slope double, intercept double, upto double")
    means = spark.createDataFrame([("a", 0.3)], "chr string, mean double")
    got = P.expected_cells(elements, 1000, table if fitted else None, means, None, 3, excluded, seen=seen).where("abs(expected) > 1e-12").collect()
    rows = {(r.chr, r.bin1, r.bin2): (r.expected, r.obs) for r in got}
    assert len(got) == len(rows) and rows.keys() == want.keys()
    assert max(abs(rows[k][0] / v - 1) for k, v in want.items()) < 1e-7
    assert all(rows[k][1] == (n if n % 3 else None) for n, k in enumerate(want))
