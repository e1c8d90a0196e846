"""The log-normal model of forward and reverse fragments against plain Python."""

import math
import random

import pytest

from loomgrid.operators import bipartite as B
from loomgrid.operators import locate as L


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    fragments, at = [], 1000
    for k in range(40):
        at += rng.randrange(2_000, 9_000) + (60_000 if k == 20 else 0)
        fragments.append((k, "a", "+" if rng.random() < 0.5 else "-", at))
    true = {k: rng.uniform(-0.3, 0.8) for k, *_ in fragments}
    contacts = []
    for i, _, s, p in fragments:
        for j, _, t, q in fragments:
            if i < j and rng.random() < 0.8:
                n = round(math.exp(true[i] + true[j] + 9 - 0.6 * math.log(q - p) + rng.gauss(0, 0.2)))
                if n:
                    contacts.append((i, j, n))
    return fragments, contacts, true


@pytest.fixture(scope="module")
def tables(spark, rows):
    fragments = L.regions(spark.createDataFrame(rows[0], "id long, chr string, strand string, mid long"), 50_000, tile=20_000)
    return fragments, spark.createDataFrame(rows[1], "id1 long, id2 long, n long")


def test_regions_across_tiles(tables, rows):
    got = {r.id: r.region for r in tables[0].collect()}
    assert got == {k: int(k >= 20) for k, *_ in rows[0]}


def test_costs_fall_and_corrections_are_found(tables, rows):
    fragments, contacts = tables
    met = B.meeting(contacts, fragments)
    line = B.distance_line(met)
    found, costs = B.fit_corrections(met, line, 25, 1e-4, precalculate=True)
    assert len(costs) > 3 and all(b < a for a, b in zip(costs, costs[1:], strict=False))
    c = {r.id: r.c for r in found.collect()}
    true = {k: rows[2][k] for k in c}
    mc, mt = sum(c.values()) / len(c), sum(true.values()) / len(true)
    r = sum((c[k] - mc) * (true[k] - mt) for k in c) / math.sqrt(sum((x - mc) ** 2 for x in c.values()) * sum((x - mt) ** 2 for x in true.values()))
    assert r > 0.9


def test_regions_are_centred(tables, rows):
    fragments, _ = tables
    centred = B.recentred_regions(fragments.selectExpr("*", "id / 10D as c")).collect()
    for region in (0, 1):
        f, b = ([r.c for r in centred if r.region == region and r.strand == s] for s in "+-")
        assert abs(sum(x + y for x in f for y in b)) < 1e-9


def test_heatmap_lists_unlike_strands(tables, rows):
    fragments, contacts = tables
    line = {"slope": -0.7, "intercept": 2.0, "sigma": 1.0}
    centred = fragments.selectExpr("*", "id / 50D as c", "0.25D as region_mean")
    size, got = 16_000, {}
    for r in B.region_heatmap(contacts, centred, size, line).collect():
        got[r.region, r.bin1, r.bin2] = (r.observed, r.expected)
    placed = {r.id: r for r in fragments.collect()}
    origin = {g: min(r.mid for r in placed.values() if r.region == g) // size * size for g in (0, 1)}
    n = {(i, j): k for i, j, k in rows[1]}
    want = {}
    for a in placed.values():
        for b in placed.values():
            if a.region == b.region and a.strand != b.strand and a.mid < b.mid:
                cell = (a.region, (a.mid - origin[a.region]) // size, (b.mid - origin[a.region]) // size)
                if cell[1] < cell[2]:
                    o, e = want.get(cell, (0, 0.0))
                    want[cell] = (o + n.get((a.id, b.id), 0), e + math.exp((a.id + b.id) / 50 + 0.25 + 2.0 - 0.7 * math.log(b.mid - a.mid)))
    assert got.keys() == want.keys()
    assert all(got[k][0] == want[k][0] and math.isclose(got[k][1], want[k][1], rel_tol=1e-7) for k in want)
