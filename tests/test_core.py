"""Cases by hand and invariants of the core operators, and the text sources."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomgrid.functions import expressions as X
from loomgrid.functions import sequences as S
from loomgrid.operators import contacts as C
from loomgrid.operators import intervals as I
from loomgrid.operators import locate as L
from loomgrid.operators import matrix as M
from loomgrid.operators import models as Mo
from loomgrid.operators import random as Ra
from loomgrid.operators import reads as Re
from loomgrid.sources import sinks, text


def iv(spark, rows):
    return spark.createDataFrame([("c", s, e, k) for k, (s, e) in enumerate(rows)], "chr string, start long, end long, id long")


BASE = [(0, 10), (3, 7), (3, 40), (13, 50)]


@pytest.mark.parametrize("tile", [4, 16, 1 << 16])
def test_overlaps(spark, tile):
    targets = iv(spark, BASE)
    find = lambda s, e: sorted(r.id2 for r in I.overlap_join(iv(spark, [(s, e)]), targets, tile=tile).collect())
    assert find(2, 5) == [0, 1, 2] and find(30, 50) == [2, 3] and find(100, 200) == [] and find(10, 13) == [2]


def test_nearest_and_strands(spark):
    targets = iv(spark, BASE)
    before = lambda s, e, n=1: [(r.start2, r.end2) for r in I.nearest(iv(spark, [(s, e)]), targets, n, 2500, "before").orderBy("rank").collect()]
    assert before(10, 20) == [(0, 10)] and before(5, 20) == [] and before(9, 20, 3) == [(3, 7)]
    q = spark.createDataFrame([("c", 11, 12, 1, "+"), ("c", 11, 12, 2, "-")], "chr string, start long, end long, id long, strand string")
    got = {r.id: (r.start2, r.end2) for r in I.upstream(q, targets).collect()}
    assert got == {1: (0, 10), 2: (13, 50)}


@pytest.mark.parametrize(("gap", "least", "want"), [(0, 1, [(1, 2, [1]), (3, 8, [3, 4]), (6, 7, None), (9, 10, [2])]), (2, 2, [(1, 10, [0, 1, 2, 3, 4])])])
def test_clusters(spark, gap, least, want):
    rows = spark.createDataFrame([("c", 6, 7, 0), ("c", 1, 2, 1), ("c", 9, 10, 2), ("c", 3, 4, 3), ("c", 3, 8, 4)], "chr string, start long, end long, id long")
    got = sorted((r.start, r.end, list(r.ids)) for r in I.cluster(rows, gap, least).collect())
    if gap == 0:
        assert got == [(1, 2, [1]), (3, 8, [0, 3, 4]), (9, 10, [2])]
    else:
        assert got == want


@pytest.mark.parametrize("tile", [5, 1 << 16])
def test_set_algebra_against_positions(spark, tile):
    rng = np.random.default_rng(tile)
    a = [(int(s), int(s + n)) for s, n in zip(rng.integers(0, 90, 20), rng.integers(0, 15, 20), strict=True)]
    b = [(int(s), int(s + n)) for s, n in zip(rng.integers(0, 90, 12), rng.integers(1, 9, 12), strict=True)]
    cover = lambda rows: {p for s, e in rows for p in range(s, e)}
    spans = lambda df: sorted((r.start, r.end) for r in df.collect())
    da, db = iv(spark, a), iv(spark, b)
    merged = spans(I.merge(da, tile))
    assert cover(merged) == cover(a) and all(x[1] < y[0] for x, y in zip(merged, merged[1:], strict=False))
    lengths = spark.createDataFrame([("c", 95), ("d", 7)], "chr string, length long")
    gaps = I.complement(da, lengths).collect()
    assert cover([(r.start, r.end) for r in gaps if r.chr == "c"]) == set(range(95)) - cover(a)
    assert [(r.start, r.end) for r in gaps if r.chr == "d"] == [(0, 7)]
    left = {r.id: 0 for r in da.collect()}
    for r in I.subtract(da, db, tile=tile).collect():
        left[r.id] += r.end - r.start
    assert left == {k: len(cover([x]) - cover(b)) for k, x in enumerate(a)}
    got = {r.id: r.bases for r in I.coverage(da, db, tile=tile).collect()}
    assert got == {k: len(cover([x]) & cover(b)) for k, x in enumerate(a)}


def test_windows(spark):
    rows = iv(spark, [(0, 10), (20, 23)])
    assert sorted((r.start, r.end) for r in I.windows(rows, 4, 3).collect()) == [(0, 4), (3, 7), (6, 10)]
    assert sorted((r.start, r.end) for r in I.spread_windows(rows, 4).collect()) == [(0, 4), (5, 9)]
    assert sorted((r.start, r.end) for r in I.chunk(rows, 4).collect()) == [(0, 4), (4, 8), (8, 10), (20, 23)]


def test_asof_across_tiles(spark):
    rng = np.random.default_rng(3)
    at = sorted({int(x) for x in rng.integers(0, 1000, 25)})
    pos = [int(x) for x in rng.integers(-20, 1020, 60)]
    t = spark.createDataFrame([("c", a, k) for k, a in enumerate(at)] + [("e", 5, 99)], "chr string, at long, id long")
    p = spark.createDataFrame([(k, "c", x) for k, x in enumerate(pos)] + [(100, "d", 5)], "rid long, chr string, pos long")
    back = {r.rid: r.at for r in L.asof(p, t, "backward", tile=16).collect()}
    ahead = {r.rid: r.at for r in L.asof(p, t, "forward", tile=16).collect()}
    assert back == {k: max((a for a in at if a <= x), default=None) for k, x in enumerate(pos)} | {100: None}
    assert ahead == {k: min((a for a in at if a >= x), default=None) for k, x in enumerate(pos)} | {100: None}


def test_reads_to_contacts(spark):
    sites = spark.createDataFrame([("1", x) for x in (100, 200, 300, 400)] + [("2", x) for x in (50, 150)], "chr string, cut long")
    reads = [("1", 130, 1, "1", 390, 1), ("1", 390, 1, "1", 130, 1), ("1", 110, 1, "1", 150, 0), ("1", 120, 0, "2", 60, 0), ("1", 90, 1, "2", 60, 0), ("1", 130, 1, "2", 149, 0)]
    df = spark.createDataFrame(reads, "c1 string, p1 long, s1 int, c2 string, p2 long, s2 int")
    got = sorted(tuple(r) for r in Re.reads_to_contacts(df, sites, 100).collect())
    # halves of chr 1: 0..5, of chr 2: 6, 7; a forward read faces the upper site.
    assert got == [(0, 6, 1), (1, 5, 1)]


def symmetric(spark, n=12, seed=1):
    rng = np.random.default_rng(seed)
    a = rng.integers(1, 20, (n, n))
    a = np.triu(a) + np.triu(a, 1).T
    rows = [(i, j, int(a[i, j])) for i in range(n) for j in range(i, n)]
    return a, spark.createDataFrame(rows, "id1 long, id2 long, n long")


def test_balancing(spark):
    a, df = symmetric(spark)
    x = {r.id: r.x for r in Mo.knight_ruiz(df).collect()}
    v = np.array([x[k] for k in range(len(a))])
    assert np.allclose(v * (a @ v), 1, atol=1e-4)


def test_express_settles(spark):
    a, df = symmetric(spark, 6)
    off = df.where("id1 <> id2")
    c = {r.id: r.c for r in Mo.express(off, least_change=1e-6, most_passes=60).collect()}
    v = np.array([c[k] for k in range(6)])
    b = a / np.outer(v, v)
    np.fill_diagonal(b, 0)
    assert np.allclose(b.sum(1) / 5, 1, atol=1e-3)


def test_probability_recovers_factors(spark):
    rng = np.random.default_rng(5)
    c = rng.uniform(0.5, 1.5, 15)
    rows = [(i, j, int(rng.poisson(40 * c[i] * c[j]))) for i in range(15) for j in range(i + 1, 15)]
    df = spark.createDataFrame(rows, "id1 long, id2 long, n long")
    got = {r.id: r.c for r in Mo.probability(df, df.select("id1", "id2"), 40.0, passes=6, rate=0.02).collect()}
    assert np.corrcoef([got[k] for k in range(15)], c)[0, 1] > 0.95


def test_core_reaches_a_fixpoint(spark):
    rows = [(i, j, 1) for i in range(5) for j in range(i + 1, 5)] + [(4, 5, 1), (5, 6, 1), (6, 7, 1)]
    df = spark.createDataFrame(rows, "id1 long, id2 long, n long")
    assert C.core(df, 2).count() == 10 and C.core(df, 5).count() == 0


def test_principal_component(spark):
    a, df = symmetric(spark, 8)
    w, v = np.linalg.eigh(a.astype(float))
    got = {r.id: r.x for r in M.principal_component(df, 25).collect()}
    assert abs(abs(np.dot([got[k] for k in range(8)], v[:, -1])) - 1) < 1e-6


def test_random_placement(spark):
    lengths = spark.createDataFrame([("c", 50), ("d", 20)], "chr string, length long")
    mask = spark.createDataFrame([("c", 10, 40)], "chr string, start long, end long")
    sizes = spark.createDataFrame([(1, 5), (2, 10), (3, 60)], "id long, size long")
    got = Ra.place(lengths, mask, sizes, 200, 3).collect()
    assert len(got) == 400 and {r.id for r in got} == {1, 2}
    assert all(r.end - r.start == {1: 5, 2: 10}[r.id] and 0 <= r.start and r.end <= {"c": 50, "d": 20}[r.chr] and (r.chr == "d" or r.end <= 10 or r.start >= 40) for r in got)
    assert {r.start for r in got if r.id == 2 and r.chr == "c"} == {0, 40}
    rows = spark.range(100)
    assert {r.id for r in Ra.sample(rows, 10, 1, "id").collect()} == {r.id for r in Ra.sample(rows.repartition(7), 10, 1, "id").collect()}


def test_expressions(spark):
    one = spark.createDataFrame([("abba", 3.0, 7), ("abbb", -1.5, -7)], "s string, x double, k long")
    got = one.select(X.evaluate("'abba' == s").alias("a"), X.evaluate("where(x > 0, arctan2(x, 2), x ** 2)").alias("b"), X.evaluate("k % 3").alias("c"), X.normal_cdf(F.col("x")).alias("d"), X.complex_sqrt(X.complex_of(F.lit(-4.0), F.lit(0.0)))["im"].alias("e")).collect()
    assert [r.a for r in got] == [True, False] and got[0].b == math.atan2(3, 2) and got[1].b == 2.25
    assert [r.c for r in got] == [1, -1] and got[0].e == 2.0
    assert all(abs(r.d - 0.5 * (1 + math.erf(x / math.sqrt(2)))) < 2e-7 for r, x in zip(got, (3.0, -1.5), strict=True))
    product = one.limit(1).select(X.complex_multiply(X.complex_of(F.lit(1.0), F.lit(2.0)), X.complex_of(F.lit(3.0), F.lit(-1.0))).alias("p")).first().p
    assert (product.re, product.im) == (5.0, 5.0)


def test_sequences(spark):
    one = spark.createDataFrame([("AACgt",), ("",)], "s string")
    got = one.select(S.reverse_complement(F.col("s")).alias("r"), S.gc_fraction(F.col("s")).alias("g"), S.ngrams(F.col("s"), 4).alias("n")).collect()
    assert [tuple(r) for r in got] == [("acGTT", 0.4, ["AACg", "ACgt"]), ("", 0.0, [])]


def test_text_sources(spark, tmp_path):
    def put(name, content):
        path = tmp_path / name
        path.write_text(content)
        return str(path)

    bed = put("a.bed", "track x\nc\t1\t5\tn\t0\t-\n#no\nc\tx\t9\nd\t7\t3\nd\t2\t8\n")
    rows = text.intervals(spark, bed, tolerant=True).collect()
    assert sorted((r.chr, r.start, r.end, r.strand) for r in rows) == [("c", 1, 5, "-"), ("d", 2, 8, "+")]
    assert tuple(text.bad_lines(spark, bed).first()) == (2, 4)
    cuts = put("cut.bed", "".join(f"{c}\t{p - 3}\t{p + 3}\tn\t0\t+\n" for c in "ab" for p in (100, 200, 400)))
    halves = text.half_fragments_from_bed(spark, cuts).orderBy("id").collect()
    assert [(r.id, r.chr, r.start, r.stop) for r in halves][:5] == [(0, "a", 100, 150), (1, "a", 150, 200), (2, "a", 200, 300), (3, "a", 300, 400), (4, "b", 100, 150)]
    fend = put("t.fend", "fend\tfrag\tchr\tcoord\tvalid\tfrag_len\tgc\n1\t1\ta\t100\t1\t50\t0.5\n2\t1\ta\t149\t1\t50\t0.25\n")
    assert [tuple(r) for r in text.fend_table(spark, fend).orderBy("id").collect()] == [(0, "a", 100, 125, 112, 0.5), (1, "a", 125, 150, 137, 0.25)]
    raw = put("r.raw", "1\t10\t+\t2\t20\t-\n")
    assert tuple(text.raw_pairs(spark, raw).first()) == ("1", 10, 1, "2", 20, 0)
    mat = put("m.mat", "fend1\tfend2\tcount\n2\t16\t2\n24\t2\t1\n")
    assert sorted(map(tuple, text.mat_triples(spark, mat).collect())) == [(1, 15, 2), (1, 23, 1)]
    one = put("1.sam", "@HD\nq1\t0\tc\t10\t9\t4M\t*\t0\t0\tACGT\tFFFF\nq2\t16\tc\t20\t9\t4M\t*\t0\t0\tACGT\tFFFF\nq3\t4\t*\t0\t0\t*\t*\t0\t0\tA\tF\n")
    two = put("2.sam", "q1\t16\td\t5\t9\t4M\t*\t0\t0\tACG\tFFF\nq2\t0\td\t7\t9\t4M\t*\t0\t0\tACG\tFFF\tXS:i:1\n")
    pairs = text.paired_sam(text.sam(spark, one), text.sam(spark, two, unique_only=True)).collect()
    assert [tuple(r) for r in pairs] == [("c", 10, 1, "d", 8, 0)]
    wig = put("w.wig", "track\nvariableStep chrom=c span=2\n5 1.5\n9 2\nfixedStep chrom=d start=11 step=3\n7\n8\nc\t0\t4\t0.5\n")
    assert sorted(map(tuple, text.wiggle(spark, wig).collect())) == [("c", 0, 4, 0.5), ("c", 4, 6, 1.5), ("c", 8, 10, 2.0), ("d", 10, 11, 7.0), ("d", 13, 14, 8.0)]
    genes = put("g.txt", "g1\tc\t+\t0\t100\t20\t70\t2\t10,60,\t30,90,\n")
    feature = lambda f: sorted((r.start, r.end) for r in text.gene_features(spark, genes, f).collect())
    assert feature("exon") == [(10, 30), (60, 90)] and feature("intron") == [(30, 60)] and feature("cds") == [(20, 30), (60, 70)]
    fa = put("f.fa", ">s1 note\nACGT\nAC\n>s2\nG\n")
    assert sorted(map(tuple, text.fasta(spark, fa).collect())) == [("s1", "ACGTAC"), ("s2", "G")]
    maf = put("x.maf", "##maf\na score=7.5\ns hg.c1 10 4 + 99 AC-GT\ns mm.c2 3 5 - 80 ACCGT\n\na score=1\ns hg.c1 50 2 + 99 AA\n")
    blocks = text.maf(spark, maf)
    big = S.filter_blocks(blocks, min_rows=2, species=["mm"]).collect()
    assert len(big) == 1 and big[0].score == 7.5 and big[0].components[1].src_size == 80
    cut = S.slice_blocks(blocks, spark.createDataFrame([("c1", 11, 13, 1)], "chr string, start long, end long, id long")).collect()
    assert [list(r.texts) for r in cut] == [["C-G", "CCG"]]
    stats = S.column_statistics(blocks.select("id", F.transform("components", lambda c: c["text"]).alias("texts"))).where("gaps > 0").first()
    assert (stats.columns, stats.ungapped, stats.identical, stats.gaps) == (5, 4, 4, 1)


def test_sinks(spark, tmp_path):
    contacts = spark.createDataFrame([(1, 15, 2)], "id1 long, id2 long, n long")
    sinks.mat(contacts, str(tmp_path / "mat"))
    assert [tuple(r) for r in text.mat_triples(spark, str(tmp_path / "mat")).collect()] == [(1, 15, 2)]
    cells = spark.createDataFrame([("c", 0, 0, 1, 4), ("c", 1, 0, 0, 4)], "chr string, level int, bin1 long, bin2 long, obs long")
    sinks.multi_resolution(cells, str(tmp_path / "mrh"))
    assert spark.read.parquet(str(tmp_path / "mrh")).where("level = 1 and chr = 'c'").count() == 1
    sinks.fasta(spark.createDataFrame([("s", "ACGTACGT")], "name string, sequence string"), str(tmp_path / "fa"), 3)
    assert [tuple(r) for r in text.fasta(spark, str(tmp_path / "fa")).collect()] == [("s", "ACGTACGT")]


def test_alignments(spark):
    from loomgrid.functions import alignments as A

    component = "struct<src:string,start:bigint,size:bigint,strand:string,src_size:bigint,text:string>"
    rows = [(1, 2.0, [("a.c", 0, 3, "+", 20, "AC-G"), ("b.c", 5, 3, "+", 30, "A-CG")]), (2, 3.0, [("a.c", 3, 2, "+", 20, "TT"), ("b.c", 8, 2, "+", 30, "TA")]), (3, 1.0, [("a.c", 9, 1, "+", 20, "A"), ("b.c", 20, 1, "+", 30, "A")])]
    df = spark.createDataFrame(rows, f"id long, score double, components array<{component}>")
    fused = {r.id: r for r in A.fuse_blocks(df).collect()}
    assert set(fused) == {1, 3} and fused[1].score == 5.0
    assert [(c.start, c.size, c.text) for c in fused[1].components] == [(0, 5, "AC-GTT"), (5, 5, "A-CGTA")]
    one = A.restrict_species(df.where("id = 1"), ["a"]).first().components
    assert [c.text for c in one] == ["ACG"]
    back = A.reverse_blocks(df.where("id = 2")).first().components
    assert [(c.start, c.strand, c.text) for c in back] == [(15, "-", "AA"), (20, "-", "TA")]
    cut = A.slice_columns(df.where("id = 1"), 1, 4).first().components
    assert [(c.start, c.size, c.text) for c in cut] == [(1, 2, "C-G"), (6, 2, "-CG")]
    t = spark.createDataFrame([("AC-GG", "A-CGT")], "a string, b string").select(A.column_of(F.col("a"), F.lit(2)).alias("c"), A.offset_of(F.col("a"), F.lit(3)).alias("o"), A.pair_score(F.col("a"), F.col("b")).alias("s")).first()
    assert (t.c, t.o) == (3, 2) and t.s == 1 - 4.5 - 4.5 + 1 - 1
    seqs = spark.createDataFrame([("c", "AACCGGTT")], "name string, sequence string")
    iv2 = spark.createDataFrame([("c", 1, 4, 1, "+"), ("c", 1, 4, 2, "-")], "chr string, start long, end long, id long, strand string")
    assert {r.id: r.sequence for r in A.extract(seqs, iv2).collect()} == {1: "ACC", 2: "GGT"}
