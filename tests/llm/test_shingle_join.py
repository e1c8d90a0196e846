import random

import numpy as np

import corpus_pipeline
from loomgrid.llm import shingle_join, simhash


def brute(rows):
    """{id: smallest id of its class} by exact five-word Jaccard."""
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(len(w) - 4, min(len(w), 1)))}
    ids = sorted(sets)
    low = {i: i for i in ids}
    for a in ids:
        for b in ids:
            both = len(sets[a] & sets[b])
            if b < a and (sets[a] == sets[b] or 5 * both >= 4 * (len(sets[a]) + len(sets[b]) - both)):
                x, y = sorted((low[a], low[b]))
                low = {i: x if r == y else r for i, r in low.items()}
    return low


def planted():
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("aeioutnsrlm") for _ in range(5))
    line = [word() for _ in range(30)]
    bases = [[word() for _ in range(n)] for n in (40, 80, 200)]
    rows = [(0, None), (1, " "), (2, "One two"), (3, "one  TWO"), (4, "one two three")]
    for base in bases:
        for _ in range(40):
            w = list(base)
            for _ in range(rng.randint(0, 6)):
                w[rng.randrange(len(w))] = word()
            rows.append((len(rows), " ".join(w + [word() for _ in range(rng.randint(0, 3))])))
    rows += [(len(rows) + k, " ".join(line + [word() for _ in range(k)])) for k in range(25)]
    return rows


def test_stage_against_brute_force(spark):
    rows = planted()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    low = brute(rows)
    assert 8 < len(set(low.values())) < len(rows) - 40
    got = {r.id: r.component_id for r in shingle_join.similar_classes(docs).collect()}
    assert got == low
    kept = corpus_pipeline.drop_near_duplicates(spark, docs, "")
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(low.values()))
    assert corpus_pipeline.drop_near_duplicates(spark, docs.limit(0), "").count() == 0


def test_moving_frequent_shingles_back_changes_nothing(spark, monkeypatch):
    monkeypatch.setattr(shingle_join, "SAMPLED", 1)
    rows = planted()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert {r.id: r.component_id for r in shingle_join.similar_classes(docs).collect()} == brute(rows)


def test_families_of_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(shingle_join, "BLOCK_BYTES", 4000)
    rows = planted()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert {r.id: r.component_id for r in shingle_join.similar_classes(docs).collect()} == brute(rows)


def test_sketches_never_differ_more_than_sets():
    rng = np.random.default_rng(3)
    for n in (1, 5, 40, 300, 9000):
        a = np.unique(rng.integers(0, 2**64, n, dtype=np.uint64))
        for m in (n, n + n // 8, n + n // 4):
            for shared in (0, n // 2, n):
                b = np.unique(np.r_[a[:shared], rng.integers(0, 2**64, m - shared, dtype=np.uint64)])
                sets = sorted([a, b], key=len)
                found = shingle_join.Sketches([shingle_join.sketch(h) for h in sets]).differences(0, np.array([1]))
                assert found[0] <= len(np.setxor1d(a, b))
    # Runs of sets that share little are told apart.
    a, b = (np.unique(rng.integers(0, 2**64, 500, dtype=np.uint64)) for _ in range(2))
    assert 9 * shingle_join.Sketches([shingle_join.sketch(h) for h in (a, b)]).differences(0, np.array([1]))[0] > 1000


def test_stage_links_by_fingerprints_and_by_similar_sets(spark):
    tails = [" ".join(f"{name}{k}" for k in range(60)) for name in ("first", "second")]
    line = "one line again "
    # 1 and 2 are nearly all one line: equal fingerprints, unlike sets. 2 and 3 have one set, but other counts.
    rows = [(1, line * 101 + tails[0]), (2, line * 101 + tails[1]), (3, line * 3 + tails[1]), (4, " ".join(f"else{k}" for k in range(60)))]
    sets = {i: set(shingle_join.shingle_set(t.encode()).tolist()) for i, t in rows}
    fps = {i: simhash.text_fingerprint(t.encode()) for i, t in rows}
    alike = lambda a, b: 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])
    near = lambda a, b: (fps[a] ^ fps[b]).bit_count() <= 2
    assert [(near(*x), alike(*x)) for x in ((1, 2), (2, 3), (1, 3))] == [(True, False), (False, True), (False, False)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    got = {r.id: (r.fp % (1 << 64), r.component_id) for r in shingle_join.near_copy_classes(docs).collect()}
    assert got == {1: (fps[1], 1), 2: (fps[2], 1), 3: (fps[3], 1), 4: (fps[4], 4)}
    assert sorted(r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()) == [1, 4]
