import random

import numpy as np
import xxhash

from loomgrid.llm import simhash
from loomgrid.llm.common import connected_components


def brute_classes(rows):
    """{row: component} over (id, fingerprint) rows."""
    fps = sorted({f for _, f in rows})
    root = {f: f for f in fps}

    def find(f):
        while root[f] != f:
            f = root[f]
        return f

    for k, a in enumerate(fps):
        for b in fps[:k]:
            if (a ^ b).bit_count() <= 2:
                root[find(a)] = find(b)
    low = {}
    for i, f in rows:
        if i is not None:
            low[find(f)] = min(i, low.get(find(f), i))
    return sorted(((i, f, low.get(find(f))) for i, f in rows), key=str)


def test_fingerprint_by_definition():
    text = "A b\tC  d É a B c"
    words = text.encode().lower().split()
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[k : k + 3]), 42) for k in range(len(words) - 2)]
    want = sum(1 << bit for bit in range(64) if 2 * sum(h >> bit & 1 for h in hashes) > len(hashes))
    assert simhash.text_fingerprint(text.encode()) == want
    assert simhash.text_fingerprint(b" \n ") == 0
    assert simhash.text_fingerprint(b"one two") == xxhash.xxh64_intdigest(b"one two", 42)


def planted_fingerprints():
    rng = random.Random(3)
    out = {0, 1, (1 << 64) - 1}
    for _ in range(30):
        f = rng.getrandbits(64)
        out.add(f)
        for _ in range(6):
            f ^= 1 << rng.randrange(64)
            if rng.random() < 0.5:
                f ^= 1 << rng.randrange(64)
            out.add(f)
    centre = rng.getrandbits(64)
    out |= {centre ^ (1 << a) ^ (1 << b) for a in range(40, 64) for b in range(8)}  # long runs of one key
    return sorted(out)


def test_links_join_up_every_class(spark):
    fps = planted_fingerprints()
    signed = np.array(fps, dtype=np.uint64).view(np.int64).tolist()
    links = simhash.near_links(spark.createDataFrame([(f,) for f in signed], "fp long"))
    comps = {r.node: r.root for r in connected_components(links).collect()}
    got = {}
    for f, s in zip(fps, signed, strict=True):
        got.setdefault(comps.get(s, s), set()).add(f)
    want = {}
    for _, f, c in brute_classes([(k, f) for k, f in enumerate(fps)]):
        want.setdefault(c, set()).add(f)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def test_documents_with_odd_rows(spark):
    base = " ".join(f"word{k}" for k in range(300))
    rows = [(3, base), (1, base), (1, base), (None, base), (7, None), (8, ""), (9, " \t"), (10, "x"), (11, base.replace("word7 ", "other ")), (12, "long " * 30000)]
    docs = spark.createDataFrame([(*r, "en") for r in rows], "doc_id long, text string, fp string")
    got = sorted(((r.id, r.fp % (1 << 64), r.component_id) for r in simhash.near_duplicate_classes(docs).collect()), key=str)
    assert got == brute_classes([(i, simhash.text_fingerprint((t or "").encode())) for i, t in rows])
    kept = simhash.keep_one_per_class(docs).collect()
    assert {1, None, 7, 10} <= {r.doc_id for r in kept} and not {3, 8, 9} & {r.doc_id for r in kept}
    assert sum(r.doc_id == 1 for r in kept) == 1
    empty = spark.createDataFrame([], docs.schema)
    assert simhash.near_duplicate_classes(empty).count() == 0


def test_components(spark):
    chain = [(k, k + 1) for k in range(40)] + [(100, 200), (200, 300), (300, 100), (5, 5)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(41), 0), 100: 100, 200: 100, 300: 100}


def test_rows_that_share_an_id_are_judged_each(spark):
    a, b = " ".join(f"first{k}" for k in range(30)), " ".join(f"second{k}" for k in range(30))
    docs = spark.createDataFrame([(1, a), (1, b), (1, b), (2, b), (3, a), (4, "alone in here"), (None, a)], "doc_id long, text string")
    kept = [tuple(r) for r in simhash.keep_one_per_class(docs).collect()]
    assert sorted(kept, key=str) == sorted([(1, a), (1, b), (4, "alone in here"), (None, a)], key=str)
