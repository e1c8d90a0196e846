import math
import re
from collections import Counter, defaultdict

import pytest

from loomgrid.llm import lexical_search, queries

WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
SF = "/root/testdata/sf0.001"


def terms(text):
    return ["".join(c.lower() if "A" <= c <= "Z" else c for c in w) for w in WORD.findall(text or "")]


def brute(docs, items, top=10):
    held = [(doc, Counter(terms(text))) for doc, text in docs]
    held = [(doc, c) for doc, c in held if c]
    n, total = len(held), sum(c.total() for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = []
    for item, text in items:
        found = []
        for doc, c in held:
            m = 10 + 90 * c.total() * n // total
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in dict.fromkeys(terms(text)) if t in c)
            if score > 0:
                found.append((-score, doc is None, doc or 0))
        out += [(item, k + 1, None if none else doc, -s) for k, (s, none, doc) in enumerate(sorted(found)[:top])]
    return sorted(out, key=str)


def test_query_against_brute_force(spark):
    docs, items = ([tuple(r) for r in spark.read.parquet(f"{SF}/{t}.parquet").select(k, "text").collect()] for t, k in (("documents", "doc_id"), ("benchmark", "item_id")))
    assert sorted(map(tuple, queries.op13_ranked_search(spark, SF).collect()), key=str) == brute(docs, items)


DOCS = [(k, f"common w{k % 7} W{k % 3} ünï {'rare' if k == 5 else ''} " * (1 + k % 4)) for k in range(60)]
DOCS += [(100 + k, "the same copy of one text") for k in range(40)] + [(1, "the same copy of one text"), (1, "the same copy of one text"), (None, "one text"), (7, None), (8, ""), (9, "...")]
DOCS += [(200, "one " * 400 + "copy"), (201, "one " * 254)]
ITEMS = [(1, "common rare w3"), (2, "same copy"), (3, ""), (4, None), (5, "unknown"), (5, "ÜNÏ ünï one"), (6, "W1 w2 w2 w0"), (None, "rare")]


@pytest.mark.parametrize(("slots", "block", "top"), [(1 << 16, 1024, 10), (4, 1024, 3), (1, 2, 5)])
def test_exact_whatever_the_sketch(spark, monkeypatch, slots, block, top):
    """However many terms share a coordinate, and in blocks of queries, the lists are those of a full search."""
    monkeypatch.setattr(lexical_search, "SLOTS", slots)
    docs = spark.createDataFrame([(*d, "a", "b") for d in DOCS], "doc_id long, text string, id string, query string").repartition(5)
    items = spark.createDataFrame([(*i, "c") for i in ITEMS], "item_id long, text string, id string")
    got = lexical_search.ranked_search(docs, items, top=top, block=block).collect()
    assert sorted(map(tuple, got), key=str) == brute(DOCS, ITEMS, top)


def test_large_blocks_are_halved(spark, monkeypatch):
    monkeypatch.setattr(lexical_search, "BLOCK_BYTES", 10)
    docs, items = spark.createDataFrame(DOCS, "doc_id long, text string"), spark.createDataFrame(ITEMS, "item_id long, text string")
    assert sorted(map(tuple, lexical_search.ranked_search(docs, items).collect()), key=str) == brute(DOCS, ITEMS)


def test_empty_tables(spark):
    docs, items = spark.createDataFrame(DOCS, "doc_id long, text string"), spark.createDataFrame(ITEMS, "item_id long, text string")
    assert lexical_search.ranked_search(docs.limit(0), items).count() == 0
    assert lexical_search.ranked_search(docs, items.limit(0)).count() == 0
