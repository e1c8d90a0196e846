import hashlib
import random

import numpy as np
import pytest

from loomgrid.llm import suffix_dedup
from loomgrid.llm.suffix_sort import suffix_array


def brute(rows):
    """Reference result: rows of (id, bytes) in order of places."""
    seen, out = set(), []
    for doc, text in rows:
        gone = np.zeros(len(text), dtype=bool)
        for i in range(len(text) - 99):
            w = text[i : i + 100]
            if w in seen:
                gone[i : i + 100] = True
            seen.add(w)
        kept = bytes(c for c, g in zip(text, gone, strict=True) if not g)
        runs = int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum())
        out.append((doc, len(text), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=lambda r: (r[0] is not None, r[0]))


@pytest.mark.parametrize("alphabet", [1, 2, 4, 200])
def test_suffix_array(alphabet):
    rng = np.random.default_rng(alphabet)
    for n in (1, 2, 3, 10, 500):
        t = rng.integers(0, alphabet, n)
        assert suffix_array(t).tolist() == sorted(range(n), key=lambda i: t[i:].tolist())


def corpus():
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 9)))
    text = lambda n: " ".join(word() for _ in range(n))
    passage, other = text(60), text(30)
    rows = [(k, text(40) + passage[k % 7 :] + text(rng.randint(0, 50))) for k in range(40, 70)]
    rows += [(5, rows[3][1]), (6, rows[3][1]), (7, other + text(20) + other), (8, "x" * 3000), (9, "ab" * 900 + text(10))]
    rows += [(10, ""), (11, None), (12, "short"), (13, passage[:99]), (14, passage[:100]), (15, "é" * 400)]
    near = rows[2][1].split(" ")
    for k in range(20):
        near[(k * 13) % len(near)] = word()
        rows.append((100 + k, " ".join(near)))
    return rows


def run(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumnRenamed("text", "text")
    got = suffix_dedup.removal_report(docs).collect()
    return sorted((tuple(r) for r in got), key=lambda r: (r[0] is not None, r[0]))


def test_against_brute_force(spark):
    rows = corpus()
    assert run(spark, rows) == brute(sorted((d, (t or "").encode()) for d, t in rows))


def test_crowded_anchors_and_many_buckets(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "CROWDED", 3)
    monkeypatch.setattr(suffix_dedup, "BUCKET_BYTES", 2000)
    monkeypatch.setattr(suffix_dedup, "SHARD_BYTES", 1000)
    rows = corpus()
    assert run(spark, rows) == brute(sorted((d, (t or "").encode()) for d, t in rows))


def test_repeated_and_null_ids(spark):
    a, b = "one two three four five six " * 9, "seven eight nine ten eleven " * 9
    got = run(spark, [(None, a), (1, a), (1, a), (2, b), (2, b + a)])
    assert [(r[0], r[1]) for r in got] == [(None, 252), (1, 252), (1, 252), (2, 252), (2, 504)]
    assert got[1][2] == got[2][2] == 252 and got[0][2] < 252
    assert run(spark, []) == []


def test_cut_texts_keep_columns(spark):
    rows = [(1, "a b c " * 40, "en", "x"), (2, "q" + "a b c " * 40, "fr", None), (3, None, None, "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, spans string")
    got = {r.doc_id: r for r in suffix_dedup.without_repeats(docs).collect()}
    assert got[2].lang == "fr" and got[3].text is None and got[3].spans == "y"
    assert len(got[2].text) < len(rows[1][1])
