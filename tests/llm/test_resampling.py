import hashlib
import math
import re
import zlib
from collections import Counter

import pytest

from loomgrid.llm import queries, resampling

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SF = "/root/testdata/sf0.001"


def features(text):
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return words, [zlib.crc32(" ".join(words[i : i + k]).encode()) % 10000 for k in (1, 2, 3) for i in range(len(words) - k + 1)]


def brute(docs, target):
    s, t = Counter(b for _, x in docs for b in features(x)[1]), Counter(b for x in target for b in features(x)[1])
    n_s, n_t = s.total(), t.total()
    gain = [math.floor(1000 * math.log((t[k] + 1) * (n_s + 10000) / ((s[k] + 1) * (n_t + 10000)))) for k in range(10000)]
    rows = []
    for doc, text in docs:
        words, found = features(text)
        h = int(hashlib.sha256(f"42:{doc}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in found)
        rows.append([doc, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(words)])
    able = sorted((r for r in rows if r[4] >= 20), key=lambda r: (-r[3], r[0]))
    rank = {r[0]: k + 1 for k, r in enumerate(able[: 5 * len(able) // 100])}
    return sorted((*r[:4], rank.get(r[0])) for r in rows)


def test_query_against_brute_force(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    target = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert sorted(map(tuple, queries.op12_importance_resampling(spark, SF).collect())) == brute(docs, target)


@pytest.mark.parametrize("size", [40, 4 << 20])
def test_long_texts_in_parts(spark, monkeypatch, size):
    """Texts cut into parts of a few words give the same sums."""
    monkeypatch.setattr(resampling, "SLICE_BYTES", size)
    texts = ["one two three, four five-six seven ünï eight nine TEN eleven " * 3, "", None, "...", "x", "A b", "long" * 40 + " tail end of it", "a  b\x00c\x7fd`e{f", "日本 語 2024"]
    target = ["four five six", "日本 語", None, ""]
    docs = [(k, t) for k, t in enumerate(texts)]
    columns = "doc_id long, text string, id string, bucket string, weight string"
    got = resampling.resample(
        spark.createDataFrame([(*d, "x", "y", "z") for d in docs], columns), spark.createDataFrame([(t,) for t in target], "text string"), least_words=2, percent=50
    ).collect()
    want = {r[0]: r for r in brute(docs, target)}
    assert sorted((r.id, r.n_features, r.weight, r.score) for r in got) == sorted(w[:4] for w in want.values())
    able = sorted((r for r in got if r.n_words >= 2), key=lambda r: (-r.score, r.id))
    assert [r.rank for r in able] == [k + 1 if k < len(able) // 2 else None for k in range(len(able))]


def test_repeated_null_and_no_rows(spark):
    text = "word " * 30
    docs = spark.createDataFrame([(1, text), (1, text), (None, text), (2, text + "x")], "doc_id long, text string").repartition(4)
    target = spark.createDataFrame([("word",)], "text string")
    got = resampling.resample(docs, target, percent=100).collect()
    assert sorted((r.id is None, r.id or 0, r.rank or 0) for r in got)[-1] == (True, 0, 0)
    assert sorted(r.rank for r in got if r.rank) == [1, 2, 3]
    assert resampling.resample(docs.limit(0), target).count() == 0
    assert resampling.resample(docs, target.limit(0)).where("weight is not null").count() == 4


def test_crc_of_joined_texts():
    import numpy as np

    a, b = [b"", b"abc", "ü".encode(), b"x" * 300], [b" d", b" ", b" long word", b" y" * 200]
    tables = np.stack([resampling._shift(len(x)) for x in b])
    got = resampling.crc_joined(np.array([zlib.crc32(x) for x in a], np.uint32), np.array([zlib.crc32(x) for x in b], np.uint32), tables, np.arange(4))
    assert got.tolist() == [zlib.crc32(x + y) for x, y in zip(a, b, strict=True)]
